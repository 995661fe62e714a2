"""Training-data operators: language-model scoring, de-duplication, quality, packing and scans.

Nothing outside this subpackage imports it.  ``QUERIES`` maps a query name to
``f(spark, sf_dir) -> DataFrame``; ``ORACLES`` holds DuckDB SQL where SQL can
express the query.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value: workers need pyspark and the
# numeric libraries, not a copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def registry():
    """``(queries, oracles)`` of every operator module, imported on first use."""
    from . import (
        chat_format,
        collocations,
        decontaminate,
        filter_audit,
        html_extraction,
        line_dedup,
        lm_scoring,
        packing,
        pii,
        pu_classifier,
        quality_rules,
        secret_scan,
        simhash_dedup,
    )

    modules = (
        lm_scoring, line_dedup, decontaminate, secret_scan, chat_format, pii, packing, pu_classifier, quality_rules, simhash_dedup,
        collocations, filter_audit, html_extraction,
    )
    queries, oracles = {}, {}
    for module in modules:
        queries.update(module.QUERIES)
        oracles.update(getattr(module, "ORACLES", {}))
    return queries, oracles
