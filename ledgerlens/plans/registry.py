"""Names of all queries, with the DuckDB SQL that checks them."""

from . import block_queries, file_queries, graph_queries, history_queries, module_queries, report_queries, rule_queries, scoring_queries, source_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (history_queries, file_queries, graph_queries, scoring_queries, source_queries, rule_queries, module_queries, block_queries, report_queries):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
