"""Queries against their SQL on the small driver tables."""

import os

import duckdb
import pytest

from ledgerlens.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else round(v, 5) if isinstance(v, float) else v
    return sorted(([plain(v) for v in r] for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_plans_push_filters_and_prune_columns(spark):
    plan = registry.QUERIES["declared_minus_used"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan
