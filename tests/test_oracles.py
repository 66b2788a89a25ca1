"""Every registered query against its oracle on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest
from sonolith.plans import queries
from sonolith.plans import more_queries  # noqa: F401
from sonolith.plans.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    return ("nan" if math.isnan(x) else round(x, 6) + 0.0) if isinstance(x, float) else x


def table(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = table(tuple(r) for r in df.select(*columns).collect())
    if name in queries.ORACLES:
        found = duck.sql(queries.ORACLES[name])
        assert sorted(found.columns) == columns
        assert got == table(duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({queries.ORACLES[name]})").fetchall())
    else:
        assert got


def test_whole_tables(spark):
    """These queries have every key of their tables."""
    larger, duck = SF.replace("0.001", "0.01"), duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{larger}/{t}.parquet'")
    rows = lambda name: queries.QUERIES[name](spark, larger)
    one = lambda sql: duck.sql(sql).fetchall()[0][0]
    users = one("select count(distinct user_id) from events")
    assert users > 20
    assert all(rows(n).select("file_id").distinct().count() == users for n in ("asof_beats", "nearest_beat"))
    assert rows("medians").count() == one("select count(distinct l_suppkey) from lineitem")
    assert rows("vocabulary_errors").count() == one("select count(*) from (select distinct p_name, p_type from part)")
    assert rows("insert_or_ignore").count() == one("select count(*) from (select distinct l_suppkey, l_partkey from lineitem)")
    assert rows("collection_files").count() == one("select count(*) from orders join part on o_custkey = p_partkey") > 50
    assert {r["value"] for r in rows("facet_values").collect()} == {x for (x,) in duck.sql("select distinct upper(p_name) from part").fetchall()}
