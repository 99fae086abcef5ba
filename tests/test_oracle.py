"""Every query with SQL against that SQL, on the smallest tables."""

import math

import duckdb
import pytest

from terrapanel.plans import registry

PATH = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{PATH}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def key(row):
    return repr(row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_match_sql(spark, sql, name):
    df = registry.queries()[name](spark, PATH)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    out = sql.execute(registry.oracle_sql()[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-5)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert registry.queries()[name](spark, PATH).count() > 0


@pytest.mark.parametrize("name", ["J7_polygon_intersects", "J9_point_in_box", "J11_change_detection", "G7_within_distance", "J4_interval"])
def test_no_nested_loops(spark, name):
    plan = registry.queries()[name](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
