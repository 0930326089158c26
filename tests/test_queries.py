"""Every registered query of the engine against its SQL on a small scale, value by value."""

import math
from pathlib import Path

import duckdb
import pytest

from brookline.plans import catalog
from brookline.plans.frame import events

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert got
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted([tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in found.fetchall()], key=repr)
    assert got == want


def test_diff_after_zero(spark, duck, tmp_path):
    """A percentage of zero is infinite, or no number, as in the SQL."""
    duck.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 4 < 2 THEN 0.0 ELSE value END AS value, event_id % 5 AS user_id) FROM events) TO '{tmp_path}/events.parquet'")
    got = sorted([tuple(r) for r in catalog.queries()["diff"](spark, str(tmp_path)).select("event_id", "d", "p").collect()], key=lambda r: r[0])
    want = sorted(duck.execute(catalog.oracle_sql()["diff"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall())
    assert repr(got) == repr(want)
    assert {math.inf} < {r[2] for r in want} and any(math.isnan(r[2]) for r in want if r[2] is not None)


def test_sort_by_the_text_of_any_double(spark, duck, tmp_path):
    """Numbers that Spark's cast writes with an E sort where their plain text stands in the SQL."""
    odd = "[0.0, -0.0, 0.29, 9.99e-4, -1.25e-4, 1e-4, 3.5e-5, 2e-7, 9999999.99, 1e7, 12345678.9, -1e7, 2e9, 123456789012345.6, 9007199254740993.0, 1e16, 1.5e17, -2e22, 1e100, 'inf', '-inf', 'nan']::DOUBLE[]"
    duck.execute(f"COPY (SELECT * REPLACE (list_extract({odd}, CAST(c_custkey % 23 AS INT)) AS c_acctbal) FROM customer WHERE c_custkey % 23 > 0) TO '{tmp_path}/customer.parquet'")
    sql = catalog.oracle_sql()["sort"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet'")
    got = catalog.queries()["sort"](spark, str(tmp_path)).select("k", "at").collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(sql).fetchall())


def test_text_of_doubles(spark, duck):
    numbers = [float(f"{m}e{k}") for k in range(-20, 21) for m in (1, -2.5, 1.2345678, 9.99)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = [r[0] for r in events(df, "x").df.select(events(df, "x").key("x")).collect()]
    assert got == [duck.execute("SELECT CAST(CAST(? AS DOUBLE) AS VARCHAR)", [x]).fetchone()[0] for x in numbers]
