"""Registered queries against their SQL on the smallest tables."""

import os

import pandas as pd
import pytest

from tallyspark.plans import catalog

catalog.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(([str(plain(v)).removesuffix(".0") for v in r] for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def altered(duck, folder, table, sql):
    """The tables of graphs in a folder, one of them as the SQL makes it, and a connection that sees it."""
    for t in {"customer", "nation", "orders", "lineitem", "supplier"} - {table}:
        (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    one = duck.cursor()
    one.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    one.execute(f"CREATE TEMP VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return one


@pytest.mark.parametrize("name, orders", [("project_focus_nodes", "o_custkey <> 7"), *[
    (f"{n}_nodes", "year(o_orderdate) <> 1997") for n in ("project_focus", "ministry_focus", "recipient_focus", "recipient_window")]])
def test_views_of_no_project_match_sql(spark, duck, tmp_path, name, orders):
    one = altered(duck, tmp_path, "orders", f"SELECT * FROM orders WHERE {orders}")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), one.execute(catalog.ORACLE_SQL[name]).df()
    assert rows(want) == [["total", "None"]] and rows(got) == rows(want)


@pytest.mark.parametrize("table, sql, n", [
    ("orders", "SELECT * FROM orders WHERE year(o_orderdate) <> 1997", 4), ("customer", "SELECT * REPLACE (c_nationkey % 4 AS c_nationkey) FROM customer", 1)])
def test_aggregates_of_none_match_sql(spark, duck, tmp_path, table, sql, n):
    one = altered(duck, tmp_path, table, sql)
    got, want = catalog.QUERIES["topn_window_nodes"](spark, str(tmp_path)).toPandas(), one.execute(catalog.ORACLE_SQL["topn_window_nodes"]).df()
    assert sum(v == "None" for _, v in rows(want)) == n and rows(got) == rows(want)
