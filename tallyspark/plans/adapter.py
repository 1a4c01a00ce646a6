"""The driver's tables as the model's: customers are projects, their nations ministries, orders budgets, lines spending.

Money is kept in whole units of a hundredth of a cent, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.flow import Graph, build_graph, project_sums
from tallyspark.sources.files import fingerprint
from tallyspark.tables import held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("ministry")))  # 25 rows
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), "ministry", F.col("c_mktsegment").alias("category"))


def of_year(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Orders of a year; the range test reaches the scan."""
    return table(spark, sf_dir, "orders").where(
        (F.col("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp")))


def budgets(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    from tallyspark.functions.semantics import account_category

    return of_year(spark, sf_dir, year).groupBy(F.col("o_custkey").alias("pid")).agg(
        F.sum(cents("o_totalprice") * 100).alias("budget"),
        account_category(F.bool_or(F.col("o_orderstatus") == "F"), F.bool_or(F.col("o_orderstatus") == "O")).alias("account_category"))


def lines(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """pid, order, line columns and amount of every line of a year. A task holds a hash table of its share of the year's orders, which is what it needs memory for;
    a merge join would sort all lines of all years, in memory or in spills."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag",
                                                   (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("amount"))
    return of_year(spark, sf_dir, year).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid")).hint("shuffle_hash").join(line, "l_orderkey")


def spending(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("recipient"))
    return (lines(spark, sf_dir, year).groupBy("pid", "l_suppkey").agg(F.sum("amount").alias("amount")).join(supplier, "l_suppkey")
            .select("pid", "recipient", F.lpad(F.col("l_suppkey").cast("string"), 13, "0").alias("number"), "amount"))


def project_table(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """pid, name, ministry, budget, spending of a year's projects, without its recipients, nodes and edges; a written table, as its joins and sums are all by
    the project and would share one task's memory with those of the other year that it is held against."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    paid = lines(spark, sf_dir, year).join(known, "l_suppkey", "left_semi").groupBy("pid").agg(F.sum("amount").alias("amount"))
    # a project without orders in the year has no category
    own = project_sums(projects(spark, sf_dir), budgets(spark, sf_dir, year), paid).where("account_category is not null")
    return held(own.select("pid", "name", "ministry", "budget", F.col("spent").alias("spending")))


_GRAPHS: dict[tuple, tuple[str, Graph]] = {}
#: The tables that a graph is made of.
GRAPH_TABLES = ("customer", "nation", "orders", "lineitem", "supplier")


def graph(spark: SparkSession, sf_dir: str, year: int) -> Graph:
    """A year's graph: built and written once a session, and anew when a file of its tables has changed, as all queries on it share it."""
    key = spark.sparkContext.applicationId, sf_dir, year
    mark = fingerprint(spark, *[f"{sf_dir}/{t}.parquet" for t in GRAPH_TABLES])
    if key not in _GRAPHS or _GRAPHS[key][0] != mark:
        b = budgets(spark, sf_dir, year)
        own = projects(spark, sf_dir).join(b.select("pid"), "pid", "left_semi")
        _GRAPHS[key] = mark, build_graph(own, b, spending(spark, sf_dir, year)).cached()
    return _GRAPHS[key][1]
