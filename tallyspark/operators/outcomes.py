"""Outcome indicators, logic models and text details of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indicators(rows: DataFrame) -> DataFrame:
    """rows(pid, indicator, kind, row_kind target|actual|rate|unit, year, value) -> a row an indicator with a map of years for each row kind."""
    series = rows.groupBy("pid", "indicator", "kind", "row_kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value")))).alias("series"))
    return series.groupBy("pid", "indicator", "kind").pivot("row_kind", ["target", "actual", "rate", "unit"]).agg(F.first("series"))


def indicator_counts(table: DataFrame) -> DataFrame:
    """Per project: indicators by kind, and how many have targets, actuals and rates."""
    by = table.groupBy("pid", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("pid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    has = lambda c: F.count_if(F.col(c).isNotNull()).alias(f"with_{c}")
    return table.groupBy("pid").agg(F.count(F.lit(1)).alias("indicators"), has("target"), has("actual"), has("rate")).join(by, "pid")


def logic_paths(edges: DataFrame) -> DataFrame:
    """edges(pid, from_kind, to_kind): paths by kinds, and whether any reaches an outcome."""
    paths = edges.groupBy("pid", F.concat_ws("→", "from_kind", "to_kind").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    reach = edges.groupBy("pid").agg(F.bool_or(F.col("to_kind").contains("アウトカム")).alias("reaches_outcome"))
    return paths.groupBy("pid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "n")))).alias("paths")).join(reach, "pid")


def universe(frames: list[DataFrame], key: str = "pid") -> DataFrame:
    """All keys of several frames, each left-joined to them."""
    keys = frames[0].select(key)
    for f in frames[1:]:
        keys = keys.unionByName(f.select(key))
    out = keys.distinct()
    for f in frames:
        out = out.join(f, key, "left")
    return out


def categories(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, amount and share of the whole amount of each category."""
    total = rows.agg(F.sum(value).alias("__t"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("amount")).crossJoin(F.broadcast(total)).withColumn(
        "share", F.col("amount").cast("double") / F.nullif("__t", F.lit(0))).drop("__t")


def top_recipients_each(rows: DataFrame, n: int = 5) -> DataFrame:
    """rows(pid, recipient, amount) -> the n largest of each project with their share of its total."""
    from pyspark.sql.window import Window

    sums = rows.groupBy("pid", "recipient").agg(F.sum("amount").alias("amount"))
    whole = sums.groupBy("pid").agg(F.sum("amount").alias("total"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("amount"), "recipient"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n).join(whole, "pid").withColumn("share", F.col("amount").cast("double") / F.nullif("total", F.lit(0))).drop("total")


def stratified(rows: DataFrame, key: str, identity: str, per: int, seed: int = 42) -> DataFrame:
    """A seeded sample of so many rows a stratum."""
    from pyspark.sql.window import Window

    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(identity, F.lit(seed)), identity))).where(F.col("__k") <= per).drop("__k")


def drill_down(nodes: DataFrame, edges: DataFrame, selected: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ministries, projects, recipients) related to a selected node, largest first."""
    pay = edges.where(F.col("target").startswith("r-")).join(
        nodes.where("type = 'project-spending'").select(F.col("id").alias("source"), "ministry", "name", F.col("project_id").alias("pid")), "source")
    tests = {"ministry-": F.concat(F.lit("ministry-"), "ministry") == selected, "project-": F.col("pid") == selected.rpartition("-")[2], "r-": F.col("target") == selected}
    own = pay.where(next((t for p, t in tests.items() if selected.startswith(p)), F.lit(True)))
    m = own.groupBy("ministry").agg(F.countDistinct("pid").alias("projects"), F.countDistinct("target").alias("recipients"), F.sum("value").alias("amount"))
    p = own.groupBy("pid", "name", "ministry").agg(F.countDistinct("target").alias("recipients"), F.sum("value").alias("amount"))
    r = own.groupBy(F.col("target").alias("id")).agg(F.countDistinct("pid").alias("projects"), F.sum("value").alias("amount"))
    return m.orderBy(F.desc("amount"), "ministry"), p.orderBy(F.desc("amount"), "pid"), r.orderBy(F.desc("amount"), "id")


def ministry_stats(projects: DataFrame) -> DataFrame:
    """projects(ministry, budget, spending): totals, and projects with only one of both or none."""
    b, s = F.col("budget") > 0, F.col("spending") > 0
    return projects.groupBy("ministry").agg(F.sum("budget").alias("budget"), F.sum("spending").alias("spending"), F.count(F.lit(1)).alias("projects"),
                                            F.count_if(b & ~s).alias("budget_only"), F.count_if(~b & s).alias("spending_only"), F.count_if(~b & ~s).alias("neither"))
