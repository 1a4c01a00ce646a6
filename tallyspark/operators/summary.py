"""Summaries of a filtered graph, and of two years against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S
from tallyspark.tables import held

from .flow import Graph


def project_table(graph: Graph) -> DataFrame:
    """pid, id, name, ministry, budget, spending (to recipients that remain) of each remaining project."""
    own = graph.nodes.where("not coalesce(aggregated, false)")
    budget = own.where("type = 'project-budget'").select(F.col("project_id").alias("pid"), F.col("value").alias("budget"))
    spent = graph.edges.where(F.col("target").startswith("r-")).groupBy(F.col("source").alias("id")).agg(F.sum("value").alias("spending"))
    return (own.where("type = 'project-spending'").select(F.col("project_id").alias("pid"), "id", "name", "ministry")
            .join(budget, "pid", "left").join(spent, "id", "left")
            .select("pid", "id", "name", "ministry", F.coalesce("budget", F.lit(0)).alias("budget"), F.coalesce("spending", F.lit(0)).alias("spending")))


def recipient_table(graph: Graph) -> DataFrame:
    """id, name, aggregated, inflow of each recipient that any remaining project has an edge to."""
    inflow = graph.edges.where(F.col("target").startswith("r-")).groupBy(F.col("target").alias("id")).agg(F.sum("value").alias("inflow"))
    named = graph.nodes.where("type = 'recipient'").select("id", "name", F.coalesce("aggregated", F.lit(False)).alias("aggregated"))
    return inflow.join(named, "id", "left").withColumns({"name": F.coalesce("name", "id"), "aggregated": F.coalesce("aggregated", F.lit(False))})


def top_projects(graph: Graph, n: int = 10) -> DataFrame:
    return project_table(graph).orderBy(F.desc("spending"), F.desc("budget"), "pid").limit(n)


def top_recipients(graph: Graph, n: int = 10) -> DataFrame:
    return recipient_table(graph).orderBy(F.desc("inflow"), "id").limit(n)


def totals(graph: Graph) -> DataFrame:
    """One row: counts, sums, ministry names, and the share of the largest one and three recipients (collective nodes aside)."""
    p, r = project_table(graph), recipient_table(graph)
    single = r.where("not aggregated")
    # the three largest by top-k, not by a sort of all
    three = F.broadcast(single.orderBy(F.desc("inflow"), "id").limit(3).groupBy().agg(
        F.max("inflow").alias("first"), F.sum("inflow").alias("three")))
    sums = p.agg(F.count(F.lit(1)).alias("project_count"), F.coalesce(F.sum("budget"), F.lit(0)).alias("budget_total"),
                 F.coalesce(F.sum("spending"), F.lit(0)).alias("spending_total"),
                 F.array_sort(F.collect_set(F.nullif("ministry", F.lit("")))).alias("ministries"))
    whole = r.agg(F.count(F.lit(1)).alias("recipient_count"), F.coalesce(F.sum(F.when(~F.col("aggregated"), F.col("inflow"))), F.lit(0)).alias("whole"))
    share = lambda c: F.when(F.col("whole") > 0, S.half_up(F.coalesce(F.col(c), F.lit(0)).cast("double") / F.col("whole"), 4))
    return (sums.crossJoin(whole).crossJoin(three)  # one row each
            .select("project_count", "budget_total", "spending_total", "recipient_count", share("first").alias("top_share1"),
                    share("three").alias("top_share3"), F.size("ministries").alias("ministry_count"), "ministries"))


def compare_projects(base: Graph, compare: Graph) -> DataFrame:
    """Every project of either year: status (increased, decreased, same, added, removed) and the differences."""
    return compare_project_tables(project_table(base), project_table(compare))


def compare_project_tables(base: DataFrame, compare: DataFrame) -> DataFrame:
    """The same of tables (pid, name, ministry, budget, spending) of two years: no graph is needed."""
    side = lambda t, s: t.select("pid", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "ministry", "budget", "spending")])
    both = side(base, "base").join(side(compare, "compare"), "pid", "full_outer")
    there, here = F.col("spending_base").isNotNull(), F.col("spending_compare").isNotNull()
    change = F.col("spending_compare") - F.col("spending_base")
    status = (F.when(~there, "added").when(~here, "removed").when(change > 0, "increased").when(change < 0, "decreased").otherwise("same"))
    return both.select(
        "pid", F.coalesce("name_compare", "name_base").alias("name"), F.coalesce("ministry_compare", "ministry_base").alias("ministry"),
        status.alias("status"), "budget_base", "budget_compare", (F.col("budget_compare") - F.col("budget_base")).alias("budget_diff"),
        S.diff_rate(F.col("budget_base"), F.col("budget_compare")).alias("budget_diff_rate"), "spending_base", "spending_compare",
        change.alias("spending_diff"), S.diff_rate(F.col("spending_base"), F.col("spending_compare")).alias("spending_diff_rate"))


def compare_recipients(base: Graph, compare: Graph, by: str = "id") -> DataFrame:
    """As compare_projects() for recipients. by: their id, which is a rank within a year, or their name."""
    side = lambda g, s: (recipient_table(g).where("not aggregated").groupBy(F.col(by).alias("key"))
                         .agg(F.max("name").alias(f"name_{s}"), F.sum("inflow").alias(f"inflow_{s}")))
    both = side(base, "base").join(side(compare, "compare"), "key", "full_outer")
    change = F.col("inflow_compare") - F.col("inflow_base")
    status = (F.when(F.col("inflow_base").isNull(), "added").when(F.col("inflow_compare").isNull(), "removed").when(change > 0, "increased")
              .when(change < 0, "decreased").otherwise("same"))
    return both.select("key", F.coalesce("name_compare", "name_base").alias("name"), status.alias("status"), "inflow_base", "inflow_compare",
                       change.alias("diff"), S.diff_rate(F.col("inflow_base"), F.col("inflow_compare")).alias("diff_rate"))


def largest_changes(changes: DataFrame, status: str, n: int = 10, key: str = "pid") -> DataFrame:
    """The n largest of one status, by the difference or by the amount in the year they exist."""
    size = F.abs(F.coalesce("spending_diff" if key == "pid" else "diff", *(
        ("spending_compare", "spending_base") if key == "pid" else ("inflow_compare", "inflow_base"))))
    return changes.where(F.col("status") == status).orderBy(size.desc(), key).limit(n)


def spending_change(base: Graph, compare: Graph, n: int = 10) -> DataFrame:
    """The n largest projects of each status: increased, decreased, added, removed."""
    changes = held(compare_projects(base, compare))  # read four times
    lists = [largest_changes(changes, status, n) for status in ("increased", "decreased", "added", "removed")]
    out = lists[0]
    for one in lists[1:]:
        out = out.unionByName(one)
    return out
