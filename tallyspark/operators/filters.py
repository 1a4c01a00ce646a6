"""Filters over a flow graph: single tests, then cascades to projects without recipients and ministries without projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans.query import Filter, Range
from tallyspark.tables import held

from .flow import Graph


def outside(value: Column, limits: Range, low: float | None = None) -> Column:
    """Not between the limits; low is what a missing lower one means."""
    least = limits.min if limits.min is not None else low
    tests = [value < F.lit(least)] if least is not None else []
    tests += [value > F.lit(limits.max)] if limits.max is not None else []
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def protected_pids(ids: list[str | None]) -> list[int]:
    return sorted({int(i.rpartition("-")[2]) for i in ids if i and i.startswith(("project-spending-", "project-budget-"))})


def excluded(graph: Graph, f: Filter, protected: list[str | None] = (), exclude_project: DataFrame | None = None) -> DataFrame | None:
    """Ids of the nodes that the filter takes out, or None if it's inactive. exclude_project(pid) adds projects to take out."""
    if not (f.active or exclude_project is not None):
        return None
    nodes, edges = graph.nodes, graph.edges
    own = nodes.where("not coalesce(aggregated, false)")
    budgets = own.where("type = 'project-budget' and project_id is not null")
    to_recipient = edges.where(F.col("target").startswith("r-"))
    matches = (lambda c: c.rlike(f.recipient_name.pattern)) if f.recipient_name else None
    tests: list[Column] = []
    if f.budget:
        tests.append(outside(F.col("value"), f.budget))
    if f.project_name:
        tests.append(~F.col("name").rlike(f.project_name.pattern))
    if f.ministries:
        tests.append(~F.coalesce("ministry", F.lit("")).isin(*f.ministries))
    if f.by_account:
        tests.append(~F.coalesce("account_category", F.lit("none")).isin(*f.accounts))
    if f.depth is not None:
        tests.append(F.coalesce("subcontract_depth", F.lit(1)) < f.depth)
    candidates = budgets
    if f.recipient_name and f.recipient_name.include_subcontract:
        named = own.where("type = 'recipient'").where(matches(F.col("name"))).select("id")
        direct = to_recipient.join(named, F.col("target") == F.col("id"), "left_semi").select(F.col("source").alias("__hit")).distinct()
        candidates = candidates.join(direct, F.concat(F.lit("project-spending-"), F.col("project_id")) == F.col("__hit"), "left")
        tests.append(F.col("__hit").isNull() & ~F.coalesce(F.exists("subcontract_recipients", matches), F.lit(False)))
    if exclude_project is not None:
        extra = exclude_project.select(F.col("pid").alias("__extra")).distinct()
        candidates = candidates.join(extra, F.col("project_id") == F.col("__extra"), "left")
        tests.append(F.col("__extra").isNotNull())
    failing = candidates.where(reduce(lambda a, b: a | b, tests, F.lit(False))).select(F.col("project_id").alias("pid"))

    recipient_tests = [outside(F.col("value"), f.spending, 0)] if f.spending else []
    if f.recipient_name and not f.recipient_name.include_subcontract:
        recipient_tests.append(~matches(F.col("name")))
    gone = own.where("type = 'recipient'").where(reduce(lambda a, b: a | b, recipient_tests, F.lit(False))).select("id")

    spenders = nodes.where("type = 'project-spending' and project_id is not null").select(F.col("project_id").alias("pid"), "id")
    if f.spending or f.budget or f.ministries or f.recipient_name or f.depth is not None or exclude_project is not None:
        alive = to_recipient.join(gone, F.col("target") == F.col("id"), "left_anti").select("source").distinct()
        empty = spenders.join(alive, F.col("id") == F.col("source"), "left_anti").select("pid")
        if keep := protected_pids(protected):
            empty = empty.where(~F.col("pid").isin(*keep))
        failing = failing.unionByName(empty)
    failing = failing.distinct()
    pairs = failing.select(F.explode(F.array(F.concat(F.lit("project-budget-"), "pid"), F.concat(F.lit("project-spending-"), "pid"))).alias("id"))
    out = gone.unionByName(pairs.join(nodes.select("id"), "id", "left_semi"))
    out = held(out)

    alive_m = (edges.where(F.col("target").startswith("project-budget-")).join(out, F.col("target") == F.col("id"), "left_anti")
            .select(F.col("source").alias("ministry_id")))
    if not (f.budget and f.budget.min is not None and f.budget.min > 0):
        paying = nodes.where("type = 'project-spending' and value > 0 and ministry is not null").join(out, "id", "left_anti")
        alive_m = alive_m.unionByName(paying.select(F.concat(F.lit("ministry-"), "ministry").alias("ministry_id")))
    bare = own.where("type = 'ministry'").join(alive_m.distinct(), F.col("id") == F.col("ministry_id"), "left_anti").select("id")
    return out.unionByName(bare)


def applied(graph: Graph, out: DataFrame | None) -> Graph:
    """The graph without some nodes and the edges at them."""
    if out is None:
        return graph
    gone = held(out.select(F.col("id").alias("__gone")))
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(gone, edges[end] == gone["__gone"], "left_anti")
    return Graph(graph.nodes.join(gone, F.col("id") == F.col("__gone"), "left_anti"), edges)
