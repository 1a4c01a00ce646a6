"""Subcontract graphs: blocks of a project and the flows between them. Depths are found by frontiers that move a level at a time;
each is a written table, so the plan doesn't grow with the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.tables import held

MAX_DEPTH = 30


def merge_parallel(flows: DataFrame) -> DataFrame:
    """Flows between the same blocks as one: their number, and the distinct notes."""
    keys = [c for c in ("pid", "source", "target", "origin", "is_reference") if c in flows.columns]
    notes = F.array_join(F.array_sort(F.collect_set("note")), " / ")
    return flows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *([notes.alias("notes")] if "note" in flows.columns else []))


def origins(flows: DataFrame, direct: DataFrame) -> DataFrame:
    """Blocks that money enters from elsewhere: sources that are never a target and aren't direct. strong: one of their targets has
    another source too. flows(pid, source, target), direct(pid, block)."""
    inner = flows.where("source is not null").select("pid", "source", "target").distinct()
    broad = (inner.select("pid", F.col("source").alias("block")).distinct()
             .join(flows.select("pid", F.col("target").alias("block")), ["pid", "block"], "left_anti").join(direct, ["pid", "block"], "left_anti"))
    merged = inner.groupBy("pid", "target").agg(F.count(F.lit(1)).alias("w")).where("w >= 2")
    feeding = inner.join(merged, ["pid", "target"], "left_semi").select("pid", F.col("source").alias("block"), F.lit(True).alias("strong")).distinct()
    return broad.join(feeding, ["pid", "block"], "left").withColumn("strong", F.coalesce("strong", F.lit(False)))


def structure(flows: DataFrame) -> DataFrame:
    """Per project: targets with several sources, the most sources of one, sources with several targets, the most targets of one."""
    inner = flows.where("source is not null").select("pid", "source", "target").distinct()
    width = lambda end, a, b: (inner.groupBy("pid", end).agg(F.count(F.lit(1)).alias("w"))
                               .groupBy("pid").agg(F.count_if(F.col("w") >= 2).alias(a), F.max("w").alias(b)))
    return width("target", "merge_count", "max_merge_width").join(width("source", "branch_count", "max_branch_width"), "pid")


def flow_origins(flows: DataFrame, separate: DataFrame) -> DataFrame:
    """Adds origin: direct or transfer from the organisation, separate-origin, subcontract; then reference for subcontracts without an
    amount whose note is institutional. flows(pid, source, target, is_direct, transfer, institutional, target_amount)."""
    own = separate.select("pid", F.col("block").alias("source"), F.lit(True).alias("__separate"))
    kind = (F.when(F.col("source").isNull() & F.col("is_direct"), F.when(F.col("transfer"), "transfer").otherwise("direct"))
            .when(F.col("__separate"), "separate-origin")
            .when((F.coalesce("target_amount", F.lit(0)) <= 0) & F.col("institutional"), "reference").otherwise("subcontract"))
    return flows.join(own, ["pid", "source"], "left").withColumn("origin", kind).drop("__separate")


def _edges(flows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(starting blocks, inner edges, projects), all distinct, of flows that are made and written once."""
    separate = F.max(F.col("origin") == "separate-origin") if "origin" in flows.columns else F.lit(False)
    flows = held(flows.groupBy("pid", "source", "target").agg(F.coalesce(separate, F.lit(False)).alias("separate")))
    roots = flows.where("source is null").select("pid", F.col("target").alias("block"))
    separate_roots = flows.where("separate").select("pid", F.col("source").alias("block"))
    return roots.unionByName(separate_roots).distinct(), flows.where("source is not null").select("pid", "source", "target"), flows.select("pid").distinct()


def _followed(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """A frontier's edges, each with its row of the frontier. Both sides are shuffled: few bytes of a written table can be many rows, and a broadcast would
    send all of them through the driver at every level."""
    return frontier.withColumnRenamed("block", "source").hint("merge").join(edges, ["pid", "source"])


def _of_projects(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """The edges of projects that still are in the frontier."""
    return held(edges.join(frontier.select("pid").distinct().hint("merge"), "pid", "left_semi"))


def shortest_depths(flows: DataFrame, first: int = 1, chains: bool = False) -> DataFrame:
    """Depth of each block on the shortest way from a root (first there), up to MAX_DEPTH; chains: the way, in block order on ties."""
    roots, edges, _ = _edges(flows)
    start = roots.withColumn("depth", F.lit(first))
    frontier = seen = held(start.withColumn("chain", F.concat(F.lit("組織→"), "block")) if chains else start)
    left = most = frontier.count()
    for depth in range(first + 1, MAX_DEPTH + 1):
        more = [F.min(F.concat_ws("→", "chain", "target")).alias("chain")] if chains else []
        frontier = held(_followed(frontier, edges).groupBy("pid", F.col("target").alias("block")).agg(F.lit(depth).alias("depth"), *more)
                        .join(seen.select("pid", "block").hint("merge"), ["pid", "block"], "left_anti"))
        left = frontier.count()
        if not left:
            break
        seen = seen.unionByName(frontier)
        if 2 * left < most:
            # blocks of other projects can't be met again
            edges, most = _of_projects(edges, frontier), left
    return seen


def longest_depth(flows: DataFrame) -> DataFrame:
    """Per project: levels on the longest way from a root; a cycle counts up to MAX_DEPTH; 1 without roots. A block is in the
    frontier once a level, however many ways lead to it."""
    roots, edges, projects = _edges(flows)
    frontier = held(roots)
    left = most = frontier.count()
    reached = [projects.withColumn("depth", F.lit(1))]
    for depth in range(1, MAX_DEPTH + 1):
        reached.append(frontier.select("pid", F.lit(depth).alias("depth")))
        if depth == MAX_DEPTH:
            break
        frontier = held(_followed(frontier, edges).select("pid", F.col("target").alias("block")).distinct())
        left = frontier.count()
        if not left:
            break
        if 2 * left < most:
            edges, most = _of_projects(edges, frontier), left
    every = reached[0]
    for r in reached[1:]:
        every = every.unionByName(r)
    return every.groupBy("pid").agg(F.max("depth").alias("max_depth"))


def back_edges(flows: DataFrame, depths: DataFrame) -> DataFrame:
    """Inner flows with the depths of both ends: self (loop), back (not to a deeper block) or forward."""
    side = lambda end: depths.select("pid", F.col("block").alias(end), F.col("depth").alias(f"{end}_depth"))
    kind = F.when(F.col("source") == F.col("target"), "self").when(F.col("source_depth") > F.col("target_depth"), "back").otherwise("forward")
    return (flows.where("source is not null").join(side("source"), ["pid", "source"], "left").join(side("target"), ["pid", "target"], "left")
            .withColumn("kind", kind))


def neighbours(flows: DataFrame) -> DataFrame:
    """Per block: the first source in file order, and all targets. flows(pid, source, target, line_no)."""
    inner = flows.where("source is not null")
    up = inner.groupBy("pid", F.col("target").alias("block")).agg(F.min_by("source", F.struct("line_no", "source")).alias("upstream"))
    down = inner.groupBy("pid", F.col("source").alias("block")).agg(F.array_sort(F.collect_set("target")).alias("downstream"))
    return up.join(down, ["pid", "block"], "full_outer")


def main_parent(flows: DataFrame) -> DataFrame:
    """The source with the largest amount of each target: the tree that a fan-in is drawn as. flows(pid, source, target, amount)."""
    return (flows.where("source is not null").groupBy("pid", "target", "source").agg(F.sum("amount").alias("amount"))
            .groupBy("pid", "target").agg(F.max_by("source", F.struct("amount", "source")).alias("parent")))


def chains(flows: DataFrame, blocks: DataFrame, n: int = 10) -> DataFrame:
    """The n largest inner flows with their blocks' names and amounts. blocks(pid, block, name, amount)."""
    side = lambda end: blocks.select("pid", F.col("block").alias(end), F.col("name").alias(f"{end}_name"), F.col("amount").alias(f"{end}_amount"))
    return (flows.where("source is not null").select("pid", "source", "target").distinct().join(side("source"), ["pid", "source"])
            .join(side("target"), ["pid", "target"]).orderBy(F.desc("target_amount"), "pid", "source", "target").limit(n))


def indirect_costs(costs: DataFrame) -> DataFrame:
    """Per project: costs that the state bears itself and that hang at no block; negative amounts count 0."""
    return (costs.where("not coalesce(attached, false)").groupBy("pid")
            .agg(F.sum(F.greatest("amount", F.lit(0))).alias("amount"), F.count(F.lit(1)).alias("n")))


# ---- blocks, their recipients and expenses ------------------------------------------------------------------------------


def block_heads(rows: DataFrame) -> DataFrame:
    """rows(pid, block, name, amount, role, line_no) -> a row a block: the first name and role that aren't blank and the first amount that
    isn't 0, in file order; blank and 0 where there is none."""
    first = lambda c, good: F.min_by(F.when(good, F.col(c)), F.when(good, F.struct("line_no", c)))
    text = lambda c: F.coalesce(first(c, F.trim(c) != ""), F.lit("")).alias(c)
    return rows.groupBy("pid", "block").agg(text("name"), F.coalesce(first("amount", F.col("amount") != 0), F.lit(0)).alias("amount"), text("role"))


def block_recipients(rows: DataFrame) -> DataFrame:
    """rows(pid, block, recipient, number, total, contract, line_no) -> a row a recipient of a block. total is repeated on each of its rows, so the
    largest counts, not the sum; contracts are distinct, in file order. Rows without a recipient are headings of blocks and don't count."""
    rows = rows.where("trim(recipient) <> ''").withColumn("number", F.trim(F.coalesce("number", F.lit(""))))
    key = ["pid", "block", "recipient", "number"]
    contract = rows.where("trim(contract) <> ''").groupBy(*key, "contract").agg(F.min("line_no").alias("line_no"))
    contracts = contract.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "contract"))), lambda x: x["contract"]).alias("contracts"))
    return (rows.groupBy(*key).agg(F.greatest(F.coalesce(F.max("total"), F.lit(0)), F.lit(0)).alias("amount")).join(contracts, key, "left")
            .withColumn("contracts", F.coalesce("contracts", F.array().cast("array<string>"))))


def recipient_expenses(recipients: DataFrame, expenses: DataFrame) -> DataFrame:
    """expenses(pid, block, recipient, number, category, purpose, amount) of the recipients of block_recipients(): number and sum of each one's
    expenses. An expense without that recipient in that block, or without category and purpose, doesn't count."""
    key = ["pid", "block", "recipient", "number"]
    named = expenses.where("trim(coalesce(category, '')) <> '' or trim(coalesce(purpose, '')) <> ''").withColumn("number", F.trim(F.coalesce("number", F.lit(""))))
    sums = named.groupBy(*key).agg(F.count(F.lit(1)).alias("expenses"), F.sum("amount").alias("expense_amount"))
    return recipients.join(sums, key, "left").fillna(0, ["expenses", "expense_amount"])
