"""Budget books: groups, gross and net totals, transfers, funding, and the roll-up of a hierarchy with "others" nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.tables import held

LEVELS = ("ministry", "organization", "sub_account", "section", "item")
ROOT, OTHERS, PASS = "total", "__others__", "__pass__"


def groups(items: DataFrame, keys: list[str]) -> DataFrame:
    """Count and amount by each key alone, in one pass: by, name, n, amount."""
    label = reduce(lambda c, k: c.when(F.grouping(k) == 0, F.lit(k)), keys[1:], F.when(F.grouping(keys[0]) == 0, F.lit(keys[0])))
    return (items.groupingSets([[k] for k in keys], *keys)
            .agg(label.alias("by"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
            .select("by", F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("name"), "n", "amount"))


def account_summary(rows: DataFrame) -> DataFrame:
    """rows(account, sub_account, side revenue|expenditure, transfer_in, transfer_out, amount) -> per special account: sub-accounts, revenue,
    expenditure, transfers in and out, the share of own revenue (0 without revenue)."""
    s = lambda test: F.coalesce(F.sum(F.when(test, F.col("amount"))), F.lit(0))
    revenue = F.col("side") == "revenue"
    out = rows.groupBy("account").agg(
        F.countDistinct("sub_account").alias("sub_accounts"), s(revenue).alias("revenue"), s(~revenue).alias("expenditure"),
        s(revenue & F.col("transfer_in")).alias("transfer_in"), s(~revenue & F.col("transfer_out")).alias("transfer_out"))
    own = (F.col("revenue") - F.col("transfer_in")).cast("double") / F.nullif("revenue", F.lit(0))
    return out.withColumn("own_rate", F.when(F.col("revenue") > 0, own).otherwise(0.0))


def net_totals(totals: DataFrame) -> DataFrame:
    """gross less what special accounts and sub-accounts receive from each other."""
    return totals.withColumn("net", F.col("gross") - F.col("received_by_special") - F.col("received_between_sub_accounts"))


def longest_match(rows: DataFrame, name: str, accounts: DataFrame, suffix: str = "特別会計") -> DataFrame:
    """rows plus the account whose name (with suffix) is in a line's name, the longest first. accounts(account) is a list of some dozen names,
    sent to each task as long as Spark's broadcast limit allows."""
    pairs = rows.withColumn("__row", F.monotonically_increasing_id())
    hit = pairs.join(accounts.select(F.col("account").alias("__account")), F.col(name).contains(F.concat("__account", F.lit(suffix))), "left")
    best = F.max_by("__account", F.struct(F.length("__account"), "__account")).alias("account")
    return hit.groupBy("__row").agg(best, *[F.first(c).alias(c) for c in rows.columns]).drop("__row")


def reconciled(sent: DataFrame, received: DataFrame) -> DataFrame:
    """sent(account, amount), received(account, amount) -> both and the difference, for every account of either."""
    s = sent.groupBy("account").agg(F.sum("amount").alias("sent"))
    r = received.groupBy("account").agg(F.sum("amount").alias("received"))
    both = s.join(r, "account", "full_outer").fillna(0, ["sent", "received"])
    return both.withColumn("difference", F.col("sent") - F.col("received"))


def differing(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose sums differ between two forms of one table, as a CSV and the JSON made of it; what one of them lacks is missing, not 0."""
    total = lambda df, name: df.groupBy(*keys).agg(F.sum(value).alias(name))
    return total(ours, "ours").join(total(theirs, "theirs"), keys, "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs")))


def funding(accounts: DataFrame) -> DataFrame:
    """accounts(account, revenue, transfer_in, sent_by_general) -> from the general account, from others, own."""
    general = F.least("sent_by_general", "transfer_in")
    return accounts.withColumns({"from_general": general, "from_other": F.greatest(F.col("transfer_in") - general, F.lit(0)),
                                 "own": F.col("revenue") - F.col("transfer_in")})


def overview_links(t: DataFrame) -> DataFrame:
    """One row of totals (general_revenue, general_expenditure, to_special, special_own, special_expenditure) -> links of the overview: sources,
    transfer, expenditure, and what closes a surplus or shortfall; none of value 0."""
    g, x = F.col("general_revenue"), F.col("general_expenditure")
    s, y = F.col("special_own") + F.col("to_special"), F.col("special_expenditure")
    rows = [("revenue", "general", g), ("general", "special", F.col("to_special")), ("general", "expenditure", x - F.col("to_special")),
            ("own-revenue", "special", F.col("special_own")), ("special", "expenditure", F.least(s, y)), ("special", "surplus", s - y),
            ("shortfall", "special", y - s), ("general", "surplus", g - x), ("shortfall", "general", x - g)]
    link = F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), v.cast("long").alias("value")) for a, b, v in rows]))
    return t.select(link.alias("l")).select("l.*").where("value > 0")


def top_with_other(rows: DataFrame, name: str, value: str, n: int, least_share: float = 0.0) -> DataFrame:
    """The n largest that have at least a share of all; the rest as one row named その他."""
    whole = rows.agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n"))
    share = F.col(value).cast("double") / F.nullif("__sum", F.lit(0))
    top = rows.orderBy(F.desc(value), name).limit(n).crossJoin(F.broadcast(whole)).where(share >= least_share)  # n rows, one row
    rest = top.agg(F.coalesce(F.sum(value), F.lit(0)).alias("__top"), F.count(F.lit(1)).alias("__k")).crossJoin(whole).where("__n > __k").select(
        F.lit("その他").alias(name), (F.col("__sum") - F.col("__top")).alias(value), (F.col("__n") - F.col("__k")).alias("members"))
    own = top.select(name, F.col(value), F.lit(1).cast("long").alias("members"))
    return own.unionByName(rest).groupBy(name).agg(F.sum(value).alias(value), F.sum("members").alias("members"))


# ---- hierarchy --------------------------------------------------------------------------------------------------------


def paths(items: DataFrame, levels=LEVELS) -> DataFrame:
    """items plus path_1 .. path_n: the way from the root. A level without a label is passed through."""
    path: Column = F.lit(ROOT)
    cols = {}
    for i, level in enumerate(levels, 1):
        label = F.nullif(F.trim(F.coalesce(F.col(level).cast("string"), F.lit(""))), F.lit(""))
        path = F.concat(path, F.lit(">"), F.coalesce(label, F.lit(f"{PASS}{level}")))
        cols[f"path_{i}"] = path
    return items.withColumns(cols)


def rolled_up(items: DataFrame, levels=LEVELS) -> DataFrame:
    """level (0 is the root), id, parent, amount, n of every prefix, by one ROLLUP."""
    p = [f"path_{i}" for i in range(1, len(levels) + 1)]
    r = paths(items, levels).rollup(*p).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    depth = sum((F.when(F.col(x).isNotNull(), 1).otherwise(0) for x in p), F.lit(0))
    cols = F.array(F.lit(ROOT), *[F.col(x) for x in p])
    return r.withColumn("level", depth).select(
        "level", F.element_at(cols, F.col("level") + 1).alias("id"), F.when(F.col("level") > 0, F.element_at(cols, F.col("level"))).alias("parent"),
        "amount", "n")


def hierarchy(items: DataFrame, top: dict[str, int], per_column: int = 40, levels=LEVELS) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the view: each parent's largest children, then each column's largest nodes; what is left out is one node a column, with
    its amount, fed from the nearest kept ancestor or that column's own other node. Nodes that pass through are no node to leave out."""
    tree = held(rolled_up(items, levels))
    kept = tree.where("level = 0").select("id")
    passing = F.col("id").contains(f">{PASS}") & F.element_at(F.split("id", ">"), -1).startswith(PASS)
    every = None
    for i, level in enumerate(levels, 1):
        children = tree.where(F.col("level") == i).join(kept.select(F.col("id").alias("parent")), "parent", "left_semi")
        ranked = children.withColumns({"pass": passing, "rank": F.row_number().over(
            Window.partitionBy("parent", passing).orderBy(F.desc("amount"), "id"))})
        if level in top:
            ranked = ranked.where((F.col("rank") <= top[level]) | F.col("pass"))
        kept = held(ranked.select("id", "parent", "level", "amount", "n", "pass"))
        every = kept if every is None else every.unionByName(kept)
    # the columns' limits, from the left: a node also falls with its parent
    alive, out = tree.where("level = 0").select("id"), None
    place = F.row_number().over(Window.partitionBy("level", "pass").orderBy(F.desc("amount"), "id"))
    limited = every.withColumn("fits", F.col("pass") | (place <= per_column))
    for i in range(1, len(levels) + 1):
        alive = held(limited.where(F.col("level") == i).where("fits").join(alive.select(F.col("id").alias("parent")), "parent", "left_semi")
                     .select("id", "parent", "level", "amount", "n", "pass"))
        out = alive if out is None else out.unionByName(alive)
    nodes = tree.where("level = 0").select("id", "parent", "level", "amount", "n").withColumn("pass", F.lit(False)).unionByName(out)
    dropped = tree.where("level > 0").withColumn("pass", passing).join(nodes.select("id"), "id", "left_anti").where("not pass")
    labels = F.array(F.lit(ROOT), *[F.lit(x) for x in levels])
    other = dropped.groupBy("level").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    other_id = lambda lv: F.concat(F.lit(OTHERS), F.element_at(labels, lv + 1))
    # the nearest ancestor that is kept or isn't a pass
    up = dropped.select("id", "level", "amount", F.col("parent").alias("at"), (F.col("level") - 1).alias("at_level"))
    for _ in levels:
        state = up.join(nodes.select(F.col("id").alias("at"), F.lit(True).alias("is_kept")), "at", "left").withColumn("is_kept", F.coalesce("is_kept", F.lit(False)))
        move = ~F.col("is_kept") & F.element_at(F.split("at", ">"), -1).startswith(PASS)
        up = state.withColumns({"at": F.when(move, F.regexp_replace("at", ">[^>]*$", "")).otherwise(F.col("at")),
                                "at_level": F.col("at_level") - F.when(move, 1).otherwise(0)}).drop("is_kept")
    state = up.join(nodes.select(F.col("id").alias("at"), F.lit(True).alias("is_kept")), "at", "left")
    links = (nodes.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"), F.col("amount").alias("value"))
             .unionByName(state.groupBy(F.when(F.col("is_kept"), F.col("at")).otherwise(other_id(F.col("at_level"))).alias("source"),
                                        other_id(F.col("level")).alias("target")).agg(F.sum("amount").alias("value"))))
    all_nodes = nodes.select("id", "level", "amount", "n", F.lit(False).alias("aggregated")).unionByName(
        other.select(other_id(F.col("level")).alias("id"), "level", "amount", "n", F.lit(True).alias("aggregated")))
    return all_nodes, links


def related(links: DataFrame, node: str, rounds: int = 6) -> DataFrame:
    """id of a node, its ancestors and its descendants in a layered graph of at most so many layers."""
    spark = links.sparkSession
    start = spark.createDataFrame([(node,)], "id string")
    found = start
    for a, b in (("source", "target"), ("target", "source")):
        front = start
        for _ in range(rounds):
            front = held(links.join(front, links[a] == front["id"], "left_semi").select(F.col(b).alias("id")).distinct())
            if front.isEmpty():
                break
            found = found.unionByName(front)
    return found.distinct()


def focused(nodes: DataFrame, links: DataFrame, node: str, layers: int = 6) -> DataFrame:
    """Links on the ways through a node, reweighted: upstream in proportion to its share, downstream to what reaches a shared node.
    nodes(id, level, amount), links(source, target, value)."""
    level = nodes.select("id", "level").distinct()
    centre = nodes.where(F.col("id") == node)
    out, share = None, centre.select("id", F.lit(1.0).alias("share"), F.col("amount").cast("double").alias("flow"))
    own = share
    for _ in range(layers):  # down
        step = links.join(own.select(F.col("id").alias("source"), "share"), "source").withColumn("value", F.col("value") * F.col("share"))
        out = step.select("source", "target", "value") if out is None else out.unionByName(step.select("source", "target", "value"))
        reach = step.groupBy(F.col("target").alias("id")).agg(F.sum("value").alias("flow"))
        own = held(reach.join(nodes.select("id", F.col("amount").cast("double").alias("amount")), "id")
                   .select("id", F.least(F.lit(1.0), F.col("flow") / F.nullif("amount", F.lit(0.0))).alias("share"), "flow"))
        if own.isEmpty():
            break
    own = share
    for _ in range(layers):  # up: each parent gives the part that its link has of what the node takes in
        into = links.join(own.select(F.col("id").alias("target"), "flow"), "target")
        whole = links.groupBy("target").agg(F.sum("value").alias("whole"))
        step = into.join(whole, "target").withColumn("value", F.col("flow") * F.col("value") / F.nullif("whole", F.lit(0)))
        out = out.unionByName(step.select("source", "target", "value"))
        own = held(step.groupBy(F.col("source").alias("id")).agg(F.sum("value").alias("flow")).withColumn("share", F.lit(1.0)))
        if own.isEmpty():
            break
    return out.groupBy("source", "target").agg(F.sum("value").alias("value"))


def history(items: DataFrame, identity: list[str], wanted: dict) -> DataFrame:
    """Amounts of one line over the years, a column a budget type."""
    for c in identity:
        items = items.where(F.col(c).eqNullSafe(wanted.get(c)))
    return items.groupBy("year").pivot("budget_type").agg(F.sum("amount")).orderBy("year")
