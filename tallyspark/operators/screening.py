"""Scores, the policy screen against population thresholds, and highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S
from tallyspark.tables import held

from .flow import Graph
from .prefix import elements, running

# ---- mechanical scores -----------------------------------------------------------------------------------------------


def project_stats(rows: DataFrame, direct_blocks: DataFrame | None = None) -> DataFrame:
    """rows(pid, block, status, number_filled, total, amount, opaque) of named recipients -> counts and sums a project. total is the recipient's
    total where the row carries it; only blocks at the root count for the net (all of them where a project has no links)."""
    if direct_blocks is not None:
        known = direct_blocks.select("pid").distinct().withColumn("__known", F.lit(True))
        rows = (rows.join(direct_blocks.select("pid", "block", F.lit(True).alias("__root")).distinct(), ["pid", "block"], "left").join(known, "pid", "left")
                .withColumn("net", F.when(F.col("__root") | F.col("__known").isNull(), F.col("total")).otherwise(0)))
    else:
        rows = rows.withColumn("net", F.col("total"))
    n = lambda c: F.count_if(c)
    return rows.groupBy("pid").agg(
        F.count(F.lit(1)).alias("row_count"), *[n(F.col("status") == s).alias(f"{s}_count") for s in ("valid", "gov", "supp", "cn", "invalid")],
        n(F.col("number_filled")).alias("filled"), n(~F.col("number_filled")).alias("empty"), F.sum(F.coalesce("total", F.lit(0))).alias("spend_total"),
        F.sum(F.coalesce("net", F.lit(0))).alias("spend_net"), n(F.col("opaque")).alias("opaque_count"),
        F.sum(F.when(F.col("opaque"), F.coalesce("amount", F.lit(0))).otherwise(0)).alias("opaque_amount"),
        F.sum(F.coalesce("amount", F.lit(0))).alias("amount"))


def row_status(rows: DataFrame, known: DataFrame, government: DataFrame, supplement: DataFrame) -> DataFrame:
    """rows(recipient, number, verified) plus status. known(name, good) is the strict dictionary, government(name) and supplement(name) are asked
    for names that it lists as bad. A number that the register confirms rescues a name that no list knows; valid needs a number. Names are unique in
    each list; the lists are joined, and adaptive execution broadcasts those that are small."""
    name = lambda df, flag, value: df.select(F.col("name").alias("recipient"), value.alias(flag))
    joined = (rows.join(name(known, "__good", F.col("good")), "recipient", "left").join(name(government, "__gov", F.lit(True)), "recipient", "left")
              .join(name(supplement, "__supp", F.lit(True)), "recipient", "left"))
    numbered, verified = F.trim(F.coalesce("number", F.lit(""))) != "", F.coalesce("verified", F.lit(False))
    status = (F.when(F.col("__good").isNull(), F.when(verified, "cn").otherwise("unknown"))
              .when(F.col("__good"), F.when(numbered, "valid").otherwise("invalid"))
              .when(F.col("__gov"), "gov").when(F.col("__supp"), "supp").when(verified, "cn").otherwise("invalid"))
    return joined.withColumn("status", status).drop("__good", "__gov", "__supp")


def inconsistent_blocks(blocks: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Per project: blocks whose recipients' sum is off the declared amount by more than the tolerance. blocks(pid, block, declared, total)."""
    off = (F.col("declared") > 0) & (F.abs(F.col("declared") - F.coalesce("total", F.lit(0))).cast("double") / F.nullif("declared", F.lit(0)) > tolerance)
    return blocks.groupBy("pid").agg(F.count_if(off).alias("bad_blocks"))


def mechanical_scores(stats: DataFrame) -> DataFrame:
    """stats: project_stats() plus executed, depth, bad_blocks -> five axes and their weighted mean over those that exist."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    judged = c("valid_count") + c("gov_count") + c("supp_count") + c("cn_count") + c("invalid_count")
    good = judged - c("invalid_count")
    gap = (F.when(c("executed") > 0, F.abs(c("executed") - c("spend_net")) / F.nullif(c("executed"), F.lit(0.0))).when(c("spend_net") == 0, 0.0))
    opaque = (F.when(c("amount") > 0, c("opaque_amount") / F.nullif(c("amount"), F.lit(0.0)))
              .when(c("row_count") > 0, c("opaque_count") / F.nullif(c("row_count"), F.lit(0.0))).otherwise(0.0))
    axes = {
        "axis1": F.when(judged > 0, good / F.nullif(judged, F.lit(0.0)) * 100),
        "axis2": F.when(c("filled") + c("empty") > 0, c("filled") / F.nullif(c("filled") + c("empty"), F.lit(0.0)) * 100),
        "axis3": S.clamp((1 - gap) * 100, 0.0, 100.0),
        "axis4": S.clamp(100 - F.least(c("depth") * 10, F.lit(40.0)) - F.least(c("bad_blocks") * 10, F.lit(30.0)), 0.0, 100.0),
        "axis5": S.clamp((1 - opaque / 0.5) * 100, 0.0, 100.0),
    }
    axes["axis3"] = F.when(gap.isNotNull(), axes["axis3"])
    total = S.half_even(S.weighted_available([(F.col(a), w) for a, w in zip(axes, (40, 20, 20, 10, 10), strict=True)]), 1)
    return stats.withColumns(axes | {"opaque_ratio": opaque, "gap_ratio": gap}).withColumn("total_score", total)


def final_scores(scores: DataFrame) -> DataFrame:
    """scores(identify, purpose, executed, spend_net, axis4, orphan_blocks) -> budget (10 % tolerance), structure and the 28/22/15/35 mean."""
    gap = F.abs(F.col("executed") - F.col("spend_net")).cast("double") / F.nullif("executed", F.lit(0))
    budget = S.clamp(100 - F.greatest(gap - 0.1, F.lit(0.0)) / 0.9 * 100, 0.0, 100.0)
    structure = S.clamp(F.col("axis4") - F.least(F.coalesce("orphan_blocks", F.lit(0)) * 10, F.lit(30)), 0.0, 100.0)
    out = scores.withColumns({"budget": F.when(gap.isNotNull(), budget), "structure": F.when(F.col("axis4").isNotNull(), structure)})
    axes = [(F.col(a), w) for a, w in zip(("identify", "purpose", "budget", "structure"), (28, 22, 15, 35), strict=True)]
    return out.withColumn("total_score", S.half_even(S.weighted_available(axes), 1))


def weighted_mean(rows: DataFrame, key: str, score: str, weight: str) -> DataFrame:
    """Mean weighted by amounts; the plain mean where these sum to 0."""
    w = F.sum(F.when(F.col(score).isNotNull(), F.col(weight)))
    return rows.groupBy(key).agg(F.when(w > 0, F.sum(F.col(score) * F.col(weight)).cast("double") / F.nullif(w, F.lit(0))).otherwise(F.avg(score)).alias(score))


# ---- population statistics --------------------------------------------------------------------------------------------


def floor_quantile(sorted_values: Column, q: float) -> Column:
    """Element floor((n - 1) q) of a sorted array; infinite if it's empty."""
    n = F.size(sorted_values)
    return F.when(n == 0, float("inf")).otherwise(F.try_element_at(sorted_values, (F.floor((n - 1) * F.lit(q)) + 1).cast("int")))


def quantiles(rows: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: {name: (column, q)} as elements floor((n - 1) q) of the values that aren't null, by rank and not in one array."""
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"), F.col(column).cast("double").alias("v")) for name, (column, q) in wanted.items()])
    found = elements(rows.select(F.explode(each).alias("e")).select("e.*"), "v", {"at": F.floor((F.col("n") - 1) * F.col("q"))}, ("name", "q"))
    of = lambda name: F.coalesce(F.min(F.when(F.col("name") == name, F.col("at"))), F.lit(float("inf"))).alias(name)
    return found.agg(*map(of, wanted))


def percentile_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the share of smaller values among the others in percent; 100 if there's one value at most."""
    value = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    upto = running(value, [F.col(column)], {"upto": F.col("c")}, totals=True)
    less = F.col("upto") - F.col("c")
    rank = upto.withColumn(name, F.when(F.col("upto_all") <= 1, 100.0).otherwise(less / F.nullif(F.col("upto_all") - 1, F.lit(0)).cast("double") * 100)).select(column, name)
    return rows.join(rank, column, "left")


# ---- policy screen ----------------------------------------------------------------------------------------------------

#: Weights of the total, bands of its percentile, and limits.
WEIGHTS = {"design": 15, "transparency": 15, "evidence": 15, "proportionality": 35, "necessity": 20}
CRITICAL, SEVERE, CONDITIONAL, IMPROVE = 5, 10, 25, 50
MATERIAL = 100_000_000


def policy(items: DataFrame, material: int = MATERIAL) -> DataFrame:
    """items(pid, identify, purpose, budget_axis, design, evidence, proportionality, necessity (0-10), executed, budget, prior_rate, opaque_ratio, depth,
    orphan_blocks) -> scores, percentile, trend, recommendation and action. Thresholds come from the whole population: never filter first."""
    c = F.col
    to100 = lambda x: S.half_up(c(x) * 10)
    no_data = c("identify").isNull() & c("purpose").isNull()
    assess = (c("budget") > 0) & (c("executed") > 0)
    share = lambda x: S.clamp(x, 0.0, 1.0)
    d = items.withColumns({
        "transparency": F.when(no_data, F.when(c("executed") > 0, 0.0)).otherwise(S.weighted_available([(c("identify"), 55), (c("purpose"), 45)])),
        "unused_ratio": F.when(assess, share((c("budget") - c("executed")).cast("double") / F.nullif("budget", F.lit(0)))),
        "unused_amount": F.when(assess, F.greatest(c("budget") - c("executed"), F.lit(0))),
        "rate": F.when(assess, c("executed").cast("double") / F.nullif("budget", F.lit(0))),
        "prior_unused": share(1 - c("prior_rate")),
        **{f"{x}_score": to100(x) for x in ("design", "evidence", "proportionality", "necessity")},
    })
    overall = S.weighted_available([(c("transparency") if x == "transparency" else c(f"{x}_score"), w) for x, w in WEIGHTS.items()])
    d = held(d.withColumns({"overall": S.half_up(overall), "transparency": S.half_up(c("transparency")),
                       "spend_down": F.coalesce((c("rate") >= 0.95) & (c("opaque_ratio") >= 0.2), F.lit(False))}))
    limits = quantiles(d, {"t_design_critical": ("design", 0.10), "t_design_weak": ("design", 0.25), "t_evidence": ("evidence", 0.30),
                           "t_necessity": ("necessity", 0.15), "t_proportion": ("proportionality", 0.25), "t_unused": ("unused_ratio", 0.75)})
    d = percentile_rank(d, "overall", "percentile").crossJoin(F.broadcast(limits))  # one row
    trend = (F.when(~F.coalesce(c("unused_ratio") >= c("t_unused"), F.lit(False)), "normal").when(c("prior_unused").isNull(), "unknown")
             .when(c("prior_unused") >= c("t_unused"), "persistent").otherwise("single"))
    d = d.withColumn("unused_trend", trend)
    much = F.coalesce((c("unused_ratio") >= c("t_unused")) & (c("unused_amount") >= material), F.lit(False))
    p = c("percentile")
    rules = [
        ((p <= CRITICAL) & (c("necessity") <= c("t_necessity")) & (c("design") > 0) & (c("design") <= c("t_design_critical")) & c("proportionality").isNotNull(), "終了・廃止候補"),
        ((p <= SEVERE) & (c("design") <= c("t_design_weak")), "再設計"),
        (much & (c("unused_trend") == "persistent"), "縮小"),
        ((p <= CONDITIONAL) & (c("proportionality") <= c("t_proportion")), "条件付き継続"),
        (much & c("unused_trend").isin("single", "unknown"), "条件付き継続"),
        (p <= CONDITIONAL, "条件付き継続"),
        (c("spend_down"), "要改善"),
        ((p <= IMPROVE) | (c("transparency") < 60), "要改善"),
    ]
    actions = [
        (c("budget_axis") < 60, "収支是正"),
        (c("spend_down") | (c("identify") < 60) | (c("purpose") < 60) | (c("proportionality") <= c("t_proportion")), "情報開示"),
        ((F.coalesce("depth", F.lit(0)) >= 3) | (F.coalesce("orphan_blocks", F.lit(0)) > 0), "ガバナンス改善"),
        (c("evidence") <= c("t_evidence"), "成果検証"),
        (c("design") <= c("t_design_weak"), "KPI改善"),
        (c("transparency") < 75, "執行改善"),
    ]
    return d.withColumns({"recommendation": F.when(c("overall").isNotNull(), _first(rules, "継続")),
                          "action": F.when(c("overall").isNotNull(), _first(actions, None))})


def _first(rules: list[tuple[Column, str]], other: str | None) -> Column:
    """The label of the first rule that is true; null counts as not."""
    out = None
    for test, label in rules:
        out = (F.when if out is None else out.when)(F.coalesce(test, F.lit(False)), F.lit(label))
    return out.otherwise(F.lit(other))


# ---- highlights -------------------------------------------------------------------------------------------------------

LEAST_SPEND, TOP = 10**9, 10
METRICS = ("spendingChange", "otherRatio", "concentration", "lowScoreHighBudget", "execBudgetGap", "subcontractDepth")


def recipient_stats(edges: DataFrame) -> DataFrame:
    """edges(pid, id, name, amount) -> total, the amount to 'その他', the largest recipient and its amount."""
    one = edges.groupBy("pid", "id", "name").agg(F.sum("amount").alias("amount"))
    return one.groupBy("pid").agg(F.sum("amount").alias("total"), F.sum(F.when(F.col("name") == "その他", F.col("amount")).otherwise(0)).alias("other"),
                                  F.max_by("name", F.struct("amount", "id")).alias("top_name"), F.max("amount").alias("top_amount"))


def graph_stats(graph: Graph, scores: DataFrame) -> DataFrame:
    """recipient_stats() of a graph's projects that are scored, with their spend_total; collective nodes aside."""
    own = graph.nodes.where("not coalesce(aggregated, false)")
    project = own.where("type = 'project-spending'").select(F.col("id").alias("source"), F.col("project_id").alias("pid"))
    recipient = own.where("id like 'r-%'").select("id", "name")
    edges = graph.edges.where("target like 'r-%'").join(project, "source").withColumnRenamed("target", "id").join(recipient, "id")
    return recipient_stats(edges.select("pid", "id", "name", F.col("value").alias("amount"))).join(scores.select("pid", "spend_total"), "pid")


def highlights(scores: DataFrame, stats: DataFrame | None = None, changes: DataFrame | None = None, n: int = TOP) -> dict[str, DataFrame]:
    """The lists of METRICS for which there are tables, of n rows each (spendingChange: of each status), and multiSignal over them all.
    stats: recipient_stats() plus spend_total; changes: summary.spending_change()."""
    lists = {"spendingChange": changes} if changes is not None else {}
    if stats is not None:
        lists |= {"otherRatio": other_ratio(stats, n), "concentration": concentration(stats, n)}
    lists |= {"lowScoreHighBudget": low_score_high_budget(scores, n), "execBudgetGap": exec_budget_gap(scores, n), "subcontractDepth": deep_subcontracts(scores, n)}
    return lists | {"multiSignal": multi_signal(lists, scores)}


def concentration(stats: DataFrame, n: int = TOP) -> DataFrame:
    """stats plus spend_total: the projects with the largest share to one recipient."""
    share = S.half_up(F.col("top_amount").cast("double") / F.nullif("total", F.lit(0)), 4)
    return stats.where(f"total > 0 and spend_total >= {LEAST_SPEND}").withColumn("share", share).orderBy(F.desc("share"), F.desc("top_amount"), "pid").limit(n)


def other_ratio(stats: DataFrame, n: int = TOP) -> DataFrame:
    share = S.half_up(F.col("other").cast("double") / F.nullif("total", F.lit(0)), 4)
    return (stats.where(f"total > 0 and other > 0 and spend_total >= {LEAST_SPEND}").withColumn("share", share)
            .orderBy(F.desc("share"), F.desc("other"), "pid").limit(n))


def low_score_high_budget(items: DataFrame, n: int = TOP) -> DataFrame:
    """Scored projects with a budget in the lowest quarter of scores (nearest rank), by budget."""
    scored = items.where("total_score is not null and budget > 0")
    limit = scored.agg(F.expr("percentile_disc(0.25) within group (order by total_score)").alias("threshold"))
    return (scored.crossJoin(F.broadcast(limit)).where("total_score <= threshold")  # one row
            .orderBy(F.desc("budget"), "total_score", "pid").limit(n))


def exec_budget_gap(items: DataFrame, n: int = TOP) -> DataFrame:
    gap = S.half_up(F.abs(F.col("executed").cast("double") / F.nullif("budget", F.lit(0)) - 1), 4)
    return items.where("budget > 0 and executed is not null").withColumn("gap", gap).orderBy(F.desc("gap"), "pid").limit(n)


def deep_subcontracts(items: DataFrame, n: int = TOP) -> DataFrame:
    return items.where(f"spend_total >= {LEAST_SPEND} and depth > 0").orderBy(F.desc("depth"), F.desc("spend_total"), "pid").limit(n)


def multi_signal(lists: dict[str, DataFrame], budgets: DataFrame, least: int = 2, n: int = TOP) -> DataFrame:
    """Projects that are in several lists (each with pid): the metrics in their fixed order, by number and then budget."""
    marks = None
    for metric, df in lists.items():
        one = df.select("pid", F.lit(METRICS.index(metric)).alias("m"))
        marks = one if marks is None else marks.unionByName(one)
    labels = F.array(*[F.lit(m) for m in METRICS])
    return (marks.groupBy("pid").agg(F.array_sort(F.collect_set("m")).alias("m")).where(F.size("m") >= least).join(budgets.select("pid", "budget"), "pid", "left")
            .select("pid", F.transform("m", lambda i: labels[i]).alias("signals"), F.coalesce("budget", F.lit(0)).alias("budget"))
            .orderBy(F.desc(F.size("signals")), F.desc("budget"), "pid").limit(n))
