"""What the pages do to their tables: predicates, facets, node search, sorts, ranks and legend slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S
from tallyspark.operators.prefix import elements, ranked
from tallyspark.plans.query import Name, pattern_fault

#: Display order of recommendations and of improvement actions, and the name of collected rests.
RECOMMENDATIONS = ("継続", "要改善", "条件付き継続", "縮小", "他事業と統合", "再設計", "終了・廃止候補")
ACTIONS = ("情報開示", "収支是正", "成果検証", "KPI改善", "執行改善", "ガバナンス改善")
OTHER_NAME, OTHER_KEY = "その他", "__other__"
#: Slider limits come in steps of 1000 oku.
OKU, STEP = 100_000_000, 1000


# ---- predicates -------------------------------------------------------------------------------------------------------


def within(rows: DataFrame, limits: dict[str, tuple]) -> DataFrame:
    """Rows inside every (low, high), ends included; None is no limit. A null fails any limit of its column."""
    for column, (low, high) in limits.items():
        if low is not None:
            rows = rows.where(F.col(column) >= low)
        if high is not None:
            rows = rows.where(F.col(column) <= high)
    return rows


def equal_to(rows: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Rows whose columns have one of the chosen values; an empty choice is none."""
    for column, values in chosen.items():
        if values:
            rows = rows.where(F.col(column).isin(list(values)))
    return rows


def folded(text: Column) -> Column:
    """Lower case, with round brackets of full width as plain ones."""
    return F.lower(F.translate(text, "（）", "()"))


def containing(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the folded text in any of the columns; blank text keeps all. Nulls contain nothing."""
    wanted = folded(F.lit(text.strip()))
    return rows.where(reduce(Column.__or__, [F.coalesce(F.contains(folded(F.col(c).cast("string")), wanted), F.lit(False)) for c in columns])) if text.strip() else rows


def any_flag(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rows with at least one of the flags set; no flags keep all."""
    return rows.where(reduce(Column.__or__, [F.coalesce(F.col(f), F.lit(False)) for f in flags])) if flags else rows


def nested_search(projects: DataFrame, blocks: DataFrame, recipients: DataFrame, text: str) -> DataFrame:
    """projects(pid, name, ministry, ...) with the text in their own columns, in a name of blocks(pid, block) or of recipients(pid, recipient)."""
    if not text.strip():
        return projects
    own = [containing(f, text, c).select("pid") for f, c in ((projects, ["pid", "name", "ministry"]), (blocks, ["block"]), (recipients, ["recipient"]))]
    return projects.join(reduce(DataFrame.unionByName, own), "pid", "left_semi")


def facets(rows: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """Values and counts of each facet among the rows that the facets before it let through; one pass for all of them. Null values aren't listed."""
    passed, entries = F.lit(True), []
    for name, value in chosen.items():
        entries.append(F.when(passed & F.col(name).isNotNull(), F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"))))
        if value is not None:
            passed = passed & F.coalesce(F.col(name) == value, F.lit(False))
    return rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n"))


def node_search(nodes: DataFrame, edges: DataFrame, text: str, regex: bool = False, ministries: tuple = (), page: int = 0, size: int = 200) -> DataFrame:
    """A page of nodes by name, or of the project by its number: id, name, type, value, sort_value, project_id, budget.

    A project's budget node is merged into its spending node and gives the id and the name. Digits alone are a project's number. Names take two
    characters at least. With ministries only their projects and those's recipients are searched. A pattern is Java's, 100 characters at most;
    a faulty one finds nothing.
    """
    wanted = text.strip()
    number = wanted.isdecimal() and wanted.isascii()
    merged = nodes.where("type <> 'project-budget'")
    budget = nodes.where("type = 'project-budget'").select("project_id", F.col("id").alias("b_id"), F.col("name").alias("b_name"), F.col("value").alias("budget"))
    spending = F.col("type") == "project-spending"
    if number:
        merged = merged.where(spending & (F.col("project_id").cast("string") == str(int(wanted))))
    elif len(wanted) < 2 or (regex and (len(wanted) > 100 or pattern_fault(wanted))):
        merged = merged.where("false")
    elif regex:
        merged = merged.where(F.col("name").rlike(Name(wanted, True).pattern))
    else:
        merged = merged.where(F.contains(F.lower("name"), F.lit(wanted.lower())))
    if ministries:
        own = nodes.where(spending & F.col("ministry").isin(list(ministries))).select("id")
        paid = edges.where(F.col("target").startswith("r-")).join(own.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
        merged = merged.join(own.unionByName(paid), "id", "left_semi")
    found = merged.join(budget.withColumn("type", F.lit("project-spending")), ["project_id", "type"], "left")
    amount = F.when(spending, F.coalesce("budget", F.lit(0)))
    return found.select(
        F.when(spending, F.coalesce("b_id", F.concat(F.lit("project-budget-"), "project_id"))).otherwise(F.col("id")).alias("id"),
        F.coalesce("b_name", "name").alias("name"), "type", "value", F.greatest("value", amount).alias("sort_value"), "project_id", amount.alias("budget"),
    ).orderBy(F.desc("sort_value"), "id").offset(page * size).limit(size)


# ---- order ------------------------------------------------------------------------------------------------------------


def display_rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place in a fixed order from 1 on; null for other values."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)).cast("int")


def sorted_page(rows: DataFrame, column: str, tie: str, descending: bool = False, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page by one column, nulls last either way. Text that is digits alone in all rows is ordered as numbers, other text by the rules of Japanese."""
    key = F.col(column)
    way = F.desc_nulls_last if descending else F.asc_nulls_last
    if dict(rows.dtypes)[column] != "string":
        return rows.orderBy(way(column), tie).offset(offset).limit(limit)
    digits = F.broadcast(rows.agg(F.coalesce(F.bool_and(key.rlike("^[0-9]+$")), F.lit(False)).alias("__digits")))  # one row
    keyed = rows.crossJoin(digits).withColumns({
        "__number": F.when(F.col("__digits"), F.expr(f"try_cast(`{column}` AS decimal(38, 0))")),
        "__text": F.when(~F.col("__digits"), F.collate(key, "ja"))})
    return keyed.orderBy(way("__number"), way("__text"), tie).offset(offset).limit(limit).select(*rows.columns)


def in_display_order(nodes: DataFrame) -> DataFrame:
    """Collected nodes last, those named as a rest before them, the others by falling value."""
    last = F.when(F.coalesce("aggregated", F.lit(False)), 2).when(F.col("name") == OTHER_NAME, 1).otherwise(0)
    return nodes.orderBy(last, F.desc("value"), "id")


def places_of(rows: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Place, from 0 on, of each wanted key when rows are ordered by falling value, then key."""
    asked = rows.sparkSession.createDataFrame([(k,) for k in set(wanted)], rows.select(key).schema)
    places = ranked(rows.select(key, value), F.desc(value), F.col(key))
    return places.join(asked, key, "left_semi").select(key, (F.col("rank") - 1).alias("place"))


# ---- scales and legends -----------------------------------------------------------------------------------------------


def slider_limits(nodes: DataFrame) -> DataFrame:
    """One row: the largest budget and the largest spending in oku, up to the next 1000, 1000 at least."""
    up = lambda kinds: F.greatest(F.lit(STEP), F.ceil(F.coalesce(F.max(F.when(F.col("type").isin(kinds), F.col("value"))), F.lit(0)) / OKU / STEP) * STEP)
    return nodes.agg(up(["project-budget"]).alias("max_budget"), up(["project-spending", "recipient"]).alias("max_spending"))


def elements_at(rows: DataFrame, column: str, places: dict[str, Column]) -> DataFrame:
    """One row: {name: place as an expression of n} as elements, from 0 on, of the sorted values that aren't null."""
    return elements(rows, column, places).drop("n")


def ticks(rows: DataFrame, column: str, at: tuple[float, ...] = (0.5, 0.9, 1.0)) -> DataFrame:
    """One row: element round(q (n - 1)) for each q, named t50, t90, t100."""
    return elements_at(rows, column, {f"t{round(q * 100)}": S.half_up((F.col("n") - 1) * q) for q in at})


def percentile_summary(rows: DataFrame, column: str, ceiling: float = 100) -> DataFrame:
    """One row: elements floor(q (n - 1)), their interquartile range, population deviation, share at the ceiling, distinct values."""
    at = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    points = elements_at(rows, column, {f"p{round(q * 100)}": F.floor((F.col("n") - 1) * F.lit(q)) for q in at}).withColumn("iqr", F.col("p75") - F.col("p25"))
    v = F.col(column).cast("double")
    return rows.agg(F.count(v).alias("n"), F.stddev_pop(v).alias("stddev"), (F.count_if(v >= ceiling) / F.nullif(F.count(v), F.lit(0))).alias("ceiling_share"),
                    F.countDistinct(v).alias("distinct")).crossJoin(points)  # one row each


def legend(rows: DataFrame, key: str, value: str, n: int = 10, slots: int = 20) -> DataFrame:
    """Slots for the keys that are among the n largest by rows or by value, by rows; the others are one entry: slot, key, n, value, members."""
    from pyspark.sql.window import Window

    sums = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))
    top = lambda c: sums.orderBy(F.desc(c), "key").limit(n).select("key")
    chosen = F.broadcast(top("n").unionByName(top("value")).distinct())  # at most 2 n keys
    order = Window.orderBy(F.desc("n"), "key")  # over those
    own = (sums.join(chosen, "key", "left_semi").orderBy(F.desc("n"), "key").limit(slots)
           .select(F.row_number().over(order).alias("slot"), "key", "n", "value", F.lit(1).cast("long").alias("members")))
    rest = sums.join(F.broadcast(own.select("key")), "key", "left_anti").agg(F.sum("n").alias("n"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("members"))
    return own.unionByName(rest.where("members > 0").select((F.lit(slots) + 1).alias("slot"), F.lit(OTHER_KEY).alias("key"), "n", "value", "members"))


def metric_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """A row a metric that has values: n, mean, element n // 2 of the sorted values, least and largest."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*")
    sums = long.where("v is not null").groupBy("metric").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    return elements(long, "v", {"median": F.floor(F.col("n") / 2)}, ("metric",)).join(sums, "metric").select("metric", "n", "mean", "median", "least", "most")


def map_points(points: DataFrame, quality: DataFrame, policy: DataFrame) -> DataFrame:
    """points(pid, x, y, cluster) that have a row in quality(pid, name, ministry, budget, executed, category), with the scores of
    policy(pid, overall, proportionality, necessity, category, recommendation) where there are any; the policy's category goes first."""
    p = policy.select("pid", "overall", "proportionality", "necessity", F.col("category").alias("__category"), "recommendation")
    return points.join(quality, "pid").join(p, "pid", "left").withColumn("category", F.coalesce("__category", "category")).drop("__category")
