"""Answers of a bounded size: texts are cut, lists are halved until a row's JSON fits, rows keep the fields that an answer needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text and of an answer; rounds of halving. Fixed values.
TEXT, ANSWER, ROUNDS = 600, 4000, 5
#: The fields of a score that an answer has.
SCORE_FIELDS = ("pid", "name", "ministry", "bureau", "budget", "executed", "spent", "total_score", "axis_identify", "axis_purpose", "axis_budget", "axis_structure", "axis_effective",
                "identify_level", "purpose_level", "effective_level", "effective_reason", "source")


def clamped_text(text: Column, limit: int = TEXT) -> Column:
    """Trimmed and cut to limit characters, with an ellipsis where something is missing; null where nothing is left."""
    t = F.trim(text, F.lit(" \t\r\n　"))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).when(t != "", t)


def clamped_payload(rows: DataFrame, fields: list[str], lists: list[str], limit: int = ANSWER) -> DataFrame:
    """rows with their lists cut so that the JSON of fields has at most limit characters: in each of up to five rounds the first of lists that has more than one entry
    keeps its first half (rounded up). A row that is still too long then stays so."""
    out = rows
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    for _ in range(ROUNDS):
        long = F.length(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})) > limit
        first = F.when(long, F.coalesce(*[F.when(size(c) > 1, F.lit(c)) for c in lists]))
        out = out.withColumn("__cut", first)
        out = out.withColumns({c: F.when(F.col("__cut") == c, F.slice(c, F.lit(1), F.ceil(F.size(c) / 2).cast("int"))).otherwise(F.col(c)) for c in lists}).drop("__cut")
    return out


def score_projection(scores: DataFrame) -> DataFrame:
    """The fields of SCORE_FIELDS, null where the table has none; only those that it has are read."""
    return scores.select(*[F.col(c) if c in scores.columns else F.lit(None).alias(c) for c in SCORE_FIELDS])


def year_summary(summary: DataFrame) -> DataFrame:
    """Of a year's summary (see summary.totals) the counts and sums, without lists and shares."""
    return summary.select("project_count", "budget_total", "spending_total", "recipient_count")
