"""A policy's decision from judged axes: evidence gate, three weighted scores, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S

#: Weights of the effect (axes of 0 to 4) and of the abolition priority, and the limits.
EFFECT = {"outcome": 35, "causal": 25, "cost": 20, "durability": 20}
PRIORITY = {"effect": 30, "value": 25, "alternative": 15, "duplication": 15, "cost": 10, "obsolescence": 5}
READINESS, CONFIDENCE = 3, 0.7
ABOLISH, REDUCE, GOOD = 70, 50, 70


def decisions(rows: DataFrame, value_axes: list[str]) -> DataFrame:
    """rows(readiness, confidence, the axes of EFFECT, alternative, duplication, obsolescence, legal, value axes <v> with flags <v>_applies).

    Adds effect_score, value_score, priority_score, recommendation, human_decision. A score is null if any of its axes is; the value score counts
    the axes that apply, and is null if none does. Without evidence, or with any part missing, there is no priority.
    """
    c = lambda name: F.col(name).cast("double")
    tenth = lambda total: S.half_up(total * 10) / 10
    effect = tenth(sum((c(a) * 25 * w for a, w in EFFECT.items()), F.lit(0.0)) / sum(EFFECT.values()))
    applies = lambda v: F.coalesce(F.col(f"{v}_applies"), F.lit(False))
    # an axis that doesn't apply counts nothing; one that applies and is null makes the sum null
    value = tenth(sum((F.when(applies(v), c(v) * 25).otherwise(0.0) for v in value_axes), F.lit(0.0)) / F.nullif(sum((applies(v).cast("int") for v in value_axes), F.lit(0)), F.lit(0)))
    parts: dict[str, Column] = {"effect": 100 - F.col("effect_score"), "value": 100 - F.col("value_score"), "alternative": c("alternative") * 25,
                                "duplication": c("duplication") * 25, "cost": 100 - c("cost") * 25, "obsolescence": c("obsolescence") * 25}
    gate = F.coalesce((F.col("readiness") >= READINESS) & (F.col("confidence") >= CONFIDENCE), F.lit(False))
    priority = F.when(gate, tenth(sum((parts[p] * w for p, w in PRIORITY.items()), F.lit(0.0)) / sum(PRIORITY.values())))
    p, legal = F.col("priority_score"), F.coalesce("legal", F.lit(False))
    name = (F.when(p.isNull(), "EVIDENCE_REQUIRED")
            .when(legal, F.when(p >= REDUCE, "REFORM_LEGAL_SCHEME").otherwise("CONTINUE_WITH_IMPROVEMENT"))
            .when(p >= ABOLISH, "ABOLITION_CANDIDATE").when(p >= REDUCE, "REDUCE_OR_RESTRUCTURE")
            .when((F.col("effect_score") >= GOOD) & (F.col("value_score") >= GOOD), "CONTINUE").otherwise("CONTINUE_WITH_IMPROVEMENT"))
    return (rows.withColumns({"effect_score": effect, "value_score": value}).withColumn("priority_score", priority).withColumn("recommendation", name)
            .withColumn("human_decision", p.isNull() | legal | (F.col("recommendation") == "ABOLITION_CANDIDATE")))
