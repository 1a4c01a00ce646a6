"""Judged rows and benchmark runs: a rule-based judge of spending rows, votes of several runs, readiness for review, differences to a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S

#: Contract texts that say nothing, axes of a vote, limits of readiness and of a large difference.
GENERIC = "業務委託|委託業務|請負|物品購入|役務|その他|一式|—|-|不明"
AXES = ("design", "evidence", "proportionality", "necessity")
MISSING, READY, READY_SCORE, LARGE = 1, 3, 75, 20


def judged_rows(rows: DataFrame) -> DataFrame:
    """rows(name, contract, role, has_number, status, opaque) plus identify and purpose of 0 to 3. Equal rows are judged once: the texts are folded
    to distinct ones first and the judgement is joined back by a digest. Null texts count as empty, null flags as false."""
    text = lambda c: F.trim(S.nfkc(F.coalesce(c, F.lit(""))))
    key = S.text_key(*[F.col(c) for c in ("name", "contract", "role", "has_number", "status", "opaque")])
    keyed = rows.withColumn("__key", key)
    once = keyed.select("__key", "contract", "role", "has_number", "status", "opaque").dropDuplicates(["__key"])
    once = once.withColumns({"__c": text(F.col("contract")), "__r": text(F.col("role"))})
    c, r, status = F.col("__c"), F.col("__r"), F.coalesce("status", F.lit(""))
    longer = F.when(F.length(c) >= F.length(r), c).otherwise(r)
    identify = (F.when(F.coalesce("opaque", F.lit(False)), 0).when((status == "valid") & F.coalesce("has_number", F.lit(False)), 3)
                .when(status.isin("valid", "gov", "supp"), 2).when(status == "invalid", 1)
                .when((F.length(c) >= 12) | (F.length(r) >= 8), 2).otherwise(1))
    purpose = (F.when((longer == "") | longer.rlike(f"^({GENERIC})$"), 0).when(F.length(longer) < 8, 1).when(F.length(longer) < 20, 2).otherwise(3))
    return keyed.join(once.select("__key", identify.alias("identify"), purpose.alias("purpose")), "__key").drop("__key")


def combined_votes(votes: DataFrame) -> DataFrame:
    """votes(pid, vote_no, the axes, category, reason) -> a row a project: means to two places of the axes that more than half of the votes have,
    the most frequent category (the earliest on ties), the reason of the vote nearest to the mean design. A single vote is taken as it is.
    Projects of several votes without a design mean are left out, as they count as not judged."""
    n = F.count(F.lit(1))
    mean = lambda a: F.when(n == 1, F.max(a).cast("double")).when(F.count(a) * 2 > n, F.bround(F.avg(F.col(a).cast("double")), 2)).alias(a)
    means = votes.groupBy("pid").agg(n.alias("votes"), *[mean(a) for a in AXES]).where("design is not null or votes = 1")
    said = votes.where("category is not null and category <> ''").groupBy("pid", "category").agg(F.count(F.lit(1)).alias("k"), F.min("vote_no").alias("first"))
    category = said.groupBy("pid").agg(F.min_by("category", F.struct((-F.col("k")).alias("o"), "first")).alias("category"))
    gap = F.abs(F.coalesce(F.col("v.design"), F.lit(0)) - F.coalesce(F.col("m.design"), F.lit(0.0)))
    reason = votes.alias("v").join(means.alias("m"), F.col("v.pid") == F.col("m.pid")).groupBy(F.col("v.pid").alias("pid")).agg(
        F.min_by("v.reason", F.struct(gap.alias("gap"), F.col("v.vote_no").alias("no"))).alias("reason"))
    return means.join(category, "pid", "left").join(reason, "pid")


def readiness(rows: DataFrame) -> DataFrame:
    """rows(design, evidence) of 0 to 4 plus their points of 0 to 100, the mean of both and a status."""
    d, e = F.col("design") * 25, F.col("evidence") * 25
    score = (d + e) / 2
    status = (F.when(F.col("evidence") <= MISSING, "EVIDENCE_MISSING").when((F.col("evidence") >= READY) & (score >= READY_SCORE), "READY_FOR_REVIEW")
              .otherwise("NEEDS_ADDITIONAL_EVIDENCE"))
    return rows.withColumns({"design_score": d, "evidence_score": e, "readiness_score": score, "status": status})


def _delta() -> Column:
    return F.col("design") * 25 - F.col("current")


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """rows(pid, cohort, design, evidence, current) -> a row a cohort and one of all (cohort null): n, mean current and design points, mean absolute
    difference (those with a current score), mean evidence."""
    known = F.col("current").isNotNull()
    sums = [F.count(F.lit(1)).alias("n"), F.avg("current").alias("current"), F.avg(F.when(known, F.col("design") * 25)).alias("design"),
            F.avg(F.abs(_delta())).alias("mae"), F.avg("evidence").alias("evidence")]
    return rows.groupBy("cohort").agg(*sums).unionByName(rows.agg(*sums).withColumn("cohort", F.lit(None).cast("string")))


def benchmark_outliers(rows: DataFrame, large: float = LARGE) -> DataFrame:
    """Rows that are at least so far from their current score, the farthest first."""
    return rows.withColumn("delta", _delta()).where(F.abs("delta") >= large).orderBy(F.desc(F.abs("delta")), "pid")


#: Words of benefit, numbers with their units.
BENEFITS = "国民|生活|住民|安全|安心|防止|削減|向上|改善|支援|促進|普及|確保|育成|雇用|健康|医療|福祉|教育|防災|環境|被害|負担軽減|効率化|競争力|地域|経済成長"
NUMBERS = r"[0-9０-９]+\s*(%|％|割|件|人|社|億|兆|万|年|か月|箇所|地域)"


def effects(rows: DataFrame) -> DataFrame:
    """rows(purpose, issues, overview, ...) plus effective, 0 to 10, by rules: 0 where purpose and overview are under 20 characters; else 3, and 2 more each for 60 characters, for two and for
    four different words of benefit, and 1 for a number with a unit. Null texts are empty."""
    text = lambda c: F.trim(S.folded(F.coalesce(F.col(c), F.lit(""))))
    t = rows.withColumns({f"__{c}": text(c) for c in ("purpose", "issues", "overview")})
    body = F.length("__purpose") + F.length("__overview")
    whole = F.concat_ws("\n", "__purpose", "__overview", "__issues")
    hits = F.size(F.array_distinct(F.regexp_extract_all(whole, F.lit(f"({BENEFITS})"), 1)))
    t = t.withColumns({"__hits": hits, "__number": whole.rlike(NUMBERS)})
    points = F.lit(3) + F.when(body >= 60, 2).otherwise(0) + F.when(F.col("__hits") >= 2, 2).otherwise(0) + F.when(F.col("__hits") >= 4, 2).otherwise(0) + F.col("__number").cast("int")
    return t.withColumn("effective", F.when(body < 20, 0).otherwise(F.least(F.lit(10), points))).drop("__purpose", "__issues", "__overview", "__hits", "__number")
