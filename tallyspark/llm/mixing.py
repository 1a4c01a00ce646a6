"""Mixing sources to target weights.

Words are counted per source, targets are the weighted shares of all words with a limit on repetition, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the fraction.

Defined results: a null or blank text has size 0; a null source is a source of its own (last in order); a source
without words has target 0 and rate 0; an empty table gives an empty result; rows that repeat a doc_id get the same
coin. Input columns that are named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Target rows up to this number are broadcast; beyond it the join is a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes(source, source_size), one row a source -> plus weight, target.

    With the sources ordered by limit over weight, the shared level is the largest
    (total - limits of those before) / (weights from here on); a target is the lower of weight x level and its limit.
    The windows are over one row per source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1,
                             F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * max_repeat
    before = (Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    rest = (Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
            .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    every = Window.partitionBy()
    return (sizes.withColumn("weight", w)
            .withColumn("__level", (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0)))
                        .cast("double") / F.sum("weight").over(rest))
            .withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.max("__level").over(every)))
            .drop("__level"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text, source, ...) -> docs plus size, source_size, target and copies (how often the mix takes it)."""
    made = ("size", "source_size", "target", "copies", "weight")
    sized = docs.drop(*made).withColumn("size", word_count(F.col("text")))
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat),
                      "mix-targets").withColumnRenamed("source", "__source")
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("__source")), "left")
    else:
        salted = targets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = (sized.withColumn("__mine", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int"))
                  .join(salted, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__mine") == F.col("__salt")),
                        "left").drop("__mine", "__salt"))
    rate = F.when(F.col("source_size") > 0,
                  F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    coin = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                                             F.lit(":" + seed))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    copies = F.floor("__rate") + F.when(coin < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return joined.withColumn("__rate", rate).withColumn("copies", copies.cast("long")).drop("__source", "__rate", "weight")


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    taken = mix(docs.withColumns({f"__own_{c}": F.col(c) for c in docs.columns}), **options)
    return (taken.where("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1, cast(copies as int))")))
            .select(*[F.col(f"__own_{c}").alias(c) for c in docs.columns]))


def op4_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL_TARGETS = r"""
sized AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
          FROM {docs}),
sources AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
                       WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources),
levels AS (SELECT *, CAST(SUM(source_size) OVER () - COALESCE(SUM(source_size * 3) OVER (
               ORDER BY source_size * 3 / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS DOUBLE) / SUM(weight) OVER (ORDER BY source_size * 3 / weight, source ASC NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (SELECT source, source_size,
                   LEAST(CAST(source_size * 3 AS DOUBLE), weight * MAX(level) OVER ()) AS target FROM levels),
rated AS (SELECT s.doc_id, s.size, t.source_size, t.target, s.source,
                 CASE WHEN t.source_size > 0 THEN LEAST(3.0::DOUBLE, t.target / t.source_size) ELSE 0 END AS rate,
                 CAST(('0x' || substr(md5(COALESCE(CAST(s.doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 13)) AS BIGINT)
                 / 4503599627370496.0::DOUBLE AS coin
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""
OP4_SQL = "WITH " + SQL_TARGETS.format(docs="documents") + """
SELECT doc_id, size, source_size, target,
       CAST(size * (FLOOR(rate) + CASE WHEN coin < rate - FLOOR(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated"""
