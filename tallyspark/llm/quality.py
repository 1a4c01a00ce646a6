"""Quality classifier by importance resampling.

Two generative models, bags of hashed uni- and bigrams, are counted: one over the target (documents labelled good and not
toxic), one over all raw text. A document's log importance weight is its mean log ratio of both models, at a common
length of LENGTH n-grams, so long documents don't win by length. Gumbel noise, seeded by the document's id, is added
and the k largest keys are taken: sampling without replacement in proportion to the weights.

k isn't a share fixed beforehand: it's the number of documents whose weight reaches the level that separates the labels best.
The target model is fitted on one half of the labelled sample and the level found on the other. The labelled sample holds at
most LABELLED rows (those with the smallest hashes); counts and scores cover every document.

Defined results: a text without words (null, empty, blank) has a null weight and isn't taken; a doc_id that is labelled more than
once has its worst labels; without labels of both kinds every text with words is taken; rows that repeat a doc_id and text share
their key; a null doc_id is never labelled; an empty table gives an empty result. Keys tied with the k-th are all taken.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

LABELLED = 50_000
BUCKETS, LENGTH, PRIOR, SEED = 1 << 16, 64.0, 1.0, 17
#: A good document lost weighs as much as so many bad ones kept; bins of a step in finding the cut.
LOSS, BINS = 4.0, 1024
#: Word hashes that a worker keeps.
CACHE = 200_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Grams:
    """Buckets of a text's n-grams: unigrams in the lower half, bigrams in the upper."""

    def __init__(self) -> None:
        self.known: dict[str, list[int]] = {}

    def word(self, chunk: str) -> list[int]:
        if len(self.known) >= CACHE:
            self.known.clear()
        ids = self.known[chunk] = [zlib.crc32(t.encode("utf-8", "replace")) for t in TOKEN.findall(chunk)]
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        ids: list[int] = []
        known, word = self.known.get, self.word
        for chunk in text.lower().split() if text else ():
            ids += known(chunk) or word(chunk)
        a = np.array(ids, np.uint64)
        two = ((a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(BUCKETS)
        return np.concatenate([a % np.uint64(BUCKETS), two + np.uint64(BUCKETS)]).astype(np.int64)


def labelled(labels: DataFrame, limit: int = LABELLED) -> dict[int, tuple[bool, bool]]:
    """doc_id -> (good, for fitting) of at most limit labelled rows."""
    h = F.xxhash64("doc_id", F.lit(SEED))
    rows = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
            .select("doc_id", ((F.col("quality") > 0) & (F.col("toxic") == 0)).alias("good"), h.alias("h"))
            .orderBy("h", "doc_id").limit(limit).collect())
    return {r.doc_id: (r.good, r.h % 2 == 0) for r in rows}


def fitted(docs: DataFrame, known: dict[int, tuple[bool, bool]]) -> np.ndarray:
    """Log ratio of the target's model to the raw text's for each bucket."""
    target = docs.sparkSession.sparkContext.broadcast({k for k, (good, fit) in known.items() if good and fit})

    def count(batches):
        grams, raw, own = Grams(), np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low in range(0, len(ids), 256):
                lists = [grams(t.as_py()) for t in batch.column(1)[low : low + 256]]
                raw += np.bincount(np.concatenate(lists), minlength=2 * BUCKETS)
                if mine := [x for i, x in zip(ids[low : low + 256], lists, strict=True) if i in target.value]:
                    own += np.bincount(np.concatenate(mine), minlength=2 * BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(own[at])], names=["bucket", "raw", "own"])

    rows = (docs.select("doc_id", "text").mapInArrow(count, "bucket int, raw long, own long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toPandas())  # 2 x BUCKETS rows at most
    ratio = np.zeros(2 * BUCKETS)
    for low in (0, BUCKETS):
        part = rows[(rows.bucket >= low) & (rows.bucket < low + BUCKETS)]
        n = part.own.sum()
        if n:
            p = part.raw.to_numpy() / part.raw.sum()
            ratio[part.bucket] = np.log((part.own.to_numpy() + PRIOR * n * p) / (n * (1 + PRIOR) * p))
    return ratio


def weigher(docs: DataFrame, ratio: np.ndarray):
    """A UDF from text to its log importance weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def weight(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for batch in batches:
            lists = (grams(t.as_py()) for t in batch)
            yield pa.array([LENGTH * float(shared.value[x].mean()) if len(x) else None for x in lists], pa.float64())

    return weight


def gumbel(doc_id: Column, seed: Column | int = SEED) -> Column:
    mark = F.concat(F.lit("gumbel-"), (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"))
    u = (F.pmod(F.xxhash64(doc_id, mark), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def level(scored: list[tuple[float, bool]]) -> float:
    """The weight that separates good (at or above) from bad rows best, halfway to the next below."""
    good, bad = sum(g for _, g in scored), sum(not g for _, g in scored)
    if not good or not bad:
        return -math.inf
    best, at, lost, caught = 0.0, -math.inf, 0, 0
    scored = sorted(scored)
    for i, (w, g) in enumerate(scored):
        lost, caught = lost + g, caught + (not g)
        after = scored[i + 1][0] if i + 1 < len(scored) else math.inf
        # losing good documents counts LOSS times as much as keeping bad ones
        if after > w and caught / bad - LOSS * lost / good > best:
            best, at = caught / bad - LOSS * lost / good, (w + after) / 2
    return at


def cut(keys: DataFrame, k: int) -> float:
    """The k-th largest key, by counts in ever finer bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    for _ in range(12):
        step = (high - low) / BINS
        if not step or low + step == low:
            break
        bins = (keys.where(F.col("key").between(low, high))
                .groupBy(F.least(F.floor((F.col("key") - low) / step), F.lit(BINS - 1)).cast("int").alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
        for b in sorted(bins, key=lambda b: -b.bin):
            if above + b.n >= k:
                low, high, last = b.low, b.high, b.n
                break
            above += b.n
        if low == high or above + last == k:
            break
    return low


def scored(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, seed: int = SEED, whole: bool = False) -> tuple[DataFrame, float]:
    """(a written table of doc_id, weight, key of each row, the cut). whole: with the columns of docs, as own_0, own_1 ..."""
    known = labelled(labels, limit)
    weight = weigher(docs, fitted(docs, known))
    kept = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)] if whole else []
    keys = written(docs.select("doc_id", weight("text").alias("weight"), *kept).withColumn("key", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")
    spark = docs.sparkSession
    held = [(i, good) for i, (good, fit) in known.items() if not fit]
    least = -math.inf
    if held and any(g and f for g, f in known.values()):
        marks = spark.createDataFrame(held, "doc_id long, good boolean")
        least = level([tuple(r) for r in keys.where("weight is not null").join(F.broadcast(marks), "doc_id")
                       .groupBy("doc_id").agg(F.min("weight"), F.first("good")).drop("doc_id").collect()])
    k = keys.where(F.col("weight") >= least).count()
    return keys, cut(keys.select("key").where("key is not null"), k) if k else math.inf


def taken(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, seed: int = SEED) -> DataFrame:
    """The rows of docs that the sample takes, unchanged. They are read twice, for the counts and for the weights, beside which they are kept."""
    keys, least = scored(docs, labels, limit, seed, whole=True)
    return keys.where(F.col("key") >= least).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    keys, least = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return keys.where(F.col("key") >= least).select("doc_id", F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"),
                                                    F.lit(True).alias("kept"))
