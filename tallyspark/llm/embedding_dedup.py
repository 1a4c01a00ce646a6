"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors of a label are first folded into one class. Each class lies in its nearest cell, and also, as a guest, in every
cell whose border it is so near to that a vector across it could reach the threshold: with x in cell i, y in cell j and
|x - y| <= d, y's distance to the plane between both centroids is at most d. So no pair is lost. Cells are cut into blocks of at
most BLOCK rows, and a task sees two blocks at a time. Within a pair of blocks only links to the local component's root
are emitted, never all pairs.

Defined results: vectors that are null, empty or zero or hold null or non-finite components, and those with a null label, link with
nothing; vectors of different length are never compared; rows that repeat a vec_id count as vectors of their own, and share a
row's component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .components import components

THRESHOLD = 0.93
#: Rows of the sample that centroids are fitted on, rows aimed at a cell and label, most cells, steps of k-means.
SAMPLE, CELL, MAX_CELLS, STEPS = 20_000, 4096, 1024, 8
BLOCK = 2048


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one. Each is scaled by its largest component first, so no square over- or underflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from evenly spaced starts."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(STEPS):
        home = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def usable(v) -> F.Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def joined_classes(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    return np.vstack([left[i : i + 256] @ right.T >= threshold for i in range(0, len(left), 256)])


def local_roots(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row (a) and column (b) of a link matrix reaches."""
    a, b, big = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        to_a = np.concatenate([np.where(near[i : i + 256], b, big).min(1, initial=big) for i in range(0, len(a), 256)])
        new_a = np.minimum(a, to_a)
        to_b = np.full(len(b), big)
        for i in range(0, len(a), 256):
            to_b = np.minimum(to_b, np.where(near[i : i + 256], new_a[i : i + 256, None], big).min(0, initial=big))
        new_b = np.minimum(b, to_b)
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, one row for each row."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", F.col("label").alias("label"))
    good = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"))
                      .withColumn("dim", F.size("embedding")), "vectors")
    shape = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels")).collect()
    models = {}
    for r in shape:  # a row for each vector length
        part = classes.where(F.col("dim") == r.dim).select("embedding", "cid").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE)
        sample = unit(np.array([x.embedding for x in part.collect()], float))
        k = max(2, min(MAX_CELLS, -(-r.n // (CELL * r.labels))))
        models[r.dim] = centroids(sample, min(k, len(sample)))
    reach = (2 - 2 * threshold) ** 0.5 + 1e-9
    # distances between centroids
    spans = {d: np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T, 0)) + 1e-7 for d, c in models.items()}

    def deal(batches):
        for batch in (b.slice(low, BLOCK) for b in batches for low in range(0, len(b), BLOCK)):
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                c = models[int(dim)]
                sim = unit(matrix(own.column("embedding"))) @ c.T
                home = sim.argmax(1)
                gap = sim[np.arange(len(home)), home][:, None] - sim
                row, cell = np.nonzero(gap <= reach * spans[int(dim)][home])
                out = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [out.column(x) for x in ("label", "dim", "cid", "n", "embedding")] + [pa.array(cell.astype(np.int32)), pa.array(home[row] == cell)],
                    names=["label", "dim", "cid", "n", "embedding", "cell", "home"])

    label = dict(classes.dtypes)["label"]
    element = dict(classes.dtypes)["embedding"]
    cells = written(classes.select("label", "dim", "cid", "n", "embedding").mapInArrow(
        deal, f"label {label}, dim int, cid long, n long, embedding {element}, cell int, home boolean"), "cells")
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    placed = cells.join(sizes, ["label", "dim", "cell"]).withColumn("block", block)
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    # home rows are the left side against every right block; all rows are the right side for every left block
    sides = (placed.where("home").withColumn("left", F.col("block")).withColumn("right", every).withColumn("side", F.lit(0))
             .unionByName(placed.withColumn("left", every).withColumn("right", F.col("block")).withColumn("side", F.lit(1))))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        left, right = (group.filter(pa.array(side == s)) for s in (0, 1))
        empty = pa.table({x: pa.array([], pa.int64()) for x in ("cid", "links", "root")})
        if not len(left) or not len(right):
            return empty
        ids = [t.column("cid").to_numpy() for t in (left, right)]
        near = joined_classes(*(unit(matrix(t.column("embedding").combine_chunks())) for t in (left, right)), threshold)
        near &= ids[0][:, None] != ids[1][None]
        links = np.concatenate([near[i : i + 256] @ right.column("n").to_numpy() for i in range(0, len(near), 256)])
        roots = local_roots(near, *ids)
        touched = near.any(1), near.any(0)
        return pa.table({"cid": np.concatenate([i[t] for i, t in zip(ids, touched, strict=True)]),
                         "links": np.concatenate([links[touched[0]], np.zeros(int(touched[1].sum()), np.int64)]),
                         "root": np.concatenate([r[t] for r, t in zip(roots, touched, strict=True)])})

    found = written(sides.select("label", "dim", "cell", "left", "right", "side", "cid", "n", "embedding")
                    .groupBy("label", "dim", "cell", "left", "right").applyInArrow(compare, "cid long, links long, root long"), "links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    results = (classes.select("label", "embedding", "cid", "n")  # a row for each class
               .join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
               .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
               .select("label", "embedding", F.col("n").alias("__n"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                       F.coalesce("root", "cid").alias("component_id"), "cid"))
    results = written(results, "vector-groups")
    twins = good.join(results.where("__n > 1"), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    single = results.where("__n = 1").select(F.col("cid").alias("vec_id"), "n_links", "component_id")
    bad = rows.where(~(usable(F.col("embedding")) & F.col("label").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return twins.unionByName(single).unionByName(bad)


def op8_vectors(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM v
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node AND r.root < l.b)
SELECT node AS vec_id, (SELECT COUNT(*) FROM links WHERE links.a = node) AS n_links, MIN(root) AS component_id,
       node = MIN(root) AS kept FROM reach GROUP BY node"""
