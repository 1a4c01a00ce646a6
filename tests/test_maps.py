"""The plane of vectors: neighbours by cells, the spectral layout, its accuracy; equal, null and zero vectors."""

import math
import random

import numpy as np

from tallyspark.operators import stats
from tallyspark.plans import catalog


def vectors(spark, n=60):
    r = np.random.default_rng(3)
    rows = [(i, (np.eye(6)[i % 3 * 2] + r.normal(scale=0.15, size=6)).tolist(), i % 3) for i in range(n)]
    return spark.createDataFrame(rows + [(n, rows[0][1], 0), (n + 1, None, 1), (n + 2, [0.0] * 6, 2)], "id long, e array<double>, label int")


def test_neighbours(spark):
    t = vectors(spark)
    edges = stats.near_in_cells(t, "id", "e", k=4).collect()
    label = {r.id: r.label for r in t.collect()}
    assert len(edges) >= 200 and all(e.a != e.b and 0 < e.w <= 1 + 1e-9 for e in edges) and not {e.a for e in edges} & {60, 61, 62}
    assert sum(label[e.a] == label[e.b] for e in edges) > 0.9 * len(edges)
    assert {e.a for e in stats.near_in_cells(t, "id", "e", k=4, cell=10).collect()} <= set(range(60))  # in blocks
    assert stats.near_in_cells(t.limit(0), "id", "e").count() == 0


def test_layout(spark):
    t = vectors(spark)
    placed = stats.spectral_plane(t, "id", "e", rounds=12, k=6)
    got = {r.id: (r.x, r.y) for r in placed.collect()}
    assert len(got) == 63 and got[61] == got[62] == (0, 0) and got[60] == got[0]
    assert stats.plane_accuracy(placed.where("id < 60"), k=5, every=4).first().accuracy >= 0.9
    assert stats.spectral_plane(t.limit(0), "id", "e", rounds=1).count() == 0


def test_accuracy(spark):
    r = random.Random(1)
    pts = [(i, r.random() + (i % 2) * 10, 0.0, "ab"[i % 2]) for i in range(40)]
    row = stats.plane_accuracy(spark.createDataFrame(pts, "id long, x double, y double, label string"), 3, 5).first()
    assert (row.accuracy, row.n) == (1.0, 8)


def test_accuracy_counts_every_point(spark):
    """The accuracy is that of all points: here those whose id is divisible by 20 are told, the others aren't."""
    pts = [(i, float(i // 4 * 10), 0.0, "a" if i // 4 % 5 == 0 else "abcd"[i % 4]) for i in range(100)]
    row = stats.plane_accuracy(spark.createDataFrame(pts, "id long, x double, y double, label string"), 3).first()
    want = sum(label == min("abcd"[j % 4] if i // 4 % 5 else "a" for j in range(i // 4 * 4, i // 4 * 4 + 4) if j != i) for i, _, _, label in pts) / 100
    assert (row.accuracy, row.n) == (want, 100) and want < 1


def test_votes_in_blocks(spark, monkeypatch):
    """All pairs are held against each other block by block: no join makes a row of each, ties go to the least id, and what can't be compared comes last."""
    r = random.Random(5)
    v = [[float(r.choice((-1, 1, 2))) for _ in range(3)] for _ in range(90)]
    v[7] = None
    t = spark.createDataFrame([(i, x, f"l{i % 7}") for i, x in enumerate(v)], "id long, vector array<double>, label string")
    cos = lambda a, b: -9 if a is None or b is None else math.floor(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b) * 1e9 + 0.5)
    want = {}
    for q in range(0, 90, 4):
        near = sorted((i for i in range(90) if i != q), key=lambda i: (-cos(v[q], v[i]), i))[:5]
        votes = [f"l{i % 7}" for i in near]
        want[q] = min(set(votes), key=lambda x: (-votes.count(x), x))
    for size in (8, 10_000):
        for name in ("NEAR_ROWS", "NEAR_QUERIES", "NEAR_STEP"):
            monkeypatch.setattr(stats, name, size)
        votes = stats.knn_votes(t.where("id % 4 = 0"), t)
        assert {x.qid: x.vote for x in votes.collect()} == want
        plan = votes._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_every_vector_votes(spark):
    """knn_vote asks for each vector, also those whose id isn't divisible by 20."""
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    catalog.load()
    votes = catalog.QUERIES["knn_vote"](spark, "/root/testdata/sf0.001")
    assert votes.select("qid").distinct().count() == votes.count() == n


def test_nearest_of_wide_rows(spark):
    """Rows so many that what is far is left by stripes: the k nearest, the least ids on ties, are those of a plain sort; ids may come again."""
    r = random.Random(8)
    v = [[float(r.randrange(9)), float(r.randrange(9))] for _ in range(1500)]
    rows = spark.createDataFrame([(i, x, i % 5) for i, x in enumerate(v)], "id long, v array<double>, label int")
    far = lambda q, m: -((m[None, :, 0] - q[:, None, 0]) ** 2 + (m[None, :, 1] - q[:, None, 1]) ** 2)
    for places in (None, 0):
        got = {}
        for x in stats.nearest(rows.where("id % 50 = 0"), rows, 4, lambda q, m: far(q, m) * 0.3, places).collect():
            got.setdefault(x.qid, set()).add(x.id)
        size = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        key = lambda q, i: (-math.floor(-0.3 * size(v[q], v[i]) + 0.5) if places == 0 else size(v[q], v[i]), i)
        assert got == {q: set(sorted((i for i in range(1500) if i != q), key=lambda i: key(q, i))[:4]) for q in range(0, 1500, 50)}  # noqa: B023
