"""Running sums by ranges give what a window gives: ties, nulls, groups, empty tables."""

import random

from pyspark.sql import functions as F

from tallyspark.operators import pages, prefix, stacking, stats


def rows(spark, n=300, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, r.choice(["a", "b", None]), r.choice([None, 1, 2, 5]), r.randrange(40) / 4) for i in range(n)], "id int, g string, v int, x double").repartition(5)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_both_ways_agree(spark):
    t = rows(spark)
    for by in ((), ("g",)):
        few, many = (prefix.running(t, [F.desc("x"), F.col("id")], {"s": F.col("v")}, by, totals=True, limit=k).select("id", "g", "s", "s_all") for k in (None, 0))
        assert as_set(few) == as_set(many)
    a, b = (as_set(prefix.ranked(t, F.desc("x"), F.col("id"), limit=k).select("id", "rank", "n")) for k in (None, 0))
    assert a == b and [x[2] for x in a] == [300] * 300 and sorted(x[1] for x in a) == list(range(1, 301))
    want = sorted(t.collect(), key=lambda r: (-r.x, r.id))
    assert {r.id: i for i, r in enumerate(want, 1)} == {x[0]: x[1] for x in a}
    assert prefix.ranked(t.limit(0), F.col("id"), limit=0).count() == 0


def test_elements(spark):
    t = rows(spark)
    xs = sorted(r.x for r in t.collect())
    for limit in (None, 0):
        r = prefix.elements(t, "x", {"m": F.floor(F.col("n") / 2), "last": F.col("n") + 5}, limit=limit).first()
        assert (r.n, r.m, r["last"]) == (300, xs[150], xs[-1])
    by = {r.g: r.m for r in prefix.elements(t, "x", {"m": F.floor(F.col("n") / 2)}, ("g",), limit=0).collect()}
    for g in ("a", "b", None):
        own = sorted(r.x for r in t.collect() if r.g == g)
        assert by[g] == own[len(own) // 2]
    assert pages.places_of(t, "id", "x", [1, 2, 1, 999]).count() == 2


def test_no_window_over_all(spark):
    plan = prefix.ranked(rows(spark), F.col("id"), limit=0)._jdf.queryExecution().toString()
    assert "Window" not in plan  # it ends at a written table
    places = pages.places_of(rows(spark), "id", "x", [3])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in places


def test_stacking(spark):
    nodes = spark.createDataFrame([("a", 0, 1, 8, None), ("b", 2, 2, 3, 6), ("c", 2, 1, 5, None), ("d", 2, 3, 0, None)], "id string, col int, place int, value long, layout_value long")
    got = {r.id: (r.x0, r.x1, r.y0, r.y1) for r in stacking.stacked_nodes(nodes, 1.0, 100, pad=4, ministry_gap=7).collect()}
    assert got == {"a": (0, 18, 0, 8), "c": (207, 225, 0, 5), "b": (207, 225, 7, 10), "d": (207, 225, 15, 16)}
    links = spark.createDataFrame([("a", "b", 3), ("a", "c", 5), ("a", "d", 0)], "source string, target string, value long")
    for limit in (None, 0):
        placed = stacking.stacked_nodes(nodes, 1.0, 100, pad=4, ministry_gap=7, limit=limit)
        got = {r.target: (r.source_y, r.source_width, r.target_y, r.target_width) for r in stacking.stacked_links(links, placed, limit).collect()}
        assert got == {"c": (0, 5, 0, 5), "b": (5, 3, 7, 3), "d": (8, 1, 15, 1)}


def test_silhouette_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    t = spark.createDataFrame([([r.random(), r.random(), r.random()], i % 7) for i in range(80)], "e array<double>, l int")
    one = stats.silhouette(t, "e", "l").first()[0]
    monkeypatch.setattr(stats, "SUMS", 6)
    assert abs(stats.silhouette(t, "e", "l").first()[0] - one) < 1e-12
