"""Distribution, rank and cluster statistics. Windows are over values or entities that have been counted already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import semantics as S
from tallyspark.operators.prefix import running
from tallyspark.tables import held

#: Numbers of a block of group sums that goes to each task.
SUMS = 2_000_000


def distribution(rows: DataFrame, column: str, places: int = 0) -> DataFrame:
    """count, mean, median (of the middle two), population deviation, and the mode of the rounded values (the least on ties)."""
    v = F.col(column).cast("double")
    mode = rows.where(v.isNotNull()).groupBy(S.half_up(v, places).alias("b")).agg(F.count(F.lit(1)).alias("c")).agg(
        F.min_by("b", F.struct((-F.col("c")).alias("o"), "b")).alias("mode"))
    return rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("stddev")).crossJoin(mode)  # one row each


def histogram(rows: DataFrame, column: str, width: float = 10.0, bins: int = 11) -> DataFrame:
    """bin, n for each of the bins from 0 on, empty ones too; the last holds all above."""
    b = F.least(F.floor(F.col(column) / width), F.lit(bins - 1)).cast("int")
    found = rows.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").fillna(0, ["n"])


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the mean rank of ties."""
    n = running(rows.groupBy(column).agg(F.count(F.lit(1)).alias("c")), [F.col(column)], {"upto": F.col("c")})
    return rows.join(n.select(column, (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2.0).alias(name)), column)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_ranks(average_ranks(both, x, "__x"), y, "__y").agg(F.corr("__x", "__y").alias("rho"))


def kendall(rows: DataFrame, x: str, y: str) -> DataFrame:
    """tau-b from counts of distinct (x, y) pairs: the self-join is over value pairs, not rows."""
    cells = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    other = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    pairs = cells.join(other, (F.col("x") < F.col("x2")) & (F.col("y") != F.col("y2")))
    score = pairs.agg(F.coalesce(F.sum(F.when(F.col("y") < F.col("y2"), 1).otherwise(-1) * F.col("n") * F.col("n2")), F.lit(0)).alias("s"))
    tie = lambda c: cells.groupBy(c).agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2.0).alias(f"t{c}"), *(
        [F.sum("k").alias("n")] if c == "x" else []))
    pairs0 = F.col("n") * (F.col("n") - 1) / 2.0
    return score.crossJoin(tie("x")).crossJoin(tie("y")).select((F.col("s") / F.sqrt((pairs0 - F.col("tx")) * (pairs0 - F.col("ty")))).alias("tau"))


def discrimination(rows: DataFrame, column: str) -> DataFrame:
    """How well a score tells rows apart: share of tied pairs, entropy over that of equal bands, largest band, shares at both ends."""
    bands = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    whole = bands.agg(total.alias("total"), F.count(F.lit(1)).alias("bands"), F.max("n").alias("largest"), F.sum(F.col("n") * (F.col("n") - 1)).alias("ties"),
                      F.sum(F.col("n") * F.log(F.col("n"))).alias("nlogn"), F.min_by("n", "v").alias("lowest"), F.max_by("n", "v").alias("highest"))
    t = F.col("total").cast("double")
    entropy = F.when(F.col("bands") > 1, (F.log(t) - F.col("nlogn") / t) / F.log(F.col("bands").cast("double"))).otherwise(0.0)
    return whole.select("total", "bands", (F.col("ties") / (t * (t - 1))).alias("tie_rate"), entropy.alias("entropy"), (F.col("largest") / t).alias("largest_share"),
                        (F.col("lowest") / t).alias("low_share"), (F.col("highest") / t).alias("high_share"))


def levels(rows: DataFrame, column: str, low: int, high: int, width: int = 3, cover: float = 0.8) -> DataFrame:
    """How a score uses the whole levels of its scale, low to high: n, distinct, used levels, mean, sd, range, tie rate, entropy over that of all levels, the share of the best width levels in a row
    and where they begin, how many in a row hold cover of all rows at least, and the shares of two levels at either end. Rows are counted by value first; the rest is over one row of levels."""
    v = F.col(column).cast("double")
    values = rows.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    level = F.least(F.lit(high), F.greatest(F.lit(low), S.half_up(F.col("v")).cast("int")))
    one = values.groupBy().agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sum(F.col("v") * F.col("v") * F.col("c")).alias("__q"),
                               (F.max("v") - F.min("v")).alias("range"), F.sum(F.col("c") * (F.col("c") - 1)).alias("__ties"))
    counted = values.groupBy(level.alias("l")).agg(F.sum("c").alias("c")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("l", "c"))).alias("m"))
    total = high - low + 1
    t = one.crossJoin(counted).withColumn("__c", F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))))  # one row each
    n, add = F.col("n"), lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def sums(w: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(total - w + 1)), lambda i: add(F.slice("__c", i, w)))

    best = F.array_max(sums(min(width, total)))
    enough = F.coalesce(*[F.when(F.array_max(sums(w)) / n >= cover, F.lit(w)) for w in range(1, total + 1)], F.lit(total))
    entropy = -F.aggregate("__c", F.lit(0.0), lambda x, c: x + F.when(c > 0, c / n * F.log(c / n)).otherwise(0.0)) / F.log(F.lit(float(max(total, 2))))
    return t.where("n > 0").select(
        "n", "distinct", F.size(F.filter("__c", lambda c: c > 0)).alias("used"), "mean", F.sqrt(F.greatest(F.col("__q") / n - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"), "range",
        F.when(n > 1, F.col("__ties") / (n * (n - 1))).otherwise(0.0).alias("tie_rate"), entropy.alias("entropy"), (best / n).alias("band_share"),
        (F.array_position(sums(min(width, total)), best) - 1 + low).alias("band_from"), enough.alias("cover_width"), (add(F.slice("__c", 1, 2)) / n).alias("low_share"),
        (add(F.slice("__c", -min(2, total), 2)) / n).alias("high_share"))


def segments(rows: DataFrame, order: str, key: str, parts: int = 5) -> DataFrame:
    """Adds segment 0 .. parts - 1 of floor(n / parts) rows each by rank; the rest goes to the last."""
    size = F.greatest(F.floor(F.col("__all") / parts), F.lit(1))
    placed = running(rows, [F.col(order), F.col(key)], {"__rank": F.lit(1).cast("long")}, totals=True).withColumnRenamed("__rank_all", "__all")
    return placed.withColumn("segment", F.least(F.floor((F.col("__rank") - 1) / size), F.lit(parts - 1)).cast("int")).drop("__rank", "__all")


def size_scale(rows: DataFrame, column: str, low: float, high: float, power: float = 1.5) -> DataFrame:
    """Adds radius: between low and high by the share of values up to a row's."""
    n = running(rows.groupBy(column).agg(F.count(F.lit(1)).alias("c")), [F.col(column)], {"upto": F.col("c")}, totals=True)
    share = F.when(F.col("upto_all") > 1, (F.col("upto") - 1) / (F.col("upto_all") - 1)).otherwise(1.0)
    return rows.join(n.select(column, (low + (high - low) * F.pow(share, power)).alias("radius")), column)


# ---- vectors ----------------------------------------------------------------------------------------------------------


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    # the norm is an element of an array of one, so that it's computed once and not for each number
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def k_means(rows: DataFrame, column: str, k: int, seed: int = 42) -> DataFrame:
    """Adds cluster, from k-means on unit vectors (labels are arbitrary)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = rows.withColumn("__v", array_to_vector(unit(F.col(column))))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v).drop("__v")


def plane(rows: DataFrame, column: str) -> DataFrame:
    """Adds x, y: the two main components. It stands in for a non-linear map, which Spark doesn't have."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.withColumn("__v", array_to_vector(unit(F.col(column))))
    out = PCA(k=2, inputCol="__v", outputCol="__p").fit(v).transform(v).withColumn("__p", vector_to_array("__p"))
    return out.withColumns({"x": F.col("__p")[0], "y": F.col("__p")[1]}).drop("__v", "__p")


def near_in_cells(rows: DataFrame, key: str, column: str, k: int = 8, cell: int = 512, seed: int = 42) -> DataFrame:
    """a, b, w: edges from each different vector to the k nearest by cosine of its cell, w their cosine above 0. Cells are k-means clusters, dealt into blocks of some cell rows by a hash, so a
    large cluster is compared in blocks and not as a whole: neighbours are near ones, not always the nearest. Null and zero vectors have no edge; of equal ones the least key stands for all."""
    import numpy as np
    import pandas as pd

    v = rows.where(F.coalesce(norm(F.col(column)), F.lit(0.0)) > 0).groupBy(unit(F.col(column)).alias("v")).agg(F.min(key).alias("id"))
    v = held(v)
    n = v.count()
    if n < 2:
        return rows.sparkSession.createDataFrame([], "a long, b long, w double")
    dealt = held(k_means(v, "v", max(2, min(256, n // cell + 1)), seed))
    dealt = dealt.join(dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / cell)).cast("int")

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        x, ids, m = np.stack(group["v"].to_list()), group["id"].to_numpy(), min(k, len(group) - 1)
        if m < 1:
            return pd.DataFrame({"a": [], "b": [], "w": []}).astype({"a": "int64", "b": "int64"})
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        top = np.argpartition(-cos, m - 1, axis=1)[:, :m]
        return pd.DataFrame({"a": np.repeat(ids, m), "b": ids[top].ravel(), "w": np.maximum(np.take_along_axis(cos, top, 1).ravel(), 0)})

    return held(dealt.withColumn("block", block).groupBy("cluster", "block").applyInPandas(nearest, "a long, b long, w double").where("w > 0"))


def spectral_plane(rows: DataFrame, key: str, column: str, rounds: int = 20, **options) -> DataFrame:
    """rows plus x, y: a spectral layout of the neighbour graph. The two slowest ways of a random walk on it are found by power iteration: a round is a join of the written edges with
    the written places and a sum by node; each time the constant and, of y, x are taken out and both are scaled. Vectors without a neighbour stand at 0, equal ones at one place."""
    edges = near_in_cells(rows, key, column, **options)
    both = held(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w")))
    start = lambda s: (F.pmod(F.xxhash64("a", F.lit(s)), F.lit(1 << 20)) / float(1 << 19) - 1)
    now = held(both.groupBy("a").agg(F.sum("w").alias("d")).withColumns({"x": start("x"), "y": start("y")}))
    for _ in range(rounds):
        moved = both.join(now.select(F.col("a").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b").groupBy("a").agg(
            F.sum(F.col("w") * F.col("bx")).alias("sx"), F.sum(F.col("w") * F.col("by")).alias("sy"))
        step = held(now.join(moved, "a").select("a", "d", ((F.col("x") + F.col("sx") / F.col("d")) / 2).alias("x"), ((F.col("y") + F.col("sy") / F.col("d")) / 2).alias("y")))
        s = lambda e: F.sum(F.col("d") * e)
        x, y = F.col("x"), F.col("y")
        m = step.agg(F.sum("d").alias("d"), s(x).alias("x"), s(y).alias("y"), s(x * x).alias("xx"), s(x * y).alias("xy"), s(y * y).alias("yy")).first()
        if not m.d:
            break
        mx, my = m.x / m.d, m.y / m.d
        xx, xy, yy = m.xx / m.d - mx * mx, m.xy / m.d - mx * my, m.yy / m.d - my * my
        part = xy / xx if xx > 0 else 0.0
        rest = yy - part * xy
        fit = lambda e, size: e / F.lit(size**0.5) if size > 1e-18 else F.lit(0.0)
        now = step.select("a", "d", fit(x - mx, xx).alias("x"), fit((y - my) - part * (x - mx), rest).alias("y"))
    places = now.select(F.col("a").alias("__a"), "x", "y")
    same = rows.where(F.coalesce(norm(F.col(column)), F.lit(0.0)) > 0).groupBy(unit(F.col(column)).alias("__v")).agg(F.min(key).alias("__a"))
    able = F.coalesce(norm(F.col(column)), F.lit(0.0)) > 0
    placed = rows.withColumn("__v", unit(F.when(able, F.col(column)))).join(same, "__v", "left").join(places, "__a", "left").drop("__v", "__a")
    return placed.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in "xy"})


#: Rows and queries of a block at most, queries of one at least; queries held against a block's rows at once.
NEAR_ROWS, NEAR_QUERIES, NEAR_FEW, NEAR_STEP = 65_536, 65_536, 1024, 64


def nearest(queries: DataFrame, rows: DataFrame, k: int, score, places: int | None = None) -> DataFrame:
    """queries and rows (id, v: an array of doubles, label): qid, truth, id, label of the k rows with the largest score but for the query's own id (the least id on ties); scores count
    to so many places, if they are given. Both are dealt into blocks by a hash; each pair of blocks is a task's matrix, score(q, v) in numpy, that keeps k rows a query, and of these the best
    of all blocks are kept. All pairs are held against each other, in the memory of one pair of blocks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    total, n_rows = queries.count(), max(1, -(-rows.count() // NEAR_ROWS))
    # blocks are large, as each side is shuffled once a block of the other; a few rows are still dealt to all cores
    n_queries = max(1, -(-total // NEAR_QUERIES), min(-(-total // NEAR_FEW), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // n_rows)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "v", "label", block(n_queries).alias("qb")).withColumn("rb", spread(n_rows))
    right = rows.select("id", "v", "label", block(n_rows).alias("rb")).withColumn("qb", spread(n_queries))
    label = rows.schema["label"].dataType.simpleString()

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, filled up with 0, their lengths); a null, or a vector that holds one, has no length."""
        v = t.column("v").combine_chunks()
        n, flat, row = pc.fill_null(pc.list_value_length(v), 0).to_numpy(), pc.list_flatten(v), pc.list_parent_indices(v).to_numpy()
        out = np.zeros((len(n), n.max(initial=0)))
        out[row, np.arange(len(row)) - (np.cumsum(n) - n)[row]] = pc.fill_null(flat, 0.0).to_numpy()
        n = np.where(n > 0, n, -1)
        n[row[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
        out[n < 0] = 0
        return out, n

    def first(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of a query's k best. The k-th largest of the maxima of 64 stripes of the row is no more than its k-th largest score: what is below is left without a sort."""
        m = len(s) // 64
        least = np.partition(s[: m * 64].reshape(64, m).max(axis=0), m - k)[m - k] if m >= k else -np.inf
        j = np.flatnonzero(s >= (least if places is None else least - 2 / 10**places))  # what differs by more keeps its order
        j = j[s[j] > -np.inf]
        v = s[j] if places is None else np.floor(s[j] * 10**places + 0.5)
        if len(j) > k:
            edge = np.partition(v, len(v) - k)[len(v) - k]
            more = np.flatnonzero(v > edge)
            keep = np.concatenate([more, np.flatnonzero(v == edge)[: k - len(more)]])
            j, v = j[keep], v[keep]
        return j, v

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        if not len(q) or not len(r):
            return pa.table({"qid": pa.array([], pa.int64()), "truth": q.column("label").slice(0, 0), "id": pa.array([], pa.int64()), "label": r.column("label").slice(0, 0), "s": pa.array([], pa.float64())})
        r = r.sort_by("id")
        qid, rid, (qv, qn), (rv, rn), found = q.column("id").to_numpy(), r.column("id").to_numpy(), matrix(q), matrix(r), []
        width = max(qv.shape[1], rv.shape[1])
        qv, rv = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (qv, rv))
        able, finite = (qn == width).all() and (rn == width).all(), np.isfinite(qv).all() and np.isfinite(rv).all()
        begin, end = (np.searchsorted(rid, qid, side) for side in ("left", "right"))
        for low in range(0, len(qid), NEAR_STEP):
            s, n = score(qv[low : low + NEAR_STEP], rv), qn[low : low + NEAR_STEP, None]
            if not finite:
                s[np.isnan(s)] = np.inf  # as Spark sorts it
            if not able:
                s[(n != rn[None, :]) | (n < 0)] = -1e300  # what can't be compared comes last
            for i, x in enumerate(s, low):
                x[begin[i] : end[i]] = -np.inf  # the query's own id
                j, v = first(x)
                found.append((np.full(len(j), i), j, v))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"qid": qid[i], "truth": q.column("label").take(pa.array(i)), "id": rid[j], "label": r.column("label").take(pa.array(j)), "s": s})

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(best, f"qid long, truth {label}, id long, label {label}, s double")
    most = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), "id", "label"))), 1, k)  # k rows a block
    return found.groupBy("qid", "truth").agg(most.alias("x")).select("qid", "truth", F.inline("x")).drop("o")


def _votes(near: DataFrame) -> DataFrame:
    """The label that most of a query's rows have, the least on ties."""
    n = near.groupBy("qid", "truth", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("qid", "truth").agg(F.min_by("label", F.struct((-F.col("n")).alias("o"), "label")).alias("vote"))


def plane_accuracy(points: DataFrame, k: int = 5, every: int = 1) -> DataFrame:
    """One row: of the points(id, x, y, label), all or those whose id is divisible by every, the share that most of their k nearest others in the plane agree with; accuracy, n."""
    import numpy as np

    rows = held(points.select("id", F.array("x", "y").alias("v"), "label"))

    def near(q, v):
        x, y = (np.square(v[None, :, i] - q[:, None, i]) for i in (0, 1))
        return np.negative(np.add(x, y, out=x), out=x)

    votes = _votes(nearest(rows.where(F.col("id") % every == 0) if every > 1 else rows, rows, k, near))
    return votes.agg(F.avg((F.col("vote") == F.col("truth")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def knn_votes(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """queries and rows (id, vector, label): the label that most of the k nearest others by cosine have (the least on ties); cosines count to nine places."""
    able = lambda df: held(df.select("id", unit(F.col("vector")).alias("v"), "label"))
    every = able(rows)
    return _votes(nearest(every if queries is rows else able(queries), every, k, lambda q, v: q @ v.T, places=9))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalized mutual information of two labellings, from their contingency table."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda x: x * (x - 1) / 2.0
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(
        F.sum(c2(F.col("m"))).alias(f"p{c}"), F.sum(F.col("m") * F.log("m")).alias(f"l{c}"))
    t = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(c2(F.col("n"))).alias("pc"), F.sum(F.col("n") * F.log("n")).alias("lc"))
    t = t.crossJoin(side("a")).crossJoin(side("b"))  # one row each
    expected, most = F.col("pa") * F.col("pb") / c2(F.col("n")), (F.col("pa") + F.col("pb")) / 2
    n = F.col("n")
    ha, hb = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    mutual = F.log(n) + (F.col("lc") - F.col("la") - F.col("lb")) / n
    return t.select(F.when(most == expected, 1.0).otherwise((F.col("pc") - expected) / F.nullif(most - expected, F.lit(0.0))).alias("ari"),
                    F.when(ha + hb == 0, 1.0).otherwise(2 * mutual / F.nullif(ha + hb, F.lit(0.0))).alias("nmi"))


def vote_scores(votes: DataFrame) -> DataFrame:
    """votes(truth, vote) -> accuracy and the mean F1 over the labels that are true somewhere."""
    hit = votes.where("truth = vote").groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("tp"))
    true = votes.groupBy(F.col("truth").alias("label")).agg(F.count(F.lit(1)).alias("t"))
    said = votes.groupBy(F.col("vote").alias("label")).agg(F.count(F.lit(1)).alias("s"))
    per = true.join(said, "label", "left").join(hit, "label", "left").fillna(0, ["s", "tp"])
    return per.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("tp") / (F.col("t") + F.col("s"))).alias("macro_f1"))


def cluster_terms(points: DataFrame, n: int = 5, least: int = 3, least_share: float = 0.08) -> DataFrame:
    """points(id, cluster, terms) -> the n terms of each cluster with the largest lift over all, of those in at least max(least, share) members."""
    tokens = points.select("id", "cluster", F.explode(F.array_distinct("terms")).alias("term"))
    size = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    total = points.agg(F.count(F.lit(1)).alias("total"))
    everywhere = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    here = tokens.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("k")).join(size, "cluster").join(everywhere, "term").crossJoin(total)  # one row
    lift = (F.col("k") / F.col("size")) / (F.col("df") / F.col("total"))
    kept = here.where((F.col("k") >= least) & (F.col("k") >= least_share * F.col("size"))).withColumn("lift", lift)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("lift"), F.desc("k"), "term"))).where(
        F.col("rank") <= n).select("cluster", "rank", "term", "k", "lift")


def density(points: DataFrame, group: str, cell: float, sigma: float = 1.0, reach: int = 2) -> DataFrame:
    """points(x, y, group): the group that is densest in each grid cell, after a Gaussian blur over neighbouring cells."""
    cells = points.groupBy(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j"), group).agg(F.count(F.lit(1)).alias("n"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.exp(F.lit(-(a * a + b * b) / (2 * sigma * sigma))).alias("w"))
                                for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    blurred = cells.withColumn("s", steps).groupBy((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), group).agg(
        F.sum(F.col("n") * F.col("s.w")).alias("d"))
    return blurred.groupBy("i", "j").agg(F.max_by(group, F.struct("d", group)).alias(group), F.max("d").alias("density"))


def _unit_sums(rows: DataFrame, column: str, group: str) -> DataFrame:
    """group, n, sums: the sum of a group's unit vectors; one row a group and dimension is shuffled."""
    parts = rows.select(group, F.posexplode(unit(F.col(column))).alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sums"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def silhouette(rows: DataFrame, column: str, label: str) -> DataFrame:
    """One row: the mean silhouette by cosine distance. The mean distance to a group follows from the sum of its unit vectors, so no pairs are made.
    A vector alone in its group counts 0. The groups' sums go to each task in blocks of at most SUMS numbers; more than one block is taken one after the other,
    each over a written table."""
    sums = held(_unit_sums(rows, column, label).withColumnRenamed(label, "g"))
    size = sums.agg(F.sum(F.size("sums"))).first()[0] or 0
    blocks = -(-size // SUMS) or 1
    v = rows.select(F.col(label).alias("g"), unit(F.col(column)).alias("u")).where("g is not null")
    v = v.join(sums.select("g", F.col("n").alias("own_n"), F.col("sums").alias("own")), "g")
    v = v.select("g", "u", ((F.col("own_n") - _dot(F.col("u"), F.col("own"))) / F.nullif(F.col("own_n") - 1, F.lit(0))).alias("a"), F.lit(None).cast("double").alias("b"))
    for k in range(blocks):
        block = sums.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == k).groupBy().agg(F.collect_list(F.struct("g", "n", "sums")).alias("gs"))
        near = F.array_min(F.transform(F.filter("gs", lambda s: s["g"] != F.col("g")), lambda s: 1 - _dot(F.col("u"), s["sums"]) / s["n"]))
        v = v.crossJoin(F.broadcast(block)).select("g", "u", "a", F.least("b", near).alias("b"))  # one row
        v = held(v) if k + 1 < blocks else v
    ab = v.select("a", "b")
    score = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.avg(score).alias("silhouette"))


def cluster_labels(points: DataFrame, column: str, ministries: int = 3) -> DataFrame:
    """points(id, cluster, x, y, category, ministry, <column>) -> a row a cluster: n, the mean place, the most frequent category and its share, the most
    frequent ministries, and the member nearest to the mean of unit vectors (by cosine, to nine places). Ties go to the lesser."""
    base = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"))
    count = lambda c: points.groupBy("cluster", c).agg(F.count(F.lit(1)).alias("k"))
    top = count("category").groupBy("cluster").agg(F.min_by(F.struct("category", "k"), F.struct((-F.col("k")).alias("o"), "category")).alias("t"))
    most = count("ministry").groupBy("cluster").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "ministry"))), 1, ministries), lambda x: x["ministry"]).alias("ministries"))
    centre = _unit_sums(points, column, "cluster").select("cluster", unit(F.col("sums")).alias("c"))
    near = points.select("id", "cluster", unit(F.col(column)).alias("u")).join(centre, "cluster").select(
        "cluster", "id", S.half_up(_dot(F.col("u"), F.col("c")), 9).alias("sim"))
    medoid = near.groupBy("cluster").agg(F.min_by("id", F.struct((-F.col("sim")).alias("o"), "id")).alias("medoid"))
    return (base.join(top, "cluster").join(most, "cluster").join(medoid, "cluster")
            .select("cluster", "n", "cx", "cy", F.col("t.category").alias("category"), F.round(F.col("t.k") / F.col("n"), 3).alias("share"), "ministries", "medoid"))


def share_within(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Adds share: a row's part of its group's sum; 0 where that is 0. The sums are joined, so a large group isn't gathered in one task."""
    whole = rows.groupBy(group).agg(F.sum(value).alias("__w"))
    return rows.join(whole, group).withColumn("share", F.when(F.col("__w") > 0, F.col(value).cast("double") / F.col("__w")).otherwise(0.0)).drop("__w")
