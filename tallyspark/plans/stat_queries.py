"""Statistics, search and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import search, stats
from tallyspark.plans import adapter as A

from .catalog import query


@query("""
WITH x AS (SELECT ROUND(l_quantity) AS v FROM lineitem), m AS (SELECT v, COUNT(*) AS c FROM x GROUP BY 1)
SELECT (SELECT COUNT(*) FROM x) AS n, ROUND((SELECT AVG(v) FROM x), 6) AS mean, (SELECT MEDIAN(v) FROM x) AS median, ROUND((SELECT STDDEV_POP(v) FROM x), 6) AS stddev,
       (SELECT v FROM m ORDER BY c DESC, v LIMIT 1) AS mode""")
def distribution_stats(spark, sf_dir):
    d = stats.distribution(A.table(spark, sf_dir, "lineitem").select(F.round("l_quantity").alias("v")), "v")
    return d.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("""
SELECT CAST(b.range AS INTEGER) AS bin, COUNT(x.v) AS n FROM range(11) b LEFT JOIN (SELECT LEAST(FLOOR(l_quantity / 10), 10) AS v FROM lineitem) x ON x.v = b.range GROUP BY 1""")
def histogram_bins(spark, sf_dir):
    return stats.histogram(A.table(spark, sf_dir, "lineitem"), "l_quantity")


@query("""
WITH r AS (SELECT RANK() OVER (ORDER BY q) + (COUNT(*) OVER (PARTITION BY q) - 1) / 2.0 AS a, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0 AS b
           FROM (SELECT l_quantity AS q, FLOOR(l_extendedprice / 100) AS p FROM lineitem)) SELECT ROUND(CORR(a, b), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.floor(F.col("l_extendedprice") / 100).alias("p"))
    return stats.spearman(rows, "q", "p").select(F.round("rho", 6).alias("rho"))


@query("""
WITH x AS (SELECT l_quantity AS a, l_linenumber AS b, COUNT(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT SUM(CASE WHEN p.b < q.b THEN 1 ELSE -1 END * p.n * q.n)::DOUBLE AS s FROM x p JOIN x q ON p.a < q.a AND p.b <> q.b),
ta AS (SELECT SUM(k * (k - 1) / 2.0) AS t FROM (SELECT SUM(n) AS k FROM x GROUP BY a)), tb AS (SELECT SUM(k * (k - 1) / 2.0) AS t FROM (SELECT SUM(n) AS k FROM x GROUP BY b)),
c AS (SELECT SUM(n) AS n FROM x)
SELECT ROUND(s.s / SQRT((c.n * (c.n - 1) / 2.0 - ta.t) * (c.n * (c.n - 1) / 2.0 - tb.t)), 6) AS tau FROM s, ta, tb, c""")
def kendall_tau(spark, sf_dir):
    return stats.kendall(A.table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber").select(F.round("tau", 6).alias("tau"))


@query("""
WITH b AS (SELECT p_size AS v, COUNT(*)::DOUBLE AS n FROM part GROUP BY 1), t AS (SELECT SUM(n) AS t, COUNT(*) AS k FROM b)
SELECT CAST(t AS BIGINT) AS total, k AS bands, ROUND((SELECT SUM(n * (n - 1)) FROM b) / (t * (t - 1)), 6) AS tie_rate,
 ROUND((LN(t) - (SELECT SUM(n * LN(n)) FROM b) / t) / LN(k), 6) AS entropy, ROUND((SELECT MAX(n) FROM b) / t, 6) AS largest_share FROM t""")
def tie_rate_entropy(spark, sf_dir):
    d = stats.discrimination(A.table(spark, sf_dir, "part"), "p_size")
    return d.select("total", "bands", *[F.round(c, 6).alias(c) for c in ("tie_rate", "entropy", "largest_share")])


@query("""
SELECT seg AS segment, COUNT(*) AS n, ROUND(AVG(p_retailprice), 6) AS mean FROM (
SELECT p_retailprice, CAST(LEAST(FLOOR((ROW_NUMBER() OVER (ORDER BY p_size, p_partkey) - 1) / FLOOR(COUNT(*) OVER () / 5)), 4) AS INTEGER) AS seg FROM part) GROUP BY 1""")
def quintile_segments(spark, sf_dir):
    s = stats.segments(A.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_partkey")
    return s.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("""
WITH c AS (SELECT c_nationkey AS a, c_mktsegment AS b, COUNT(*) AS n FROM customer GROUP BY 1, 2),
x AS (SELECT SUM(m * (m - 1) / 2.0) AS p FROM (SELECT SUM(n) AS m FROM c GROUP BY a)), y AS (SELECT SUM(m * (m - 1) / 2.0) AS p FROM (SELECT SUM(n) AS m FROM c GROUP BY b)),
t AS (SELECT SUM(n) AS n, SUM(n * (n - 1) / 2.0) AS p FROM c)
SELECT ROUND((t.p - x.p * y.p / (t.n * (t.n - 1) / 2.0)) / ((x.p + y.p) / 2 - x.p * y.p / (t.n * (t.n - 1) / 2.0)), 6) AS ari FROM t, x, y""")
def rand_index(spark, sf_dir):
    return stats.agreement(A.table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment").select(F.round("ari", 6).alias("ari"))


@query("""
WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, q.label AS truth, u.vec_id AS id, u.label, FLOOR(list_cosine_similarity(q.e, u.e) * 1e9 + 0.5) / 1e9 AS sim FROM u q JOIN u ON u.vec_id <> q.vec_id),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS k FROM s),
v AS (SELECT qid, truth, label, COUNT(*) AS n FROM b WHERE k <= 5 GROUP BY 1, 2, 3)
SELECT qid, truth, label AS vote FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY n DESC, label) AS k FROM v) WHERE k = 1""")
def knn_vote(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return stats.knn_votes(rows, rows)


@query("""
WITH h AS (SELECT doc_id, source AS pid, CAST(n_chars AS BIGINT) AS amount, doc_id % 3 AS depth FROM documents
           WHERE contains(regexp_replace(lower(text), '\\s+', '', 'g'), 'theand') OR contains(regexp_replace(lower(source), '\\s+', '', 'g'), 'theand'))
SELECT COUNT(*) AS hits, COUNT(DISTINCT pid) AS projects, CAST(COALESCE(SUM(CASE WHEN depth > 0 THEN 0 ELSE amount END), 0) AS BIGINT) AS direct,
       CAST(COALESCE(SUM(CASE WHEN depth > 0 THEN amount END), 0) AS BIGINT) AS subcontract FROM h""")
def spending_search_agg(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select(F.col("source").alias("pid"), F.col("text").alias("role"), F.col("source").alias("cc"), F.col("n_chars").alias("amount"),
                                                   (F.col("doc_id") % 3).alias("depth"))
    return search.spending_totals(search.spending_hits(search.with_normal(d, ["role", "cc"]), "The and", excerpts=False))


def excerpts(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("pid"), F.col("text").alias("role"), F.col("source").alias("cc"),
                                                   F.col("n_chars").alias("amount"), (F.col("doc_id") % 3).alias("depth"))
    return search.spending_hits(search.with_normal(d, ["role", "cc"]), "The and").select("doc_id", "matched_in", "excerpt")


query()(excerpts)


@query()
def embedding_clusters(spark, sf_dir):
    rows = A.table(spark, sf_dir, "embeddings")
    return stats.plane(stats.k_means(rows, "embedding", 8), "embedding").select("vec_id", "cluster", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query()
def map_accuracy(spark, sf_dir):
    """How well neighbours in the plane tell a vector's label, for the spectral layout and for two principal components."""
    rows = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").where("label is not null")
    maps = {"spectral": stats.spectral_plane(rows, "id", "embedding"), "components": stats.plane(rows, "embedding")}
    found = [stats.plane_accuracy(m.select("id", "x", "y", "label")).withColumn("method", F.lit(name)) for name, m in maps.items()]
    return found[0].unionByName(found[1]).select("method", F.round("accuracy", 4).alias("accuracy"), "n")
