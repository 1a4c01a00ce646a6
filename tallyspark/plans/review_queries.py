"""Queries of judged rows, votes, readiness, statuses, clusters and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import semantics as S
from tallyspark.operators import blocks, budget, pages, review, screening, stats
from tallyspark.plans import adapter as A

from .catalog import query
from .flow_queries import YEAR, model_sql

JUDGED = """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name AS name,
  CASE l_partkey % 5 WHEN 0 THEN '一式' WHEN 1 THEN NULL WHEN 2 THEN ' ' || p_brand ELSE p_type END AS contract, CASE WHEN l_suppkey % 2 = 0 THEN p_brand ELSE '' END AS role,
  l_returnflag = 'A' AS has_number, ['valid', 'gov', 'supp', 'invalid', 'unknown', NULL][l_partkey % 6 + 1] AS status, l_suppkey % 7 = 0 AS opaque
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
t AS (SELECT *, trim(COALESCE(contract, '')) AS c, trim(COALESCE(role, '')) AS o FROM r), u AS (SELECT *, CASE WHEN length(c) >= length(o) THEN c ELSE o END AS x FROM t)
SELECT l_suppkey, CAST(CASE WHEN opaque THEN 0 WHEN status = 'valid' AND has_number THEN 3 WHEN status IN ('valid', 'gov', 'supp') THEN 2 WHEN status = 'invalid' THEN 1
  WHEN length(c) >= 12 OR length(o) >= 8 THEN 2 ELSE 1 END AS INTEGER) AS identify,
  CAST(CASE WHEN x IN ('', '一式') THEN 0 WHEN length(x) < 8 THEN 1 WHEN length(x) < 20 THEN 2 ELSE 3 END AS INTEGER) AS purpose, COUNT(*) AS n
FROM u GROUP BY ALL"""


@query(JUDGED)
def judged_rows(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    k, brand = F.col("l_partkey"), F.col("p_brand")
    statuses = F.array(*[F.lit(x) for x in ("valid", "gov", "supp", "invalid", "unknown", None)])
    rows = (t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_suppkey", F.col("s_name").alias("name"), F.when(k % 5 == 0, "一式").when(k % 5 == 1, None).when(k % 5 == 2, F.concat(F.lit(" "), brand)).otherwise(F.col("p_type")).alias("contract"),
        F.when(F.col("l_suppkey") % 2 == 0, brand).otherwise("").alias("role"), (F.col("l_returnflag") == "A").alias("has_number"),
        F.get(statuses, (k % 6).cast("int")).alias("status"), (F.col("l_suppkey") % 7 == 0).alias("opaque")))
    return review.judged_rows(rows).groupBy("l_suppkey", "identify", "purpose").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH v AS (SELECT o_custkey AS pid, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no, NULLIF(o_orderkey % 11, 10) AS design, NULLIF(o_orderkey % 3, 2) AS evidence,
  o_orderkey % 8 AS proportionality, NULLIF(o_orderkey % 2, 1) AS necessity, NULLIF(o_orderstatus, 'P') AS category, o_orderpriority AS reason FROM orders),
m AS (SELECT pid, COUNT(*) AS votes, """ + ", ".join(
    f"CASE WHEN COUNT(*) = 1 THEN MAX({a})::DOUBLE WHEN COUNT({a}) * 2 > COUNT(*) THEN round_even(AVG({a}), 2) END AS {a}" for a in review.AXES) + """ FROM v GROUP BY 1),
k AS (SELECT * FROM m WHERE design IS NOT NULL OR votes = 1),
c AS (SELECT pid, category, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY COUNT(*) DESC, MIN(no)) AS r FROM v WHERE category IS NOT NULL GROUP BY 1, 2),
n AS (SELECT v.pid, reason, ROW_NUMBER() OVER (PARTITION BY v.pid ORDER BY ABS(COALESCE(v.design, 0) - COALESCE(k.design, 0)), no) AS r FROM v JOIN k ON k.pid = v.pid)
SELECT k.*, c.category, n.reason FROM k LEFT JOIN c ON c.pid = k.pid AND c.r = 1 JOIN n ON n.pid = k.pid AND n.r = 1""")
def combined_votes(spark, sf_dir):
    from pyspark.sql.window import Window

    k = F.col("o_orderkey")
    votes = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("pid"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("vote_no"), F.nullif(k % 11, F.lit(10)).alias("design"),
        F.nullif(k % 3, F.lit(2)).alias("evidence"), (k % 8).alias("proportionality"), F.nullif(k % 2, F.lit(1)).alias("necessity"),
        F.nullif("o_orderstatus", F.lit("P")).alias("category"), F.col("o_orderpriority").alias("reason"))
    return review.combined_votes(votes)


BENCH = "(SELECT p_partkey AS pid, p_brand AS cohort, p_partkey % 5 AS design, p_size % 5 AS evidence, NULLIF(p_partkey * 7 % 101, 50) AS current FROM part)"


def bench_rows(spark, sf_dir):
    k = F.col("p_partkey")
    return A.table(spark, sf_dir, "part").select(k.alias("pid"), F.col("p_brand").alias("cohort"), (k % 5).alias("design"), (F.col("p_size") % 5).alias("evidence"),
                                                 F.nullif(k * 7 % 101, F.lit(50)).alias("current"))


@query(f"""
SELECT pid, design * 25 AS design_score, evidence * 25 AS evidence_score, (design * 25 + evidence * 25) / 2 AS readiness_score,
       CASE WHEN evidence <= 1 THEN 'EVIDENCE_MISSING' WHEN evidence >= 3 AND (design * 25 + evidence * 25) / 2 >= 75 THEN 'READY_FOR_REVIEW' ELSE 'NEEDS_ADDITIONAL_EVIDENCE' END AS status
FROM {BENCH}""")
def review_readiness(spark, sf_dir):
    return review.readiness(bench_rows(spark, sf_dir)).drop("cohort", "design", "evidence", "current")


@query(f"""
SELECT cohort, COUNT(*) AS n, ROUND(AVG(current), 6) AS current, ROUND(AVG(CASE WHEN current IS NOT NULL THEN design * 25 END), 6) AS design,
       ROUND(AVG(ABS(design * 25 - current)), 6) AS mae, ROUND(AVG(evidence), 6) AS evidence FROM {BENCH} GROUP BY GROUPING SETS ((cohort), ())""")
def benchmark_cohorts(spark, sf_dir):
    s = review.benchmark_summary(bench_rows(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("current", "design", "mae", "evidence")})


@query(f"SELECT pid, design * 25 - current AS delta FROM {BENCH} WHERE ABS(design * 25 - current) >= 20")
def benchmark_outliers(spark, sf_dir):
    return review.benchmark_outliers(bench_rows(spark, sf_dir)).select("pid", "delta")


@query("""
WITH r AS (SELECT o_orderkey, 'n' || o_custkey % 97 AS recipient, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE ' ' END AS number, o_orderkey % 4 = 0 AS verified FROM orders),
d AS (SELECT 'n' || range AS name, range % 2 = 0 AS good, range % 3 = 0 AS gov, range % 5 = 0 AS supp FROM range(80))
SELECT o_orderkey, CASE WHEN d.name IS NULL THEN CASE WHEN verified THEN 'cn' ELSE 'unknown' END WHEN good THEN CASE WHEN trim(number) <> '' THEN 'valid' ELSE 'invalid' END
       WHEN gov THEN 'gov' WHEN supp THEN 'supp' WHEN verified THEN 'cn' ELSE 'invalid' END AS status FROM r LEFT JOIN d ON d.name = r.recipient""")
def tiered_status(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("n"), F.col("o_custkey") % 97).alias("recipient"),
                                                   F.when(k % 3 > 0, F.col("o_orderstatus")).otherwise(" ").alias("number"), (k % 4 == 0).alias("verified"))
    names = spark.range(80).select(F.concat(F.lit("n"), "id").alias("name"), "id")
    return screening.row_status(rows, names.select("name", (F.col("id") % 2 == 0).alias("good")), names.where("id % 3 = 0").select("name"),
                                names.where("id % 5 = 0").select("name")).select("o_orderkey", "status")


@query("""
WITH l AS (SELECT l_suppkey AS pid, CAST(l_linenumber AS VARCHAR) AS block, CASE WHEN l_partkey % 4 > 0 THEN l_returnflag ELSE ' ' END AS name,
  CASE WHEN l_partkey % 3 > 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS amount, CASE WHEN l_partkey % 5 > 0 THEN l_linestatus END AS role, l_orderkey * 100000 + l_partkey AS no FROM lineitem)
SELECT pid, block, COALESCE(arg_min(name, (no, name)) FILTER (WHERE trim(name) <> ''), '') AS name, COALESCE(arg_min(amount, (no, amount)) FILTER (WHERE amount <> 0), 0) AS amount,
       COALESCE(arg_min(role, (no, role)) FILTER (WHERE trim(role) <> ''), '') AS role FROM l GROUP BY 1, 2""")
def block_heads(spark, sf_dir):
    k = F.col("l_partkey")
    rows = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pid"), F.col("l_linenumber").cast("string").alias("block"), F.when(k % 4 > 0, F.col("l_returnflag")).otherwise(" ").alias("name"),
        F.when(k % 3 > 0, F.col("l_quantity").cast("long")).otherwise(0).alias("amount"), F.when(k % 5 > 0, F.col("l_linestatus")).alias("role"),
        (F.col("l_orderkey") * 100000 + k).alias("line_no"))
    return blocks.block_heads(rows)


@query("""
WITH l AS (SELECT l_suppkey AS pid, CAST(l_linenumber AS VARCHAR) AS block, CASE WHEN l_partkey % 9 > 0 THEN l_returnflag ELSE '' END AS recipient, CASE WHEN l_partkey % 2 = 0 THEN ' 1' END AS number,
  CAST(l_quantity AS BIGINT) AS total, CASE WHEN l_partkey % 4 > 0 THEN 'c' || l_partkey % 6 ELSE '' END AS contract, l_orderkey * 100000 + l_partkey AS no FROM lineitem),
q AS (SELECT *, trim(COALESCE(number, '')) AS n FROM l WHERE recipient <> ''),
c AS (SELECT pid, block, recipient, n, contract, MIN(no) AS no FROM q WHERE contract <> '' GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT o_custkey % 100 AS pid, CAST(o_orderkey % 7 AS VARCHAR) AS block, CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE 'N' END AS recipient, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '' END AS n,
      CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount FROM orders WHERE o_orderkey % 3 > 0 OR o_orderstatus <> 'F')
SELECT r.*, COALESCE(array_to_string(k.cs, '/'), '') AS contracts, COALESCE(y.k, 0) AS expenses, CAST(COALESCE(y.a, 0) AS BIGINT) AS expense_amount
FROM (SELECT pid, block, recipient, n AS number, MAX(total) AS amount FROM q GROUP BY 1, 2, 3, 4) r
LEFT JOIN (SELECT pid, block, recipient, n, list(contract ORDER BY no, contract) AS cs FROM c GROUP BY 1, 2, 3, 4) k ON k.pid = r.pid AND k.block = r.block AND k.recipient = r.recipient AND k.n = r.number
LEFT JOIN (SELECT pid, block, recipient, n, COUNT(*) AS k, SUM(amount) AS a FROM x GROUP BY 1, 2, 3, 4) y ON y.pid = r.pid AND y.block = r.block AND y.recipient = r.recipient AND y.n = r.number""")
def block_recipient_expenses(spark, sf_dir):
    k, o = F.col("l_partkey"), F.col("o_orderkey")
    rows = A.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pid"), F.col("l_linenumber").cast("string").alias("block"), F.when(k % 9 > 0, F.col("l_returnflag")).otherwise("").alias("recipient"),
        F.when(k % 2 == 0, " 1").alias("number"), F.col("l_quantity").cast("long").alias("total"), F.when(k % 4 > 0, F.concat(F.lit("c"), k % 6)).otherwise("").alias("contract"),
        (F.col("l_orderkey") * 100000 + k).alias("line_no"))
    expenses = A.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("pid"), (o % 7).cast("string").alias("block"), F.when(o % 5 == 0, "A").otherwise("N").alias("recipient"), F.when(o % 2 == 0, "1").otherwise("").alias("number"),
        F.when(o % 3 > 0, "category").otherwise(" ").alias("category"), F.when(F.col("o_orderstatus") != "F", "purpose").alias("purpose"), A.cents("o_totalprice").alias("amount"))
    return blocks.recipient_expenses(blocks.block_recipients(rows), expenses).withColumn("contracts", F.array_join("contracts", "/"))


@query("""
WITH x AS (SELECT 'size' AS metric, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'price', p_retailprice FROM part WHERE p_partkey % 3 > 0),
r AS (SELECT metric, v, ROW_NUMBER() OVER (PARTITION BY metric ORDER BY v) - 1 AS i, COUNT(*) OVER (PARTITION BY metric) AS n FROM x)
SELECT metric, MAX(n) AS n, ROUND(AVG(v), 6) AS mean, MAX(v) FILTER (WHERE i = n // 2) AS median, MIN(v) AS least, MAX(v) AS most FROM r GROUP BY 1""")
def metric_summary(spark, sf_dir):
    rows = A.table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).alias("price"))
    return pages.metric_summary(rows, ["size", "price"]).withColumn("mean", F.round("mean", 6))


@query("""
SELECT c_custkey AS pid, o.n AS x, c_acctbal AS y, c_nationkey AS cluster, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey % 2 ELSE c_mktsegment END AS category,
       CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 101 END AS overall
FROM customer JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def map_points(spark, sf_dir):
    c, k = A.table(spark, sf_dir, "customer"), F.col("c_custkey")
    points = c.select(k.alias("pid"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("cluster"))
    counts = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pid")).agg(F.count(F.lit(1)).alias("x"))
    quality = c.select(k.alias("pid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category")).join(counts, "pid")
    policy = c.where("c_custkey % 3 = 0").select(k.alias("pid"), (k % 101).alias("overall"), F.lit(1).alias("proportionality"), F.lit(2).alias("necessity"),
                                                 F.concat(F.lit("p"), k % 2).alias("category"), F.lit("r").alias("recommendation"))
    return pages.map_points(points, quality, policy).select("pid", "x", "y", "cluster", "name", "category", "overall")


@query("""
WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, SUM(1 - list_cosine_similarity(a.e, b.e)) AS s, COUNT(*) AS n FROM u a JOIN u b ON b.vec_id <> a.vec_id GROUP BY 1, 2, 3),
p AS (SELECT vec_id, MAX(s / n) FILTER (WHERE own = other) AS a, MIN(s / n) FILTER (WHERE own <> other) AS b FROM d GROUP BY 1)
SELECT ROUND(AVG(CASE WHEN a IS NULL OR GREATEST(a, b) = 0 THEN 0 ELSE (b - a) / GREATEST(a, b) END), 6) AS silhouette FROM p""")
def silhouette(spark, sf_dir):
    return stats.silhouette(A.table(spark, sf_dir, "embeddings").where("label is not null"), "embedding", "label").select(F.round("silhouette", 6).alias("silhouette"))


@query("""
WITH u AS (SELECT vec_id AS id, label AS cluster, vec_id % 7 * 0.25 AS x, vec_id % 11 * 0.5 AS y, 'k' || vec_id % 5 AS category, 'm' || vec_id % 6 AS ministry, CAST(embedding AS DOUBLE[]) AS e
           FROM embeddings WHERE label IS NOT NULL),
z AS (SELECT id, cluster, UNNEST(list_transform(e, lambda v: v / sqrt(list_inner_product(e, e)))) AS v, UNNEST(range(len(e))) AS i FROM u),
c AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, SUM(v) AS m FROM z GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT u.cluster, id, FLOOR(list_cosine_similarity(e, c) * 1e9 + 0.5) AS sim FROM u JOIN c USING (cluster)),
d AS (SELECT cluster, id, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY sim DESC, id) AS r FROM s),
k AS (SELECT cluster, category, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY COUNT(*) DESC, category) AS r FROM u GROUP BY 1, 2),
m AS (SELECT cluster, ministry, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY COUNT(*) DESC, ministry) AS r FROM u GROUP BY 1, 2)
SELECT b.cluster, b.n, cx, cy, k.category, ROUND(k.n / b.n, 3) AS share, mm.ministries, d.id AS medoid
FROM (SELECT cluster, COUNT(*) AS n, ROUND(AVG(x::DOUBLE), 3) AS cx, ROUND(AVG(y::DOUBLE), 3) AS cy FROM u GROUP BY 1) b JOIN k ON k.cluster = b.cluster AND k.r = 1
JOIN d ON d.cluster = b.cluster AND d.r = 1 JOIN (SELECT cluster, string_agg(ministry, '/' ORDER BY r) AS ministries FROM m WHERE r <= 3 GROUP BY 1) mm ON mm.cluster = b.cluster""")
def cluster_labels(spark, sf_dir):
    k = F.col("vec_id")
    rows = A.table(spark, sf_dir, "embeddings").where("label is not null").select(
        k.alias("id"), F.col("label").alias("cluster"), (k % 7 * 0.25).alias("x"), (k % 11 * 0.5).alias("y"), F.concat(F.lit("k"), k % 5).alias("category"),
        F.concat(F.lit("m"), k % 6).alias("ministry"), "embedding")
    return stats.cluster_labels(rows, "embedding").withColumn("ministries", F.array_join("ministries", "/"))


@query("WITH " + model_sql() + """
SELECT pid, id, ROUND(CASE WHEN SUM(amount) OVER (PARTITION BY pid) > 0 THEN amount::DOUBLE / SUM(amount) OVER (PARTITION BY pid) ELSE 0 END, 9) AS share FROM e""")
def share_within(spark, sf_dir):
    e = A.graph(spark, sf_dir, YEAR).edges.where("target like 'r-%'").select(F.regexp_extract("source", "[0-9]+$", 0).cast("long").alias("pid"), F.col("target").alias("id"), "value")
    return stats.share_within(e, "pid", "value").select("pid", "id", F.round("share", 9).alias("share"))


@query("""
WITH a AS (SELECT o_custkey AS pid, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS ours FROM orders WHERE o_orderkey % 50 > 0 GROUP BY 1),
b AS (SELECT o_custkey AS pid, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS theirs FROM orders WHERE o_custkey % 40 > 0 GROUP BY 1)
SELECT COALESCE(a.pid, b.pid) AS pid, ours, theirs FROM a FULL OUTER JOIN b ON a.pid = b.pid WHERE ours IS DISTINCT FROM theirs""")
def differing_sums(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pid"), A.cents("o_totalprice").alias("amount"))
    return budget.differing(rows.where("o_orderkey % 50 > 0"), rows.where("pid % 40 > 0"), ["pid"], "amount")


@query("""
SELECT kind, COUNT(*) AS n, COUNT(*) FILTER (WHERE r) AS reference, COUNT(*) FILTER (WHERE t) AS transfer, COUNT(*) FILTER (WHERE i) AS institutional FROM
(SELECT o_orderstatus AS kind, contains(v, '参考') AS r, contains(v, '移替') AS t, contains(v, '融資') OR contains(v, '利子補給') AS i FROM
 (SELECT *, COALESCE([o_orderpriority || '(参考)', '移替え参考', '民間融資', '利子補給金', NULL, ''][o_orderkey % 6 + 1], '') AS v FROM orders)) GROUP BY 1""")
def note_kinds(spark, sf_dir):
    notes = F.array(F.concat("o_orderpriority", F.lit("(参考)")), *[F.lit(x) for x in ("移替え参考", "民間融資", "利子補給金", None, "")])
    kinds = S.note_kinds(F.get(notes, (F.col("o_orderkey") % 6).cast("int")))
    return A.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in kinds.items()])


@query("""
WITH r AS (SELECT o_orderkey, c_name AS recipient, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE ' ' END AS number, o_orderkey % 4 = 0 AS verified, c_custkey % 2 = 0 AS named, c_acctbal > 0 AS good,
 c_mktsegment = 'BUILDING' AS gov, c_nationkey < 5 AS supp FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, CASE WHEN NOT named THEN CASE WHEN verified THEN 'cn' ELSE 'unknown' END
 WHEN good THEN CASE WHEN trim(number) <> '' THEN 'valid' ELSE 'invalid' END WHEN gov THEN 'gov' WHEN supp THEN 'supp' WHEN verified THEN 'cn' ELSE 'invalid' END AS status FROM r""")
def dictionary_status(spark, sf_dir):
    """The tiers over dictionaries that are made of the customers."""
    k, c = F.col("o_orderkey"), A.table(spark, sf_dir, "customer")
    rows = A.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_name").alias("recipient"), F.when(k % 3 > 0, F.col("o_orderstatus")).otherwise(" ").alias("number"), (k % 4 == 0).alias("verified"))
    name = F.col("c_name").alias("name")
    return screening.row_status(rows, c.where("c_custkey % 2 = 0").select(name, (F.col("c_acctbal") > 0).alias("good")), c.where("c_mktsegment = 'BUILDING'").select(name),
                                c.where("c_nationkey < 5").select(name)).select("o_orderkey", "status")
