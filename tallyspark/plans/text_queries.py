"""Queries of counted spending rows, recipients by project, text normalisation, rule-based effect scores, answers of a bounded size, and how scores use their scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import money
from tallyspark.functions.normalise import normalised
from tallyspark.operators import flow, review, shaping, stats
from tallyspark.plans import adapter as A
from tallyspark.tables import spread

from .catalog import query
from .flow_queries import YEAR, model_sql

# ---- spending rows ------------------------------------------------------------------------------------------------------------

SPENT = """WITH l AS (SELECT o_custkey AS pid, CASE WHEN l_linenumber = 7 THEN ' ' ELSE s_name END AS recipient, CAST(trunc(l_quantity) AS BIGINT) * CASE WHEN l_tax = 0 THEN 0 ELSE 1 END AS amount,
 CASE WHEN l_quantity > 45 THEN '' ELSE l_returnflag END AS block, l_linestatus = 'F' AS flag, l_partkey % 3 = 0 AS linked FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey),
p AS (SELECT c_custkey AS pid FROM customer WHERE c_mktsegment <> 'BUILDING'),
m AS (SELECT pid, block FROM l WHERE linked GROUP BY 1, 2 HAVING NOT BOOL_OR(flag)),
k AS (SELECT l.*, CASE WHEN trim(recipient) = '' THEN 'no name' WHEN amount <= 0 THEN 'no amount' WHEN l.block = '' THEN 'no block' WHEN m.pid IS NOT NULL THEN 'indirect' ELSE 'direct' END AS kind
 FROM l SEMI JOIN p USING (pid) LEFT JOIN m ON m.pid = l.pid AND m.block = l.block)"""


def spent_rows(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("o_custkey").alias("pid"), F.when(F.col("l_linenumber") == 7, " ").otherwise(F.col("s_name")).alias("recipient"),
                       (F.col("l_quantity").cast("long") * F.when(F.col("l_tax") == 0, 0).otherwise(1)).alias("amount"),
                       F.when(F.col("l_quantity") > 45, "").otherwise(F.col("l_returnflag")).alias("block"), (F.col("l_linestatus") == "F").alias("flag"), (F.col("l_partkey") % 3 == 0).alias("linked"))
    projects = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("pid"))
    return flow.counted_rows(rows.drop("flag", "linked"), projects, rows.where("linked").select("pid", "block", "flag"))


@query(SPENT + " SELECT x.kind, COUNT(k.kind) AS n, CAST(COALESCE(SUM(amount), 0) AS BIGINT) AS amount FROM (VALUES ('no name'), ('no amount'), ('no block'), ('indirect'), ('direct')) x(kind) "
       "LEFT JOIN k ON k.kind = x.kind GROUP BY 1")
def spending_counts(spark, sf_dir):
    counts = spent_rows(spark, sf_dir)[1]
    return spark.createDataFrame([(k, *v) for k, v in counts.items()], "kind string, n long, amount long")


@query(SPENT + " SELECT pid, recipient, CAST(SUM(amount) AS BIGINT) AS amount FROM k WHERE kind = 'direct' GROUP BY 1, 2")
def direct_recipients(spark, sf_dir):
    return spent_rows(spark, sf_dir)[0].where("kind = 'direct'").groupBy("pid", "recipient").agg(F.sum("amount").alias("amount"))


@query("WITH " + model_sql() + """,
n AS (SELECT o_custkey AS pid, s_name AS recipient, lpad(CAST(l_suppkey AS VARCHAR), 13, '0') AS number FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)
SELECT s.recipient, s.pid, s.amount, string_agg(number, ',' ORDER BY number) AS numbers FROM s JOIN n USING (pid, recipient) GROUP BY 1, 2, 3""")
def recipient_projects(spark, sf_dir):
    return flow.recipient_projects(A.spending(spark, sf_dir, YEAR)).withColumn("numbers", F.array_join("numbers", ","))


# ---- texts --------------------------------------------------------------------------------------------------------------------

@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '12' ELSE '1' END || p_name || ' ' || (2019 + p_size % 9) || '年度(' || p_brand || ')アイース' || p_type || ' - サーバ' || (1989 + p_size) || '年,'
|| (1925 + p_size) || '年' AS text FROM part""")
def normalised_texts(spark, sf_dir):
    n = F.col("p_size") % 9
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, "⑫").otherwise("①"), "p_name", F.lit("　令和"), F.when(n == 0, "元").otherwise((n + 1).cast("string")), F.lit("年度（"), "p_brand", F.lit("）ｱｲ－ｽ"), "p_type",
                    F.lit("   – サ ー ー  バ 平成 "), (F.col("p_size") + 1).cast("string"), F.lit("年, 昭和"), "p_size", F.lit("年 "))
    out = spread(A.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(F.col("p_partkey").alias("id"), normalised(text).alias("text"))
    return out.withColumn("text", F.replace("text", F.lit("バ 1"), F.lit("バ1"))).withColumn("text", F.replace(F.replace("text", F.lit("バ 2"), F.lit("バ2")), F.lit(", "), F.lit(",")))


TEXTS = {"purpose": ("国民の安全", "地域の教育と雇用", "", "aiを普及"), "issues": ("年間12 件", "件数は不明", "約３割", "")}


@query(f"""WITH t AS (SELECT p_partkey AS id, ['国民の安全', '地域の教育と雇用', '', 'AIを普及'][p_partkey % 4 + 1] AS purpose, ['年間12 件', '件数は不明', '約3割', ''][p_size % 4 + 1] AS issues,
 repeat('あ', p_size * 2) || p_type AS overview FROM part),
x AS (SELECT *, length(trim(purpose)) + length(overview) AS body, purpose || chr(10) || overview || chr(10) || issues AS whole FROM t),
y AS (SELECT *, len(list_distinct(regexp_extract_all(whole, '({review.BENEFITS})', 1))) AS hits, regexp_matches(whole, '{review.NUMBERS}') AS num FROM x)
SELECT id, CASE WHEN body < 20 THEN 0 ELSE LEAST(10, 3 + 2 * (body >= 60)::INT + 2 * (hits >= 2)::INT + 2 * (hits >= 4)::INT + num::INT) END AS effective FROM y""")
def effect_scores(spark, sf_dir):
    pick = lambda c, k: F.element_at(F.array(*map(F.lit, TEXTS[c])), (F.col(k) % 4 + 1).cast("int")).alias(c)
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick("purpose", "p_partkey"), pick("issues", "p_size"),
                                                 F.concat(F.repeat(F.lit("あ"), F.col("p_size") * 2), "p_type").alias("overview"))
    return review.effects(rows).select("id", "effective")


HALVED = "CASE WHEN 28 + 13 * {0} > 100 AND {0} > 1 THEN CAST(ceil({0} / 2.0) AS BIGINT) ELSE {0} END"


@query("WITH n0 AS (SELECT o_custkey AS id, COUNT(*) AS n FROM orders GROUP BY 1)" + "".join(f", n{i + 1} AS (SELECT id, {HALVED.format('n')} AS n FROM n{i})" for i in range(5)) + """,
k AS (SELECT o_custkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rk FROM orders)
SELECT id, string_agg(key, ',' ORDER BY rk) AS keys FROM k JOIN n5 USING (id) WHERE rk <= n GROUP BY 1""")
def clamped_answers(spark, sf_dir):
    key = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    rows = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(key)).alias("keys"))
    return shaping.clamped_payload(rows.withColumn("name", F.lpad(F.col("id").cast("string"), 8, "0")), ["name", "keys"], ["keys"], 100).select("id", F.array_join("keys", ",").alias("keys"))


# ---- scales -------------------------------------------------------------------------------------------------------------------

@query("""WITH v AS (SELECT p_size / 4.0::DOUBLE AS v FROM part), s AS (SELECT v, COUNT(*) AS c FROM v GROUP BY 1),
l AS (SELECT g AS l, COALESCE(SUM(c), 0) AS c FROM generate_series(0, 10) t(g) LEFT JOIN s ON LEAST(10, GREATEST(0, FLOOR(v + 0.5))) = g GROUP BY 1),
b AS (SELECT l, w, SUM(c2) AS c FROM (SELECT a.l, w, z.c AS c2 FROM l a, generate_series(1, 11) t(w), l z WHERE z.l BETWEEN a.l AND a.l + w - 1 AND a.l + w <= 11) GROUP BY 1, 2),
n AS (SELECT SUM(c) AS n, COUNT(*) AS d, SUM(c * (c - 1)) AS ties FROM s)
SELECT CAST(n AS BIGINT) AS n, d AS "distinct", (SELECT CAST(COUNT(*) AS INTEGER) FROM l WHERE c > 0) AS used, ROUND(ties::DOUBLE / (n * (n - 1)), 6) AS tie_rate,
 ROUND((SELECT -SUM(c / n * ln(c / n)) FROM l WHERE c > 0) / ln(11), 6) AS entropy, ROUND((SELECT MAX(c) FROM b WHERE w = 3)::DOUBLE / n, 6) AS band_share,
 (SELECT MIN(l) FROM b WHERE w = 3 AND c = (SELECT MAX(c) FROM b WHERE w = 3)) AS band_from, (SELECT CAST(MIN(w) AS INTEGER) FROM b WHERE c / n >= 0.8) AS cover_width,
 ROUND((SELECT SUM(c) FROM l WHERE l < 2)::DOUBLE / n, 6) AS low_share, ROUND((SELECT SUM(c) FROM l WHERE l > 8)::DOUBLE / n, 6) AS high_share FROM n""")
def score_levels(spark, sf_dir):
    r = stats.levels(A.table(spark, sf_dir, "part").select((F.col("p_size") / 4.0).alias("v")), "v", 0, 10)
    return r.select("n", "distinct", "used", *[F.round(c, 6).alias(c) for c in ("tie_rate", "entropy", "band_share")], F.col("band_from").cast("long").alias("band_from"), "cover_width",
                    *[F.round(c, 6).alias(c) for c in ("low_share", "high_share")])


@query("""WITH c AS (SELECT p_brand AS a, p_type AS b, COUNT(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT SUM(n)::DOUBLE AS n, SUM(n * ln(n)) AS l FROM c),
x AS (SELECT SUM(m * ln(m)) AS l FROM (SELECT SUM(n) AS m FROM c GROUP BY a)), y AS (SELECT SUM(m * ln(m)) AS l FROM (SELECT SUM(n) AS m FROM c GROUP BY b))
SELECT ROUND(2 * (ln(t.n) + (t.l - x.l - y.l) / t.n) / (2 * ln(t.n) - (x.l + y.l) / t.n), 6) AS nmi FROM t, x, y""")
def mutual_information(spark, sf_dir):
    return stats.agreement(A.table(spark, sf_dir, "part"), "p_brand", "p_type").select(F.round("nmi", 6).alias("nmi"))


# ---- amounts ------------------------------------------------------------------------------------------------------------------

PLACES = "(({0} + {1} // 2) // {1}) // {2} || '.' || lpad(CAST((({0} + {1} // 2) // {1}) % {2} AS VARCHAR), {3}, '0')"


@query(f"""WITH a AS (SELECT o_orderkey AS id, CAST(ROUND(o_totalprice * 100) AS BIGINT) * [1, 1000, 1000000][o_orderkey % 3 + 1] AS v FROM orders)
SELECT id, CASE WHEN v >= 1000000000000 THEN {PLACES.format('v', 10**10, 100, 2)} || '兆円' WHEN v >= 100000000 THEN {PLACES.format('v', 10**7, 10, 1)} || '億円'
 WHEN v >= 10000 THEN format('{{:,}}', (v + 5000) // 10000) || '万円' ELSE format('{{:,}}', v) || '円' END AS short,
CASE WHEN v >= 1000000000000 THEN {PLACES.format('v', 10**11, 10, 1)} || '兆円' ELSE (v + 50000000) // 100000000 || '億円' END AS oku,
CASE WHEN v >= 1000000000000 THEN {PLACES.format('v', 10**10, 100, 2)} || '兆円' WHEN v >= 100000000 THEN {PLACES.format('v', 10**6, 100, 2)} || '億円'
 WHEN v >= 10000 THEN {PLACES.format('v', 100, 100, 2)} || '万円' ELSE format('{{:,}}', v) || '円' END AS plain FROM a""")
def yen_labels(spark, sf_dir):
    v = A.cents("o_totalprice") * F.element_at(F.array(*[F.lit(x) for x in (1, 1000, 1000000)]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), v.alias("v"))
    return rows.select("id", money.yen_short(F.col("v")).alias("short"), money.oku(F.col("v")).alias("oku"), money.budget_from_yen(F.col("v")).alias("plain"))
