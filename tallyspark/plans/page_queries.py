"""Queries of the pages' predicates, facets, search, sorts, ranks, legends, and of policy decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import decision, pages
from tallyspark.plans import adapter as A

from .catalog import query
from .flow_queries import YEAR, model_sql


@query("""
SELECT p_partkey AS pid, p_name AS name, p_size AS score FROM part
WHERE p_type IN ('STANDARD', 'PROMO', 'ECONOMY') AND NULLIF(p_size % 7, 0) BETWEEN 2 AND 5 AND p_retailprice >= 905 AND (contains(lower(p_name), 'ing') OR contains(lower(p_brand), 'ing'))""")
def table_predicates(spark, sf_dir):
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("name"), F.col("p_brand").alias("bureau"), F.col("p_type").alias("category"),
                                                 F.col("p_size").alias("score"), F.nullif(F.col("p_size") % 7, F.lit(0)).alias("years"), F.col("p_retailprice").alias("budget"))
    kept = pages.within(pages.equal_to(rows, {"category": ["STANDARD", "PROMO", "ECONOMY"]}), {"years": (2, 5), "budget": (905, None)})
    return pages.containing(kept, "ING", ["name", "bureau"]).select("pid", "name", "score")


@query("""
WITH l AS (SELECT l_orderkey AS pid, bool_or(l_returnflag = 'R') AS merged, bool_or(l_linestatus = 'F') AS separate FROM lineitem GROUP BY 1)
SELECT o_orderkey AS pid, merged, separate FROM orders JOIN l ON l.pid = o_orderkey WHERE (merged OR separate) AND o_totalprice <= 300000 AND
(contains(CAST(o_orderkey AS VARCHAR), '77') OR contains(o_orderpriority, '77')
 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE contains('block ' || l_linenumber || l_returnflag, '77'))
 OR o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE contains(s_name, '77')))""")
def nested_predicates(spark, sf_dir):
    line = A.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "pid")
    flags = line.groupBy("pid").agg(F.bool_or(F.col("l_returnflag") == "R").alias("merged"), F.bool_or(F.col("l_linestatus") == "F").alias("separate"))
    projects = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_orderpriority").alias("name"), F.lit("").alias("ministry"), F.col("o_totalprice").alias("budget"))
    supplier = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("recipient"))
    found = pages.nested_search(pages.within(projects, {"budget": (None, 300000)}), line.select("pid", F.concat(F.lit("block "), "l_linenumber", "l_returnflag").alias("block")),
                                line.join(supplier, "l_suppkey").select("pid", "recipient"), "77")
    return pages.any_flag(found.join(flags, "pid"), ["merged", "separate"]).select("pid", "merged", "separate")


@query("""
SELECT 'status' AS facet, o_orderstatus AS value, COUNT(*) AS n FROM orders GROUP BY 2 UNION ALL
SELECT 'priority', o_orderpriority, COUNT(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 UNION ALL
SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), COUNT(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%' GROUP BY 2""")
def cascading_facets(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("full"), F.year("o_orderdate").alias("year"))
    first = F.when(F.col("full").startswith("1"), "1").otherwise(F.substring("full", 1, 1))
    f = pages.facets(rows.select("status", F.col("full").alias("priority"), first.alias("rank"), "year"), {"status": "F", "priority": None})
    deep = pages.facets(rows.withColumn("rank", first), {"status": "F", "rank": "1", "year": None})
    return f.unionByName(deep.where("facet = 'year'"))


@query("WITH " + model_sql() + """,
x AS (SELECT 'project-budget-' || pid AS id, name, 'project-spending' AS type, spent AS value, GREATEST(spent, budget) AS sort_value, pid AS project_id, budget FROM p
      WHERE ministry IN ('NATION_3', 'NATION_7') AND contains(lower(name), 'r#0000000')
      UNION ALL SELECT DISTINCT r.id, r.recipient, 'recipient', r.total, r.total, NULL::BIGINT, NULL::BIGINT FROM r JOIN s ON s.recipient = r.recipient JOIN p ON p.pid = s.pid
      WHERE p.ministry IN ('NATION_3', 'NATION_7') AND contains(lower(r.recipient), 'r#0000000'))
SELECT id, name, type, value, sort_value, CAST(project_id AS VARCHAR) AS project_id, budget FROM x ORDER BY sort_value DESC, id LIMIT 50""")
def node_search(spark, sf_dir):
    g = A.graph(spark, sf_dir, YEAR)
    return pages.node_search(g.nodes, g.edges, " R#0000000 ", ministries=("NATION_3", "NATION_7"), size=50).withColumn("project_id", F.col("project_id").cast("string"))


@query("WITH " + model_sql() + """
SELECT 'project-budget-' || pid AS id, name, spent AS value, budget FROM p WHERE pid = 7""")
def node_by_number(spark, sf_dir):
    g = A.graph(spark, sf_dir, YEAR)
    return pages.node_search(g.nodes, g.edges, "007").select("id", "name", "value", "budget")


@query("WITH " + model_sql() + """
SELECT GREATEST(1000, CAST(CEIL((SELECT MAX(budget) FROM p) / 1e8 / 1000) * 1000 AS BIGINT)) AS max_budget,
       GREATEST(1000, CAST(CEIL(GREATEST((SELECT MAX(spent) FROM p), (SELECT MAX(total) FROM r)) / 1e8 / 1000) * 1000 AS BIGINT)) AS max_spending""")
def slider_limits(spark, sf_dir):
    return pages.slider_limits(A.graph(spark, sf_dir, YEAR).nodes)


@query("""
SELECT id, place FROM (SELECT c_custkey AS id, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place FROM customer) WHERE id IN (3, 14, 59)""")
def places_of(spark, sf_dir):
    return pages.places_of(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id", "c_acctbal", [3, 14, 59])


@query("""
SELECT id, code FROM (SELECT p_partkey AS id, CAST(NULLIF(p_size, 1) AS VARCHAR) AS code, NULLIF(p_size, 1) AS k FROM part) ORDER BY k DESC NULLS LAST, id LIMIT 30 OFFSET 20""")
def sorted_codes(spark, sf_dir):
    rows = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.nullif("p_size", F.lit(1)).cast("string").alias("code"))
    return pages.sorted_page(rows, "code", "id", descending=True, offset=20, limit=30)


@query("""SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_name, p_partkey LIMIT 40""")
def sorted_names(spark, sf_dir):
    return pages.sorted_page(A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "name", "id", limit=40)


@query("""
WITH g AS (SELECT p_brand AS key, COUNT(*) AS n, CAST(SUM(CAST(ROUND(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS value FROM part GROUP BY 1),
k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, key) <= 6 OR ROW_NUMBER() OVER (ORDER BY value DESC, key) <= 6 AS top FROM g),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY top ORDER BY n DESC, key) AS slot FROM k), w AS (SELECT *, top AND slot <= 8 AS own FROM o)
SELECT CAST(slot AS INTEGER) AS slot, key, n, value, CAST(1 AS BIGINT) AS members FROM w WHERE own UNION ALL
SELECT 9, '__other__', CAST(SUM(n) AS BIGINT), CAST(SUM(value) AS BIGINT), COUNT(*) FROM w WHERE NOT own HAVING COUNT(*) > 0""")
def legend_slots(spark, sf_dir):
    return pages.legend(A.table(spark, sf_dir, "part").withColumn("v", A.cents("p_retailprice")), "p_brand", "v", 6, 8)


@query("""
WITH v AS (SELECT ROW_NUMBER() OVER (ORDER BY o_totalprice) - 1 AS i, COUNT(*) OVER () AS n, o_totalprice AS v FROM orders)
SELECT MAX(v) FILTER (WHERE i = FLOOR((n - 1) * 0.5 + 0.5)) AS t50, MAX(v) FILTER (WHERE i = FLOOR((n - 1) * 0.9 + 0.5)) AS t90, MAX(v) FILTER (WHERE i = n - 1) AS t100 FROM v""")
def quantile_ticks(spark, sf_dir):
    return pages.ticks(A.table(spark, sf_dir, "orders"), "o_totalprice")


@query("""
WITH x AS (SELECT l_quantity * 2.5 AS v FROM lineitem), s AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS i, COUNT(*) OVER () AS m FROM x),
p AS (SELECT """ + ", ".join(f"MAX(v) FILTER (WHERE i = FLOOR((m - 1) * {q / 100})) AS p{q}" for q in (1, 5, 10, 25, 50, 75, 90, 99)) + """ FROM s)
SELECT COUNT(v) AS n, ROUND(STDDEV_POP(v), 6) AS stddev, ROUND(AVG(CASE WHEN v >= 100 THEN 1.0 ELSE 0 END), 6) AS ceiling_share, COUNT(DISTINCT v) AS distinct, p.*, p75 - p25 AS iqr
FROM x, p GROUP BY ALL""")
def percentile_summary(spark, sf_dir):
    s = pages.percentile_summary(A.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 2.5).alias("v")), "v")
    return s.withColumns({c: F.round(c, 6) for c in ("stddev", "ceiling_share")})


DECIDED = """
WITH i AS (SELECT p_partkey AS pid, p_size % 5 AS readiness, (p_partkey % 11) / 10.0::DOUBLE AS confidence, p_partkey % 5 AS outcome, p_size % 4 AS causal, NULLIF(p_partkey % 6, 5) AS cost,
 p_partkey % 3 + 1 AS durability, p_size % 5 AS alternative, p_partkey % 4 AS duplication, NULLIF(p_size % 6, 5) AS obsolescence, p_partkey % 9 = 0 AS legal,
 p_size % 3 + 2 AS va, p_partkey % 2 = 0 AS va_applies, NULLIF(p_partkey % 7, 6) AS vb, p_size % 2 = 0 AS vb_applies FROM part),
s AS (SELECT *, FLOOR((outcome * 25 * 35 + causal * 25 * 25 + cost * 25 * 20 + durability * 25 * 20) / 100.0::DOUBLE * 10 + 0.5) / 10 AS effect_score,
 FLOOR((CASE WHEN va_applies THEN va * 25 ELSE 0 END + CASE WHEN vb_applies THEN vb * 25 ELSE 0 END) / NULLIF(va_applies::INT + vb_applies::INT, 0)::DOUBLE * 10 + 0.5) / 10 AS value_score FROM i),
d AS (SELECT *, CASE WHEN readiness >= 3 AND confidence >= 0.7 THEN FLOOR(((100 - effect_score) * 30 + (100 - value_score) * 25 + alternative * 25 * 15 + duplication * 25 * 15
 + (100 - cost * 25) * 10 + obsolescence * 25 * 5) / 100.0::DOUBLE * 10 + 0.5) / 10 END AS priority_score FROM s),
r AS (SELECT *, CASE WHEN priority_score IS NULL THEN 'EVIDENCE_REQUIRED' WHEN legal AND priority_score >= 50 THEN 'REFORM_LEGAL_SCHEME' WHEN legal THEN 'CONTINUE_WITH_IMPROVEMENT'
 WHEN priority_score >= 70 THEN 'ABOLITION_CANDIDATE' WHEN priority_score >= 50 THEN 'REDUCE_OR_RESTRUCTURE' WHEN effect_score >= 70 AND value_score >= 70 THEN 'CONTINUE'
 ELSE 'CONTINUE_WITH_IMPROVEMENT' END AS recommendation FROM d)
SELECT pid, effect_score, value_score, priority_score, recommendation, priority_score IS NULL OR legal OR recommendation = 'ABOLITION_CANDIDATE' AS human_decision FROM r"""


@query(DECIDED)
def policy_decisions(spark, sf_dir):
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = A.table(spark, sf_dir, "part").select(
        k.alias("pid"), (z % 5).alias("readiness"), (k % 11 / 10).alias("confidence"), (k % 5).alias("outcome"), (z % 4).alias("causal"), F.nullif(k % 6, F.lit(5)).alias("cost"),
        (k % 3 + 1).alias("durability"), (z % 5).alias("alternative"), (k % 4).alias("duplication"), F.nullif(z % 6, F.lit(5)).alias("obsolescence"), (k % 9 == 0).alias("legal"),
        (z % 3 + 2).alias("va"), (k % 2 == 0).alias("va_applies"), F.nullif(k % 7, F.lit(6)).alias("vb"), (z % 2 == 0).alias("vb_applies"))
    return decision.decisions(rows, ["va", "vb"]).select("pid", "effect_score", "value_score", "priority_score", "recommendation", "human_decision")
