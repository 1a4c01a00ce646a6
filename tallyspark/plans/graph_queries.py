"""Block graph, recipient and screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import semantics as S
from tallyspark.operators import blocks, recipients, screening, summary
from tallyspark.operators.flow import Graph
from tallyspark.plans import adapter as A

from .catalog import query
from .flow_queries import YEAR, model_sql


def flows(spark, sf_dir):
    """Lines of an order in their order: from each line's part type to the next; the first comes from the organisation."""
    from pyspark.sql.window import Window

    lines = A.lines(spark, sf_dir, YEAR).join(A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.select("pid", F.lag("p_type").over(order).alias("source"), F.col("p_type").alias("target"), "amount", F.col("l_returnflag").alias("note"))


FLOWS = "WITH RECURSIVE " + model_sql() + """,
fl AS (SELECT o_custkey AS pid, LAG(p_type) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS source,
       p_type AS target, CAST(ROUND(l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT)) AS amount, l_returnflag AS note
       FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
ed AS (SELECT DISTINCT pid, source, target FROM fl WHERE source IS NOT NULL)"""


@query(FLOWS + """
SELECT pid, source, target, COUNT(*) AS n, array_to_string(list_sort(list(DISTINCT note)), ' / ') AS notes FROM fl GROUP BY 1, 2, 3""")
def merge_parallel(spark, sf_dir):
    return blocks.merge_parallel(flows(spark, sf_dir))


@query(FLOWS + """,
w AS (SELECT DISTINCT pid, target AS block, 1 AS depth, '組織→' || target AS chain FROM fl WHERE source IS NULL
      UNION ALL SELECT w.pid, ed.target, w.depth + 1, w.chain || '→' || ed.target FROM w JOIN ed ON ed.pid = w.pid AND ed.source = w.block WHERE NOT contains(w.chain || '→', '→' || ed.target || '→'))
SELECT pid, block, CAST(depth AS INTEGER) AS depth, MIN(chain) AS chain FROM w JOIN (SELECT pid, block, MIN(depth) AS depth FROM w GROUP BY 1, 2) USING (pid, block, depth) GROUP BY 1, 2, 3""")
def order_chains(spark, sf_dir):
    return blocks.shortest_depths(flows(spark, sf_dir), chains=True)


@query(FLOWS + """,
d AS (SELECT DISTINCT pid, target AS block, 1 AS depth FROM fl WHERE source IS NULL
      UNION SELECT d.pid, ed.target, d.depth + 1 FROM d JOIN ed ON ed.pid = d.pid AND ed.source = d.block WHERE d.depth < 30)
SELECT pid, block, CAST(MIN(depth) AS INTEGER) AS depth FROM d GROUP BY 1, 2""")
def block_depth_shortest(spark, sf_dir):
    return blocks.shortest_depths(flows(spark, sf_dir))


@query(FLOWS + """,
d AS (SELECT DISTINCT pid, target AS block, 1 AS depth FROM fl WHERE source IS NULL
      UNION SELECT d.pid, ed.target, d.depth + 1 FROM d JOIN ed ON ed.pid = d.pid AND ed.source = d.block WHERE d.depth < 30)
SELECT pid, CAST(MAX(depth) AS INTEGER) AS max_depth FROM d GROUP BY 1""")
def block_depth_longest(spark, sf_dir):
    return blocks.longest_depth(flows(spark, sf_dir))


@query(FLOWS + """,
t AS (SELECT pid, target, COUNT(*) AS w FROM ed GROUP BY 1, 2), s2 AS (SELECT pid, source, COUNT(*) AS w FROM ed GROUP BY 1, 2),
a AS (SELECT pid, COUNT(*) FILTER (WHERE w >= 2) AS merge_count, MAX(w) AS max_merge_width FROM t GROUP BY 1),
c AS (SELECT pid, COUNT(*) FILTER (WHERE w >= 2) AS branch_count, MAX(w) AS max_branch_width FROM s2 GROUP BY 1)
SELECT * FROM a JOIN c USING (pid)""")
def block_structure(spark, sf_dir):
    return blocks.structure(flows(spark, sf_dir))


@query(FLOWS + """,
n AS (SELECT DISTINCT pid, source, target FROM fl WHERE source IS NOT NULL AND note = 'N'), dr AS (SELECT DISTINCT pid, target FROM fl WHERE source IS NULL)
SELECT DISTINCT e.pid, e.source AS block, EXISTS (SELECT 1 FROM n x JOIN n y ON y.pid = x.pid AND y.target = x.target AND y.source <> x.source
       WHERE x.pid = e.pid AND x.source = e.source) AS strong
FROM n e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.pid = e.pid AND n.target = e.source) AND NOT EXISTS (SELECT 1 FROM dr WHERE dr.pid = e.pid AND dr.target = e.source)""")
def separate_origins(spark, sf_dir):
    f = flows(spark, sf_dir)
    direct = f.where("source is null").select("pid", F.col("target").alias("block")).distinct()
    return blocks.origins(f.where("source is not null and note = 'N'"), direct)


@query(FLOWS + """
SELECT pid, target, source AS parent FROM (SELECT pid, target, source, ROW_NUMBER() OVER (PARTITION BY pid, target ORDER BY SUM(amount) DESC, source DESC) AS k
FROM fl WHERE source IS NOT NULL GROUP BY 1, 2, 3) WHERE k = 1""")
def main_parent(spark, sf_dir):
    return blocks.main_parent(flows(spark, sf_dir))


@query("""
SELECT s_suppkey, cn, len(cn) = 13 AND 9 - (SELECT SUM(CAST(substr(cn, CAST(14 - n AS INTEGER), 1) AS INTEGER) * CASE WHEN n % 2 = 1 THEN 1 ELSE 2 END)
       FROM range(1, 13) t(n)) % 9 = CAST(substr(cn, 1, 1) AS INTEGER) AND cn <> repeat(substr(cn, 1, 1), 13) AS valid
FROM (SELECT s_suppkey, CAST(1 + s_suppkey % 9 AS VARCHAR) || lpad(CAST(s_suppkey * 7919 AS VARCHAR), 12, '0') AS cn FROM supplier)""")
def check_digit(spark, sf_dir):
    cn = F.concat((1 + F.col("s_suppkey") % 9).cast("string"), F.lpad((F.col("s_suppkey") * 7919).cast("string"), 12, "0"))
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", cn.alias("cn"), S.is_valid_corporate_number(cn).alias("valid"))


@query("WITH " + model_sql() + """
SELECT key, ministry, CAST(SUM(CASE WHEN d THEN amount ELSE 0 END) AS BIGINT) AS direct_amount, CAST(SUM(CASE WHEN d THEN 0 ELSE amount END) AS BIGINT) AS subcontract_amount,
       COUNT(DISTINCT pid) AS project_count
FROM (SELECT 'name:' || lower(recipient) AS key, ministry, s.pid, amount, s.pid % 3 <> 0 AS d FROM s JOIN p USING (pid)) GROUP BY 1, 2""")
def recipient_by_ministry(spark, sf_dir):
    rows = A.spending(spark, sf_dir, YEAR).join(A.projects(spark, sf_dir).select("pid", "ministry"), "pid")
    keyed = recipients.resolved_keys(rows.withColumnRenamed("recipient", "name").withColumn("number", F.lit("")))
    return recipients.by_ministry(keyed.withColumn("is_direct", F.col("pid") % 3 != 0))


@query("""
SELECT key, min(name) FILTER (WHERE k = 1) AS name, max(n) FILTER (WHERE k = 1) AS n FROM (
SELECT o_orderpriority AS key, o_orderstatus AS name, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY COUNT(*) DESC, o_orderstatus) AS k
FROM orders GROUP BY 1, 2) GROUP BY 1""")
def alias_frequency(spark, sf_dir):
    return recipients.representative_names(A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("name")))


RULES = [("STANDARD", "prefix", 3), ("BRUSHED", "contains", 2), ("^.*TIN$", "regex", 1), ("PROMO BURNISHED", "exact", 4)]


@query("""
SELECT p_type, CASE WHEN p_type LIKE 'STANDARD%' AND p_type <> 'STANDARD' THEN 3 WHEN p_type LIKE '%BRUSHED%' AND p_type <> 'BRUSHED' THEN 2
       WHEN p_type LIKE '%TIN' THEN 1 WHEN p_type = 'PROMO BURNISHED' THEN 4 ELSE 0 END AS level, COUNT(*) AS n FROM part GROUP BY 1, 2""")
def opaque_first_match(spark, sf_dir):
    return A.table(spark, sf_dir, "part").groupBy("p_type", S.opaque_level(F.col("p_type"), RULES).alias("level")).agg(F.count(F.lit(1)).alias("n"))


# ---- scores and the policy screen -------------------------------------------------------------------------------------


def items(spark, sf_dir):
    """Scored projects: axes from remainders of the key, budgets and spending of the year."""
    pid = F.col("pid")
    spent = A.spending(spark, sf_dir, YEAR).groupBy("pid").agg(F.sum("amount").alias("executed"))
    prior = (A.budgets(spark, sf_dir, YEAR - 1).select("pid", F.col("budget").alias("b0"))
             .join(A.spending(spark, sf_dir, YEAR - 1).groupBy("pid").agg(F.sum("amount").alias("e0")), "pid")
             .select("pid", S.execution_rate(F.col("e0"), F.col("b0")).alias("prior_rate")))
    m = lambda k, n, null: F.when(pid % null != 0, (pid * k % n).cast("double"))
    return A.budgets(spark, sf_dir, YEAR).join(spent, "pid", "left").fillna(0, ["executed"]).join(prior, "pid", "left").select(
        "pid", "budget", "executed", "prior_rate", (m(37, 101, 11)).alias("identify"), (m(53, 101, 11)).alias("purpose"), m(71, 101, 13).alias("budget_axis"),
        m(7, 11, 17).alias("design"), m(5, 11, 19).alias("evidence"), m(3, 11, 5).alias("proportionality"), m(9, 11, 23).alias("necessity"),
        ((pid * 13 % 41).cast("double") / 100).alias("opaque_ratio"), (pid % 5).cast("int").alias("depth"), (pid % 7 == 0).cast("int").alias("orphan_blocks"))


ITEMS = "WITH " + model_sql() + "," + model_sql(YEAR - 1, "0") + """,
q AS (SELECT p.pid, p.budget, p.spent AS executed, CASE WHEN p0.budget > 0 AND p0.spent > 0 THEN FLOOR(p0.spent::DOUBLE / p0.budget * 1000 + 0.5) / 1000 END AS prior_rate,
 CASE WHEN p.pid % 11 <> 0 THEN (p.pid * 37 % 101)::DOUBLE END AS identify, CASE WHEN p.pid % 11 <> 0 THEN (p.pid * 53 % 101)::DOUBLE END AS purpose,
 CASE WHEN p.pid % 13 <> 0 THEN (p.pid * 71 % 101)::DOUBLE END AS budget_axis, CASE WHEN p.pid % 17 <> 0 THEN (p.pid * 7 % 11)::DOUBLE END AS design,
 CASE WHEN p.pid % 19 <> 0 THEN (p.pid * 5 % 11)::DOUBLE END AS evidence, CASE WHEN p.pid % 5 <> 0 THEN (p.pid * 3 % 11)::DOUBLE END AS prop,
 CASE WHEN p.pid % 23 <> 0 THEN (p.pid * 9 % 11)::DOUBLE END AS necessity, (p.pid * 13 % 41)::DOUBLE / 100 AS opaque, p.pid % 5 AS depth, (p.pid % 7 = 0)::INT AS orphan
 FROM p LEFT JOIN p0 ON p0.pid = p.pid),
d AS (SELECT *, CASE WHEN identify IS NULL AND purpose IS NULL THEN CASE WHEN executed > 0 THEN 0.0::DOUBLE END
      ELSE (COALESCE(identify * 55, 0) + COALESCE(purpose * 45, 0)) / (CASE WHEN identify IS NULL THEN 0.0 ELSE 55.0 END + CASE WHEN purpose IS NULL THEN 0.0 ELSE 45.0 END)::DOUBLE END AS tr,
      CASE WHEN budget > 0 AND executed > 0 THEN LEAST(GREATEST((budget - executed)::DOUBLE / budget, 0), 1) END AS unused,
      CASE WHEN budget > 0 AND executed > 0 THEN GREATEST(budget - executed, 0) END AS unused_amount,
      COALESCE(CASE WHEN budget > 0 AND executed > 0 THEN executed::DOUBLE / budget END >= 0.95 AND opaque >= 0.2, FALSE) AS spend_down,
      LEAST(GREATEST(1 - prior_rate, 0), 1) AS prior_unused FROM q),
w AS (SELECT *, FLOOR(((COALESCE(FLOOR(design * 10 + 0.5) * 15, 0) + COALESCE(tr * 15, 0) + COALESCE(FLOOR(evidence * 10 + 0.5) * 15, 0) + COALESCE(FLOOR(prop * 10 + 0.5) * 35, 0)
      + COALESCE(FLOOR(necessity * 10 + 0.5) * 20, 0)) / NULLIF((CASE WHEN design IS NULL THEN 0.0 ELSE 15.0 END + CASE WHEN tr IS NULL THEN 0.0 ELSE 15.0 END
      + CASE WHEN evidence IS NULL THEN 0.0 ELSE 15.0 END + CASE WHEN prop IS NULL THEN 0.0 ELSE 35.0 END + CASE WHEN necessity IS NULL THEN 0.0 ELSE 20.0 END)::DOUBLE, 0)) + 0.5) AS overall,
      FLOOR(tr + 0.5) AS trr FROM d),
l AS (SELECT list_sort(list(design) FILTER (WHERE design IS NOT NULL)) AS ds, list_sort(list(evidence) FILTER (WHERE evidence IS NOT NULL)) AS es,
      list_sort(list(necessity) FILTER (WHERE necessity IS NOT NULL)) AS ns, list_sort(list(prop) FILTER (WHERE prop IS NOT NULL)) AS ps,
      list_sort(list(unused) FILTER (WHERE unused IS NOT NULL)) AS us FROM w),
t AS (SELECT ds[CAST(FLOOR((len(ds) - 1) * 0.10) AS BIGINT) + 1] AS dc, ds[CAST(FLOOR((len(ds) - 1) * 0.25) AS BIGINT) + 1] AS dw, es[CAST(FLOOR((len(es) - 1) * 0.30) AS BIGINT) + 1] AS ew,
      ns[CAST(FLOOR((len(ns) - 1) * 0.15) AS BIGINT) + 1] AS nl, ps[CAST(FLOOR((len(ps) - 1) * 0.25) AS BIGINT) + 1] AS pl, us[CAST(FLOOR((len(us) - 1) * 0.75) AS BIGINT) + 1] AS uh FROM l),
z AS (SELECT w.*, t.*, (SELECT COUNT(*) FROM w v WHERE v.overall < w.overall)::DOUBLE / NULLIF((SELECT COUNT(*) FROM w v WHERE v.overall IS NOT NULL) - 1, 0) * 100 AS pct,
      CASE WHEN NOT COALESCE(unused >= uh, FALSE) THEN 'normal' WHEN prior_unused IS NULL THEN 'unknown' WHEN prior_unused >= uh THEN 'persistent' ELSE 'single' END AS trend,
      COALESCE(unused >= uh AND unused_amount >= 100000000, FALSE) AS much FROM w, t)
"""


@query(ITEMS + """
SELECT pid, overall, pct AS percentile, trend AS unused_trend,
 CASE WHEN pct <= 5 AND necessity <= nl AND design > 0 AND design <= dc AND prop IS NOT NULL THEN '終了・廃止候補' WHEN pct <= 10 AND design <= dw THEN '再設計'
      WHEN much AND trend = 'persistent' THEN '縮小' WHEN pct <= 25 AND prop <= pl THEN '条件付き継続' WHEN much AND trend IN ('single', 'unknown') THEN '条件付き継続'
      WHEN pct <= 25 THEN '条件付き継続' WHEN spend_down THEN '要改善' WHEN pct <= 50 OR trr < 60 THEN '要改善' ELSE '継続' END AS recommendation,
 CASE WHEN budget_axis < 60 THEN '収支是正' WHEN spend_down OR identify < 60 OR purpose < 60 OR prop <= pl THEN '情報開示' WHEN depth >= 3 OR orphan > 0 THEN 'ガバナンス改善'
      WHEN evidence <= ew THEN '成果検証' WHEN design <= dw THEN 'KPI改善' WHEN trr < 75 THEN '執行改善' END AS action
FROM z WHERE overall IS NOT NULL""")
def policy_percentile_screen(spark, sf_dir):
    return screening.policy(items(spark, sf_dir)).where("overall is not null").select("pid", "overall", "percentile", "unused_trend", "recommendation", "action")


@query("WITH " + model_sql() + """,
x AS (SELECT pid, id, SUM(amount) AS amount FROM e GROUP BY 1, 2),
y AS (SELECT x.pid, SUM(amount) AS total, MAX(amount) AS top_amount FROM x GROUP BY 1)
SELECT pid, CAST(top_amount AS BIGINT) AS top_amount, FLOOR(top_amount::DOUBLE / total * 10000 + 0.5) / 10000 AS share FROM y WHERE total >= 1000000000
ORDER BY share DESC, top_amount DESC, pid LIMIT 10""")
def highlights_concentration(spark, sf_dir):
    g = A.graph(spark, sf_dir, YEAR)
    e = g.edges.where(F.col("target").startswith("r-")).join(g.nodes.where("type = 'project-spending'").select(F.col("id").alias("source"), F.col("project_id").alias("pid")), "source")
    stats = screening.recipient_stats(e.select("pid", F.col("target").alias("id"), F.col("target").alias("name"), F.col("value").alias("amount")))
    return screening.concentration(stats.withColumn("spend_total", F.col("total"))).select("pid", "top_amount", "share")


@query("WITH " + model_sql() + """,
x AS (SELECT pid, budget, (pid * 37 % 101)::DOUBLE AS total_score FROM p WHERE budget > 0)
SELECT pid, budget, total_score FROM x WHERE total_score <= (SELECT list_sort(list(total_score))[GREATEST(CAST(CEIL(COUNT(*) * 0.25) AS BIGINT), 1)] FROM x)
ORDER BY budget DESC, total_score, pid LIMIT 10""")
def highlights_nearest_rank(spark, sf_dir):
    rows = A.budgets(spark, sf_dir, YEAR).withColumn("total_score", (F.col("pid") * 37 % 101).cast("double"))
    return screening.low_score_high_budget(rows).select("pid", "budget", "total_score")


@query("WITH " + model_sql() + """,
gap AS (SELECT pid FROM p WHERE budget > 0 ORDER BY FLOOR(abs(spent::DOUBLE / budget - 1) * 10000 + 0.5) / 10000 DESC, pid LIMIT 40),
low AS (SELECT pid, budget, (pid * 37 % 101)::DOUBLE AS sc FROM p WHERE budget > 0),
low2 AS (SELECT pid FROM low WHERE sc <= (SELECT list_sort(list(sc))[GREATEST(CAST(CEIL(COUNT(*) * 0.25) AS BIGINT), 1)] FROM low) ORDER BY budget DESC, sc, pid LIMIT 40),
u AS (SELECT pid, 'lowScoreHighBudget' AS m, 3 AS o FROM low2 UNION ALL SELECT pid, 'execBudgetGap', 4 FROM gap)
SELECT u.pid, array_to_string(list(m ORDER BY o), ',') AS signals, MAX(budget) AS budget FROM u JOIN p USING (pid) GROUP BY 1 HAVING COUNT(*) >= 2
ORDER BY COUNT(*) DESC, MAX(budget) DESC, u.pid LIMIT 10""")
def multi_signal(spark, sf_dir):
    b = A.budgets(spark, sf_dir, YEAR).withColumn("total_score", (F.col("pid") * 37 % 101).cast("double"))
    spent = A.spending(spark, sf_dir, YEAR).groupBy("pid").agg(F.sum("amount").alias("executed"))
    rows = b.join(spent, "pid", "left").fillna(0, ["executed"])
    lists = {"execBudgetGap": screening.exec_budget_gap(rows, 40), "lowScoreHighBudget": screening.low_score_high_budget(rows, 40)}
    return screening.multi_signal(lists, b).withColumn("signals", F.array_join("signals", ","))


@query("WITH " + model_sql() + "," + model_sql(YEAR - 1, "0") + """,
ch AS (SELECT COALESCE(p.pid, p0.pid) AS pid, CASE WHEN p0.pid IS NULL THEN 'added' WHEN p.pid IS NULL THEN 'removed' WHEN p.spent > p0.spent THEN 'increased'
       WHEN p.spent < p0.spent THEN 'decreased' ELSE 'same' END AS status, abs(COALESCE(p.spent - p0.spent, p.spent, p0.spent)) AS size FROM p FULL OUTER JOIN p0 ON p.pid = p0.pid),
sc AS (SELECT pid FROM (SELECT pid, ROW_NUMBER() OVER (PARTITION BY status ORDER BY size DESC, pid) AS k FROM ch WHERE status <> 'same') WHERE k <= 10),
y AS (SELECT pid, SUM(amount) AS total, COALESCE(SUM(amount) FILTER (WHERE recipient LIKE '%7'), 0) AS other, MAX(amount) AS top_amount
      FROM (SELECT pid, recipient, SUM(amount) AS amount FROM e GROUP BY 1, 2) GROUP BY 1 HAVING SUM(amount) >= 1000000000),
oth AS (SELECT pid FROM y WHERE other > 0 ORDER BY FLOOR(other::DOUBLE / total * 10000 + 0.5) / 10000 DESC, other DESC, pid LIMIT 10),
con AS (SELECT pid FROM y ORDER BY FLOOR(top_amount::DOUBLE / total * 10000 + 0.5) / 10000 DESC, top_amount DESC, pid LIMIT 10),
low AS (SELECT pid, budget, (pid * 37 % 101)::DOUBLE AS score FROM p WHERE budget > 0),
low2 AS (SELECT pid FROM low WHERE score <= (SELECT list_sort(list(score))[GREATEST(CAST(CEIL(COUNT(*) * 0.25) AS BIGINT), 1)] FROM low) ORDER BY budget DESC, score, pid LIMIT 10),
gap AS (SELECT pid FROM p WHERE budget > 0 ORDER BY FLOOR(abs(spent::DOUBLE / budget - 1) * 10000 + 0.5) / 10000 DESC, pid LIMIT 10),
dep AS (SELECT pid FROM p WHERE spent >= 1000000000 AND pid % 5 > 0 ORDER BY pid % 5 DESC, spent DESC, pid LIMIT 10),
u AS (SELECT pid, 'spendingChange' AS m, 1 AS k FROM sc UNION ALL SELECT pid, 'otherRatio', 2 FROM oth UNION ALL SELECT pid, 'concentration', 3 FROM con
      UNION ALL SELECT pid, 'lowScoreHighBudget', 4 FROM low2 UNION ALL SELECT pid, 'execBudgetGap', 5 FROM gap UNION ALL SELECT pid, 'subcontractDepth', 6 FROM dep)
SELECT u.pid, array_to_string(list(m ORDER BY k), ',') AS signals, COALESCE(MAX(budget), 0) AS budget FROM u LEFT JOIN p ON p.pid = u.pid GROUP BY 1 HAVING COUNT(*) >= 2
ORDER BY COUNT(*) DESC, COALESCE(MAX(budget), 0) DESC, u.pid LIMIT 10""")
def multi_signal_six(spark, sf_dir):
    """Of all six lists of 10, as the engine builds them. Recipients whose name ends in 7 stand for 'その他'."""
    now, prior = A.graph(spark, sf_dir, YEAR), A.graph(spark, sf_dir, YEAR - 1)
    spent = A.spending(spark, sf_dir, YEAR).groupBy("pid").agg(F.sum("amount").alias("executed"))
    pid = F.col("pid")
    scores = A.budgets(spark, sf_dir, YEAR).join(spent, "pid", "left").fillna(0, ["executed"]).withColumns(
        {"total_score": (pid * 37 % 101).cast("double"), "depth": (pid % 5).cast("int"), "spend_total": F.col("executed")})
    other = now.nodes.withColumn("name", F.when(F.col("id").startswith("r-") & F.col("name").endswith("7"), "その他").otherwise(F.col("name")))
    lists = screening.highlights(scores, screening.graph_stats(Graph(other, now.edges), scores), summary.spending_change(prior, now))
    return lists["multiSignal"].withColumn("signals", F.array_join("signals", ","))


@query("""
SELECT l_suppkey, CASE WHEN SUM(CASE WHEN q IS NOT NULL THEN a END) > 0 THEN SUM(q * a)::DOUBLE / SUM(CASE WHEN q IS NOT NULL THEN a END) ELSE AVG(q) END AS score FROM (
SELECT l_suppkey, CASE WHEN l_returnflag <> 'R' THEN CAST(l_linenumber AS BIGINT) * 10 END AS q, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS a FROM lineitem) GROUP BY 1""")
def weighted_axis_score(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("long") * 10).alias("score"),
                                                     A.cents("l_extendedprice").alias("w"))
    return screening.weighted_mean(rows, "l_suppkey", "score", "w")


SCORES = """
WITH x AS (SELECT o_custkey AS pid, l_suppkey % 7 AS k, l_suppkey % 4 <> 0 AS filled, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS a, l_returnflag = 'R' AS opaque
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT pid, COUNT(*) AS n, COUNT(*) FILTER (WHERE k BETWEEN 0 AND 4) AS judged, COUNT(*) FILTER (WHERE k = 4) AS bad, COUNT(*) FILTER (WHERE filled) AS f,
      SUM(a) AS a, COALESCE(SUM(a) FILTER (WHERE opaque), 0) AS oa, pid % 6 AS depth, pid % 4 AS bb FROM x GROUP BY 1),
s AS (SELECT pid, CASE WHEN judged > 0 THEN (judged - bad)::DOUBLE / judged * 100 END AS axis1, f::DOUBLE / n * 100 AS axis2,
      LEAST(GREATEST((1 - abs(a::DOUBLE * 1.25 - a) / (a::DOUBLE * 1.25)) * 100, 0), 100) AS axis3,
      LEAST(GREATEST(100.0::DOUBLE - LEAST(depth * 10, 40) - LEAST(bb * 10, 30), 0), 100) AS axis4, LEAST(GREATEST((1 - oa::DOUBLE / a / 0.5) * 100, 0), 100) AS axis5 FROM g)
SELECT pid, ROUND(axis1, 6) AS axis1, ROUND(axis2, 6) AS axis2, ROUND(axis3, 6) AS axis3, axis4, ROUND(axis5, 6) AS axis5 FROM s"""


@query(SCORES)
def mechanical_scores(spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(s) for s in ("valid", "gov", "supp", "cn", "invalid", "unknown", "unknown")]), (F.col("l_suppkey") % 7 + 1).cast("int"))
    rows = A.table(spark, sf_dir, "lineitem").join(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid")), "l_orderkey").select(
        "pid", F.lit("A").alias("block"), status.alias("status"), (F.col("l_suppkey") % 4 != 0).alias("number_filled"), A.cents("l_extendedprice").alias("total"),
        A.cents("l_extendedprice").alias("amount"), (F.col("l_returnflag") == "R").alias("opaque"))
    stats = screening.project_stats(rows).withColumns({"executed": F.col("spend_total") * 1.25, "depth": F.col("pid") % 6, "bad_blocks": F.col("pid") % 4})
    return screening.mechanical_scores(stats).select("pid", *[F.round(f"axis{i}", 6).alias(f"axis{i}") if i != 4 else F.col("axis4") for i in range(1, 6)])
