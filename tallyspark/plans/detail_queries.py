"""Queries of a project's details: budgets, blocks, recipients, outcomes, search, the budget book's focus, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import semantics as S
from tallyspark.operators import blocks, budget, flow, outcomes, recipients, screening, search, stats
from tallyspark.plans import adapter as A

from .budget_queries import ITEMS, LEVELS, items
from .catalog import query
from .flow_queries import YEAR, model_sql
from .graph_queries import FLOWS, flows

CENTS = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"


def orders(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").withColumn("amount", A.cents("o_totalprice"))


# ---- budgets and blocks -------------------------------------------------------------------------------------------------


@query(f"""
WITH a AS (SELECT o_custkey AS pid, CASE o_orderstatus WHEN 'F' THEN 'general' WHEN 'O' THEN 'special' ELSE 'other' END AS account, SUM({CENTS}) AS b, SUM({CENTS} // 100 * (o_orderkey % 100)) AS x
           FROM orders GROUP BY 1, 2)
SELECT pid, CAST(SUM(b) AS BIGINT) AS budget, CAST(SUM(x) AS BIGINT) AS executed, CASE WHEN BOOL_OR(account = 'general') AND BOOL_OR(account = 'special') THEN 'both'
       WHEN BOOL_OR(account = 'general') THEN 'general' WHEN BOOL_OR(account = 'special') THEN 'special' ELSE 'none' END AS account_category,
       ROUND(SUM(x)::DOUBLE / SUM(b)::DOUBLE * 100, 6) AS execution_rate, string_agg(account, '/' ORDER BY b DESC, account DESC) AS accounts FROM a GROUP BY 1""")
def budget_sums(spark, sf_dir):
    status = F.col("o_orderstatus")
    rows = orders(spark, sf_dir).select(F.col("o_custkey").alias("pid"), F.when(status == "F", "general").when(status == "O", "special").otherwise("other").alias("account"),
                                        F.col("amount").alias("budget"), (F.floor(F.col("amount") / 100) * (F.col("o_orderkey") % 100)).alias("executed"))
    return flow.budget_summary(rows).withColumns({"execution_rate": F.round("execution_rate", 6), "accounts": F.array_join("accounts.account", "/")})


@query("""
WITH l AS (SELECT l_suppkey AS pid, l_linenumber AS block, CAST(l_quantity AS BIGINT) AS amount, l_linestatus = 'F' AS flag, l_partkey % 50 = 0 AS linked FROM lineitem),
m AS (SELECT pid, block, NOT BOOL_OR(flag) AS indirect FROM l WHERE linked GROUP BY 1, 2)
SELECT CASE WHEN COALESCE(indirect, FALSE) THEN 'indirect' ELSE 'direct' END AS kind, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS amount FROM l LEFT JOIN m USING (pid, block) GROUP BY 1""")
def direct_split(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pid"), F.col("l_linenumber").alias("block"), F.col("l_quantity").cast("long").alias("amount"),
                                                     (F.col("l_linestatus") == "F").alias("flag"), (F.col("l_partkey") % 50 == 0).alias("linked"))
    direct, indirect = flow.direct_rows(rows.select("pid", "block", "amount"), rows.where("linked").select("pid", "block", "flag"))
    return direct.withColumn("kind", F.lit("direct")).unionByName(indirect.withColumn("kind", F.lit("indirect"))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(f"""
SELECT o_custkey AS pid, CAST(SUM(GREATEST({CENTS} - 10000000, 0)) AS BIGINT) AS amount, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def indirect_costs(spark, sf_dir):
    status = F.col("o_orderstatus")
    return blocks.indirect_costs(orders(spark, sf_dir).select(F.col("o_custkey").alias("pid"), F.when(status == "F", True).when(status == "O", False).alias("attached"), (F.col("amount") - 10000000).alias("amount")))


@query(f"""
SELECT pid, COUNT(*) FILTER (WHERE declared > 0 AND ABS(declared - COALESCE(total, 0))::DOUBLE / declared::DOUBLE > 0.2) AS bad_blocks FROM
(SELECT o_custkey AS pid, o_orderkey AS block, {CENTS} AS declared, t.total FROM orders LEFT JOIN
 (SELECT l_orderkey, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total FROM lineitem WHERE l_linenumber < 5 GROUP BY 1) t ON l_orderkey = o_orderkey) GROUP BY 1""")
def inconsistent_blocks(spark, sf_dir):
    line = A.table(spark, sf_dir, "lineitem").where("l_linenumber < 5").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(A.cents("l_extendedprice")).alias("total"))
    return screening.inconsistent_blocks(orders(spark, sf_dir).join(line, "o_orderkey", "left").select(
        F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("block"), F.col("amount").alias("declared"), "total"))


@query(FLOWS + """,
sep AS (SELECT DISTINCT pid, target AS source FROM fl WHERE source IS NULL AND note = 'A')
SELECT fl.pid, CASE WHEN fl.source IS NULL AND note <> 'A' THEN CASE WHEN note = 'R' THEN 'transfer' ELSE 'direct' END WHEN sep.source IS NOT NULL THEN 'separate-origin'
       WHEN amount % 3 = 0 AND note = 'N' THEN 'reference' ELSE 'subcontract' END AS origin, COUNT(*) AS n
FROM fl LEFT JOIN sep ON sep.pid = fl.pid AND sep.source = fl.source GROUP BY 1, 2""")
def flow_origins(spark, sf_dir):
    note = F.col("note")
    f = flows(spark, sf_dir).withColumns({"is_direct": note != "A", "transfer": note == "R", "institutional": note == "N", "target_amount": F.col("amount") % 3})
    separate = f.where("source is null and note = 'A'").select("pid", F.col("target").alias("block")).distinct()
    return blocks.flow_origins(f, separate).groupBy("pid", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(FLOWS + """,
d AS (SELECT DISTINCT pid, target AS block, 1 AS depth FROM fl WHERE source IS NULL
      UNION SELECT d.pid, ed.target, d.depth + 1 FROM d JOIN ed ON ed.pid = d.pid AND ed.source = d.block WHERE d.depth < 30),
m AS (SELECT pid, block, MIN(depth) AS depth FROM d GROUP BY 1, 2)
SELECT ed.pid, CASE WHEN source = target THEN 'self' WHEN a.depth > b.depth THEN 'back' ELSE 'forward' END AS kind, COUNT(*) AS n
FROM ed LEFT JOIN m a ON a.pid = ed.pid AND a.block = source LEFT JOIN m b ON b.pid = ed.pid AND b.block = target GROUP BY 1, 2""")
def back_edges(spark, sf_dir):
    f = flows(spark, sf_dir).select("pid", "source", "target").distinct()
    return blocks.back_edges(f, blocks.shortest_depths(f)).groupBy("pid", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE c AS (SELECT * FROM (VALUES (1, NULL, 'A'), (1, NULL, 'B'), (1, 'A', 'C'), (1, 'B', 'C'), (1, 'C', 'D'), (1, 'D', 'A'), (2, NULL, 'A'), (2, 'A', 'B'), (2, 'A', 'C'), (2, 'C', 'E'), (2, 'B', 'E')) t(k, source, target)),
f AS (SELECT n_nationkey * 10 + k AS pid, source, target FROM c, nation),
w AS (SELECT pid, target AS block, 1 AS depth, '組織→' || target AS chain FROM f WHERE source IS NULL
      UNION ALL SELECT w.pid, f.target, w.depth + 1, w.chain || '→' || f.target FROM w JOIN f ON f.pid = w.pid AND f.source = w.block WHERE w.depth < 5)
SELECT pid, block, depth, MIN(chain) AS chain FROM w JOIN (SELECT pid, block, MIN(depth) AS depth FROM w GROUP BY 1, 2) USING (pid, block, depth) GROUP BY 1, 2, 3""")
def block_chains(spark, sf_dir):
    shape = [(1, None, "A"), (1, None, "B"), (1, "A", "C"), (1, "B", "C"), (1, "C", "D"), (1, "D", "A"), (2, None, "A"), (2, "A", "B"), (2, "A", "C"), (2, "C", "E"), (2, "B", "E")]
    edges = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("string").alias("source"), F.lit(b).alias("target")) for k, a, b in shape])).alias("x")
    f = A.table(spark, sf_dir, "nation").select("n_nationkey", edges).select((F.col("n_nationkey") * 10 + F.col("x.k")).alias("pid"), "x.source", "x.target")
    return blocks.shortest_depths(f, chains=True)


@query(FLOWS + """,
up AS (SELECT pid, target AS block, arg_min(source, (amount, source)) AS upstream FROM fl WHERE source IS NOT NULL GROUP BY 1, 2),
dn AS (SELECT pid, source AS block, string_agg(target, '/' ORDER BY target) AS downstream FROM ed GROUP BY 1, 2)
SELECT COALESCE(up.pid, dn.pid) AS pid, COALESCE(up.block, dn.block) AS block, upstream, downstream FROM up FULL OUTER JOIN dn ON up.pid = dn.pid AND up.block = dn.block""")
def block_neighbours(spark, sf_dir):
    return blocks.neighbours(flows(spark, sf_dir).withColumn("line_no", F.col("amount"))).withColumn("downstream", F.array_join("downstream", "/"))


@query(FLOWS + """,
bl AS (SELECT pid, target AS block, CAST(SUM(amount) AS BIGINT) AS amount FROM fl GROUP BY 1, 2)
SELECT ed.pid, source, target, x.amount AS source_amount, y.amount AS target_amount FROM ed JOIN bl x ON x.pid = ed.pid AND x.block = source JOIN bl y ON y.pid = ed.pid AND y.block = target
ORDER BY target_amount DESC, pid, source, target LIMIT 10""")
def largest_chains(spark, sf_dir):
    f = flows(spark, sf_dir)
    own = f.groupBy("pid", F.col("target").alias("block")).agg(F.sum("amount").alias("amount")).withColumn("name", F.col("block"))
    return blocks.chains(f, own).select("pid", "source", "target", "source_amount", "target_amount")


# ---- recipients -----------------------------------------------------------------------------------------------------------

NUMBERS = ("7777777777777", "12345", "9000000000000", "8000000000000", " ")


@query(f"""
WITH r AS (SELECT o_custkey % 60 AS k, 'n' || o_custkey % 30 AS name, {list(NUMBERS)!r}[o_custkey % 60 % 5 + 1] AS number, {CENTS} AS amount FROM orders), f AS (SELECT * FROM r WHERE trim(number) <> '')
SELECT 'name' AS part, name AS key, string_agg(DISTINCT number, '/' ORDER BY number) AS other, 0::BIGINT AS n, 0::BIGINT AS amount FROM f GROUP BY name HAVING COUNT(DISTINCT number) >= 2 UNION ALL
SELECT 'number', number, string_agg(DISTINCT name, '/' ORDER BY name), 0, 0 FROM f GROUP BY number HAVING COUNT(DISTINCT name) >= 2 UNION ALL
SELECT 'bad', CASE number WHEN '7777777777777' THEN 'dummy' WHEN '12345' THEN 'format' ELSE 'check digit' END, '', COUNT(*), CAST(SUM(amount) AS BIGINT) FROM f WHERE number <> '9000000000000' GROUP BY 2""")
def number_quality(spark, sf_dir):
    k = F.col("o_custkey")
    number = F.get(F.array(*[F.lit(x) for x in NUMBERS]), (k % 60 % 5).cast("int"))
    names, numbers, bad = recipients.number_quality(orders(spark, sf_dir).select(F.concat(F.lit("n"), k % 30).alias("name"), number.alias("number"), "amount"))
    none = F.lit(0).cast("long")
    part = lambda df, p, key, other, n=none, a=none: df.select(F.lit(p).alias("part"), F.col(key).alias("key"), other.alias("other"), n.alias("n"), a.alias("amount"))
    return (part(names, "name", "name", F.array_join("numbers", "/")).unionByName(part(numbers, "number", "number", F.array_join("names", "/")))
            .unionByName(part(bad, "bad", "kind", F.lit(""), F.col("n"), F.col("amount"))))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '9000000000000' WHEN k = 0 THEN 'name:株式会社' || lower(s_name) WHEN k = 1 THEN 'name:有限会社' || lower(s_name) WHEN k = 2 THEN 'name:その他'
       ELSE 'name:' || lower(s_name) || 'ab' END AS key, k = 2 AS excluded, s_suppkey % 3 = 1 AS dummy FROM (SELECT *, s_suppkey % 4 AS k FROM supplier)""")
def recipient_keys(spark, sf_dir):
    k, name = F.col("s_suppkey"), F.col("s_name")
    spelt = F.when(k % 4 == 0, F.concat(F.lit("（株） "), name)).when(k % 4 == 1, F.concat(F.lit("㈲　"), name)).when(k % 4 == 2, "　その他 ").otherwise(F.concat(name, F.lit("ＡＢ")))
    number = F.when(k % 3 == 0, " 9000000000000").when(k % 3 == 1, "1111111111111").otherwise("")
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", S.recipient_key(spelt, number).alias("key"), S.is_excluded_recipient(spelt).alias("excluded"), S.is_dummy_number(number).alias("dummy"))


@query("""
WITH w AS (SELECT 'k' || range AS asked, range AS i FROM range(40))
SELECT asked, CASE WHEN i < 10 THEN asked WHEN i < 20 THEN 'k' || i % 10 WHEN i < 30 THEN
       (SELECT 'k' || o_orderkey % 10 FROM orders WHERE o_custkey % 40 = i GROUP BY 1 ORDER BY COUNT(*) DESC, 1 DESC LIMIT 1) END AS key FROM w""")
def recipient_lookup(spark, sf_dir):
    k = lambda c: F.concat(F.lit("k"), c)
    ids = spark.range(40)
    aliases = orders(spark, sf_dir).where("o_custkey % 40 < 30").groupBy(k(F.col("o_custkey") % 40).alias("alias"), k(F.col("o_orderkey") % 10).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return recipients.find_key(ids.select(k(F.col("id")).alias("asked")), ids.where("id < 10").select(k(F.col("id")).alias("key")),
                               ids.where("id between 10 and 19").select(k(F.col("id")).alias("key"), k(F.col("id") % 10).alias("to")), aliases)


@query("""
WITH a AS (SELECT o_custkey AS k, o_orderpriority AS key, COUNT(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE') GROUP BY 1, 2)
SELECT c_name AS asked, CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'FURNITURE' THEN 'merged-' || c_nationkey ELSE (SELECT key FROM a WHERE k = c_custkey ORDER BY n DESC, key DESC LIMIT 1) END AS key FROM customer""")
def customer_lookup(spark, sf_dir):
    """Keys for all customers: their own, one that they were merged into, or the one that their name most often goes with."""
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    others = orders(spark, sf_dir).join(c.where("c_mktsegment not in ('BUILDING', 'FURNITURE')"), F.col("o_custkey") == F.col("c_custkey"))
    aliases = others.groupBy(F.col("c_name").alias("alias"), F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return recipients.find_key(c.select(F.col("c_name").alias("asked")), c.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("key")),
                               c.where("c_mktsegment = 'FURNITURE'").select(F.col("c_name").alias("key"), F.concat(F.lit("merged-"), "c_nationkey").alias("to")), aliases)


@query("WITH " + model_sql() + """
SELECT pid, recipient, amount, CAST(rank AS INTEGER) AS rank, ROUND(amount::DOUBLE / total::DOUBLE, 9) AS share FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY pid ORDER BY amount DESC, recipient) AS rank, SUM(amount) OVER (PARTITION BY pid) AS total FROM s) WHERE rank <= 5""")
def top_recipients_each(spark, sf_dir):
    return outcomes.top_recipients_each(A.spending(spark, sf_dir, YEAR)).withColumn("share", F.round("share", 9))


# ---- outcomes and ministries ------------------------------------------------------------------------------------------------

SERIES = """
WITH r AS (SELECT l_suppkey AS pid, l_linenumber AS indicator, l_linestatus AS kind, ['target', 'actual', 'rate', 'unit'][l_partkey % 4 + 1] AS row_kind, year(l_shipdate) AS year, MAX(l_quantity) AS value
           FROM lineitem GROUP BY ALL),"""


def series(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("target", "actual", "rate", "unit")])
    return outcomes.indicators(A.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("pid"), F.col("l_linenumber").alias("indicator"), F.col("l_linestatus").alias("kind"), F.get(kinds, (F.col("l_partkey") % 4).cast("int")).alias("row_kind"),
        F.year("l_shipdate").alias("year")).agg(F.max("l_quantity").alias("value")))


@query(SERIES + """
s AS (SELECT pid, indicator, kind, row_kind, string_agg(year || '=' || CAST(value AS BIGINT), ' ' ORDER BY year) AS s FROM r GROUP BY 1, 2, 3, 4)
SELECT pid, indicator, kind, MAX(s) FILTER (WHERE row_kind = 'target') AS target, MAX(s) FILTER (WHERE row_kind = 'actual') AS actual, MAX(s) FILTER (WHERE row_kind = 'rate') AS rate,
       MAX(s) FILTER (WHERE row_kind = 'unit') AS unit FROM s GROUP BY 1, 2, 3""")
def indicator_series(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"].cast("long").cast("string"))), " ")
    return series(spark, sf_dir).withColumns({c: text(c) for c in ("target", "actual", "rate", "unit")})


@query(SERIES + """
i AS (SELECT pid, indicator, kind, BOOL_OR(row_kind = 'target') AS t, BOOL_OR(row_kind = 'actual') AS a, BOOL_OR(row_kind = 'rate') AS r FROM r GROUP BY 1, 2, 3)
SELECT pid, COUNT(*) AS indicators, COUNT(*) FILTER (WHERE t) AS with_target, COUNT(*) FILTER (WHERE a) AS with_actual, COUNT(*) FILTER (WHERE r) AS with_rate,
       concat_ws(' ', CASE WHEN BOOL_OR(kind = 'F') THEN 'F=' || COUNT(*) FILTER (WHERE kind = 'F') END, CASE WHEN BOOL_OR(kind = 'O') THEN 'O=' || COUNT(*) FILTER (WHERE kind = 'O') END) AS by_kind
FROM i GROUP BY 1""")
def indicator_counts(spark, sf_dir):
    text = F.array_join(F.transform(F.array_sort(F.map_entries("by_kind")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), " ")
    return outcomes.indicator_counts(series(spark, sf_dir)).withColumn("by_kind", text)


@query("""
WITH e AS (SELECT l_orderkey AS pid, l_linestatus AS a, CASE l_returnflag WHEN 'A' THEN '短期アウトカム' WHEN 'N' THEN 'アウトプット' ELSE '活動' END AS b FROM lineitem)
SELECT pid, string_agg(p || '=' || n, ' ' ORDER BY p) AS paths, BOOL_OR(o) AS reaches_outcome FROM (SELECT pid, a || '→' || b AS p, COUNT(*) AS n, BOOL_OR(b LIKE '%アウトカム%') AS o FROM e GROUP BY 1, 2) GROUP BY 1""")
def logic_paths(spark, sf_dir):
    flag = F.col("l_returnflag")
    edges = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linestatus").alias("from_kind"),
                                                      F.when(flag == "A", "短期アウトカム").when(flag == "N", "アウトプット").otherwise("活動").alias("to_kind"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("paths")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), " ")
    return outcomes.logic_paths(edges).withColumn("paths", text)


@query("""
WITH a AS (SELECT o_custkey AS pid, COUNT(*) AS orders FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1), b AS (SELECT c_custkey AS pid, c_name AS name FROM customer WHERE c_custkey % 3 = 0)
SELECT COALESCE(a.pid, b.pid) AS pid, orders, name FROM a FULL OUTER JOIN b ON a.pid = b.pid""")
def key_universe(spark, sf_dir):
    a = orders(spark, sf_dir).where("o_orderkey % 9 = 0").groupBy(F.col("o_custkey").alias("pid")).agg(F.count(F.lit(1)).alias("orders"))
    return outcomes.universe([a, A.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"))])


@query("""
SELECT c_mktsegment, n, amount, ROUND(amount::DOUBLE / (SUM(amount) OVER ())::DOUBLE, 9) AS share FROM
(SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(ROUND(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS amount FROM customer GROUP BY 1)""")
def category_shares(spark, sf_dir):
    return outcomes.categories(A.table(spark, sf_dir, "customer").withColumn("v", A.cents("c_acctbal")), "c_mktsegment", "v").withColumn("share", F.round("share", 9))


@query("WITH " + model_sql() + """
SELECT n_name AS ministry, CAST(SUM(x.budget) AS BIGINT) AS budget, CAST(SUM(x.spending) AS BIGINT) AS spending, COUNT(*) AS projects, COUNT(*) FILTER (WHERE x.budget > 0 AND x.spending = 0) AS budget_only,
       COUNT(*) FILTER (WHERE x.budget = 0 AND x.spending > 0) AS spending_only, COUNT(*) FILTER (WHERE x.budget = 0 AND x.spending = 0) AS neither
FROM (SELECT n_name, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE COALESCE(p.budget, 0) END AS budget, COALESCE(p.spent, 0) AS spending FROM customer JOIN nation ON n_nationkey = c_nationkey
      LEFT JOIN p ON p.pid = c_custkey) x GROUP BY 1""")
def ministry_stats(spark, sf_dir):
    spent = A.spending(spark, sf_dir, YEAR).groupBy("pid").agg(F.sum("amount").alias("spending"))
    p = A.projects(spark, sf_dir).join(A.budgets(spark, sf_dir, YEAR), "pid", "left").join(spent, "pid", "left").fillna(0, ["budget", "spending"])
    return outcomes.ministry_stats(p.withColumn("budget", F.when(F.col("pid") % 6 == 0, 0).otherwise(F.col("budget"))))


@query("WITH " + model_sql() + """,
x AS (SELECT e.*, p.name, p.ministry FROM e JOIN p USING (pid) WHERE ministry = 'NATION_3')
SELECT 'ministry' AS kind, ministry AS id, COUNT(DISTINCT pid) AS projects, COUNT(DISTINCT id) AS recipients, CAST(SUM(amount) AS BIGINT) AS amount FROM x GROUP BY ministry UNION ALL
SELECT 'project', CAST(pid AS VARCHAR), 1, COUNT(DISTINCT id), CAST(SUM(amount) AS BIGINT) FROM x GROUP BY pid UNION ALL
SELECT 'recipient', id, COUNT(DISTINCT pid), 1, CAST(SUM(amount) AS BIGINT) FROM x GROUP BY id""")
def drill_down(spark, sf_dir):
    g = A.graph(spark, sf_dir, YEAR)
    m, p, r = outcomes.drill_down(g.nodes, g.edges, "ministry-NATION_3")
    one = F.lit(1).cast("long")
    part = lambda df, kind, i, k, n: df.select(F.lit(kind).alias("kind"), i.cast("string").alias("id"), k.alias("projects"), n.alias("recipients"), "amount")
    return (part(m, "ministry", F.col("ministry"), F.col("projects"), F.col("recipients")).unionByName(part(p, "project", F.col("pid"), one, F.col("recipients")))
            .unionByName(part(r, "recipient", F.col("id"), F.col("projects"), one)))


@query("""
SELECT p_partkey, ROUND(10 + 90 * POW((up - 1)::DOUBLE / (n - 1)::DOUBLE, 1.5), 6) AS radius FROM (SELECT p_partkey, COUNT(*) OVER (ORDER BY p_size) AS up, COUNT(*) OVER () AS n FROM part)""")
def size_scale(spark, sf_dir):
    return stats.size_scale(A.table(spark, sf_dir, "part"), "p_size", 10, 100).select("p_partkey", F.round("radius", 6).alias("radius"))


@query("""
WITH i AS (SELECT p_partkey AS pid, NULLIF(p_partkey * 37 % 101, 50) AS identify, p_size * 2 AS purpose, p_partkey % 90 AS executed, p_partkey % 70 AS spend_net, NULLIF(p_partkey * 3 % 100, 99) AS axis4,
  NULLIF(p_partkey % 6, 5) AS orphans FROM part),
s AS (SELECT *, CASE WHEN executed <> 0 THEN LEAST(GREATEST(100 - GREATEST(ABS(executed - spend_net)::DOUBLE / executed::DOUBLE - 0.1::DOUBLE, 0) / 0.9::DOUBLE * 100, 0), 100) END AS budget,
  CASE WHEN axis4 IS NOT NULL THEN LEAST(GREATEST(axis4::DOUBLE - LEAST(COALESCE(orphans, 0) * 10, 30), 0), 100) END AS structure FROM i)
SELECT pid, ROUND(budget, 6) AS budget, structure FROM s""")
def final_scores(spark, sf_dir):
    k = F.col("p_partkey")
    rows = A.table(spark, sf_dir, "part").select(
        k.alias("pid"), F.nullif(k * 37 % 101, F.lit(50)).cast("double").alias("identify"), (F.col("p_size") * 2).cast("double").alias("purpose"), (k % 90).alias("executed"), (k % 70).alias("spend_net"),
        F.nullif(k * 3 % 100, F.lit(99)).cast("double").alias("axis4"), F.nullif(k % 6, F.lit(5)).alias("orphan_blocks"))
    return screening.final_scores(rows).select("pid", F.round("budget", 6).alias("budget"), "structure")


# ---- search -----------------------------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id AS pid FROM documents WHERE contains(regexp_replace(lower(text), '\\s+', '', 'g'), '77'))
SELECT c_custkey AS pid, CASE WHEN contains(lower(c_name), '77') THEN 'name' ELSE 'details' END AS matched_in FROM customer WHERE contains(lower(c_name), '77') OR c_custkey IN (SELECT pid FROM d)""")
def search_projects(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("budget"))
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), "text")
    return search.search_projects(search.with_normal(c, ["name"]), " ７7", search.with_normal(d, ["text"])).select("pid", "matched_in")


@query("""
SELECT 'name:' || lower(s_name) AS key FROM supplier WHERE contains(lower(s_name), 'r#000000001') OR s_nationkey = 5""")
def search_recipients(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    alias = F.when(F.col("s_nationkey") == 5, F.lit("Old R#0000 00001 name"))
    index = search.with_normal(s.select("s_name", alias.alias("alias")), ["s_name", "alias"]).select(
        F.concat(F.lit("name:"), F.lower("s_name")).alias("key"), F.array("s_name_norm", "alias_norm").alias("aliases_norm"), F.lit(1).alias("direct_amount"), F.lit(2).alias("subcontract_amount"))
    return search.search_recipients(index, "Ｒ#0000 00001").select("key")


# ---- the budget book ----------------------------------------------------------------------------------------------------------


@query(f"""
WITH a AS (SELECT o_orderpriority AS account, CAST(SUM({CENTS}) AS BIGINT) AS revenue, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN {CENTS} ELSE 0 END) AS BIGINT) AS transfer_in,
  CAST(SUM(CASE WHEN o_orderkey % 2 = 0 THEN {CENTS} ELSE 0 END) AS BIGINT) AS sent_by_general FROM orders GROUP BY 1)
SELECT account, LEAST(sent_by_general, transfer_in) AS from_general, GREATEST(transfer_in - LEAST(sent_by_general, transfer_in), 0) AS from_other, revenue - transfer_in AS own FROM a""")
def funding(spark, sf_dir):
    part = lambda test, name: F.sum(F.when(test, F.col("amount")).otherwise(0)).alias(name)
    accounts = orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("account")).agg(
        F.sum("amount").alias("revenue"), part(F.col("o_orderstatus") == "F", "transfer_in"), part(F.col("o_orderkey") % 2 == 0, "sent_by_general"))
    return budget.funding(accounts).select("account", "from_general", "from_other", "own")


@query(f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(SUM({CENTS}) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F, CAST(SUM({CENTS}) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 1 AND o_orderstatus <> 'P' GROUP BY 1""")
def line_history(spark, sf_dir):
    rows = orders(spark, sf_dir).where("o_orderstatus <> 'P'").join(A.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("budget_type"), F.col("c_mktsegment").alias("section"),
        F.when(F.col("c_nationkey") % 2 == 0, "x").alias("item"), "amount")
    return budget.history(rows, ["section", "item"], {"section": "BUILDING"})


@query(ITEMS + """
SELECT h.id FROM h, (SELECT p3 AS id FROM j WHERE segment IS NOT NULL ORDER BY p3 LIMIT 1) c WHERE h.id = c.id OR starts_with(h.id, c.id || '>') OR starts_with(c.id, h.id || '>')""")
def related_nodes(spark, sf_dir):
    tree = budget.rolled_up(items(spark, sf_dir), LEVELS)
    node = tree.where("level = 3 and id not like '%>\\\\_\\\\_pass%'").agg(F.min("id")).first()[0]
    return budget.related(tree.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target")), node)


@query("WITH " + model_sql() + """,
x AS (SELECT e.pid, amount, ministry FROM e JOIN p USING (pid) WHERE id = 'r-1' AND amount > 0)
SELECT 'project-spending-' || pid AS source, 'r-1' AS target, amount AS value FROM x UNION ALL SELECT 'project-budget-' || pid, 'project-spending-' || pid, amount FROM x UNION ALL
SELECT 'ministry-' || ministry, 'project-budget-' || pid, amount FROM x UNION ALL SELECT 'total', 'ministry-' || ministry, CAST(SUM(amount) AS BIGINT) FROM x GROUP BY ministry""")
def focused_recipient(spark, sf_dir):
    g = A.graph(spark, sf_dir, YEAR)
    nodes = g.nodes.select("id", F.col("type").alias("level"), F.col("value").alias("amount"))
    return budget.focused(nodes, g.edges, "r-1").withColumn("value", F.round("value").cast("long"))


# ---- labels -------------------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE WHEN y >= 2019 THEN '令和' || CASE WHEN y = 2019 THEN '元' ELSE CAST(y - 2018 AS VARCHAR) END ELSE '平成' || CASE WHEN y = 1989 THEN '元' ELSE CAST(y - 1988 AS VARCHAR) END END || '年度' AS era,
  CASE o_orderstatus WHEN 'F' THEN '一般会計' WHEN 'O' THEN '特別会計' ELSE '一般会計+特別会計' END AS account, concat_ws(' / ', NULLIF(trim(p), ''), o_orderstatus) AS path, o_orderstatus AS leaf,
  concat_ws('/', CASE WHEN o_orderkey % 2 = 0 THEN 'even' END, CASE WHEN o_orderkey % 3 = 0 THEN 'third' END) AS flags,
  replace(concat_ws(chr(10), NULLIF(trim(p), ''), o_orderstatus || '/' || o_orderpriority), '/', ' ') AS body, sha256(o_orderpriority || chr(1) || '' || chr(1) || CAST(o_custkey AS VARCHAR)) AS key
FROM (SELECT *, 1989 + o_orderkey % 37 AS y, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE ' ' END AS p FROM orders)""")
def labels(spark, sf_dir):
    k, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    p = F.when(k % 4 > 0, priority).otherwise(" ")
    account = F.when(status == "F", "general").when(status == "O", "special").otherwise("both")
    path = S.org_path([p, F.lit(None).cast("string"), status])
    return orders(spark, sf_dir).select(
        "o_orderkey", S.era_label(1989 + k % 37).alias("era"), S.account_label(account).alias("account"), path.alias("path"), S.bureau_leaf(path).alias("leaf"),
        F.array_join(S.flag_labels({"even": k % 2 == 0, "third": k % 3 == 0}), "/").alias("flags"), S.assembled([p, F.concat(status, F.lit("/"), priority)]).alias("body"),
        S.text_key(priority, F.lit(None), F.col("o_custkey")).alias("key"))
