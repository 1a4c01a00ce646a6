"""Budget book queries over region > nation > segment > customer > order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import budget
from tallyspark.plans import adapter as A

from .catalog import query
from .flow_queries import YEAR

LEVELS = ("region", "nation", "segment", "customer")
TOP = {"nation": 3, "segment": 4, "customer": 5}


def items(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (A.of_year(spark, sf_dir, YEAR).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
                    F.col("c_name").alias("customer"), A.cents("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"), "o_orderpriority"))


ITEMS = f"""WITH i AS (SELECT r_name AS region, n_name AS nation, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, c_name AS customer,
 CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount, o_orderstatus AS status, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE o_orderdate >= TIMESTAMP '{YEAR}-01-01' AND o_orderdate < TIMESTAMP '{YEAR + 1}-01-01'),
j AS (SELECT *, 'total>' || region AS p1, 'total>' || region || '>' || nation AS p2, 'total>' || region || '>' || nation || '>' || COALESCE(segment, '__pass__segment') AS p3,
      'total>' || region || '>' || nation || '>' || COALESCE(segment, '__pass__segment') || '>' || customer AS p4 FROM i),
h AS (SELECT 0 AS level, 'total' AS id, NULL AS parent, CAST(SUM(amount) AS BIGINT) AS amount, COUNT(*) AS n FROM j
 UNION ALL SELECT 1, p1, 'total', CAST(SUM(amount) AS BIGINT), COUNT(*) FROM j GROUP BY p1 UNION ALL SELECT 2, p2, p1, CAST(SUM(amount) AS BIGINT), COUNT(*) FROM j GROUP BY p1, p2
 UNION ALL SELECT 3, p3, p2, CAST(SUM(amount) AS BIGINT), COUNT(*) FROM j GROUP BY p2, p3 UNION ALL SELECT 4, p4, p3, CAST(SUM(amount) AS BIGINT), COUNT(*) FROM j GROUP BY p3, p4)"""


@query(ITEMS + "SELECT CAST(level AS INTEGER) AS level, id, parent, amount, n FROM h")
def hierarchy_rollup(spark, sf_dir):
    return budget.rolled_up(items(spark, sf_dir), LEVELS)


KEPT = ITEMS + """,
x AS (SELECT *, id LIKE '%>\\_\\_pass\\_\\_segment' ESCAPE '\\' AS pass FROM h),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent, pass ORDER BY amount DESC, id) AS rk FROM x),
k1 AS (SELECT * FROM k WHERE level = 1), k2 AS (SELECT * FROM k WHERE level = 2 AND rk <= 3 AND parent IN (SELECT id FROM k1)),
k3 AS (SELECT * FROM k WHERE level = 3 AND (rk <= 4 OR pass) AND parent IN (SELECT id FROM k2)), k4 AS (SELECT * FROM k WHERE level = 4 AND rk <= 5 AND parent IN (SELECT id FROM k3)),
a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY level, pass ORDER BY amount DESC, id) AS cr FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4)),
f1 AS (SELECT * FROM a WHERE level = 1 AND cr <= 40), f2 AS (SELECT * FROM a WHERE level = 2 AND cr <= 40 AND parent IN (SELECT id FROM f1)),
f3 AS (SELECT * FROM a WHERE level = 3 AND (cr <= 40 OR pass) AND parent IN (SELECT id FROM f2)), f4 AS (SELECT * FROM a WHERE level = 4 AND cr <= 40 AND parent IN (SELECT id FROM f3)),
kept AS (SELECT level, id, parent, amount, n FROM x WHERE level = 0 UNION ALL SELECT level, id, parent, amount, n FROM f1 UNION ALL SELECT level, id, parent, amount, n FROM f2
         UNION ALL SELECT level, id, parent, amount, n FROM f3 UNION ALL SELECT level, id, parent, amount, n FROM f4),
gone AS (SELECT * FROM x WHERE NOT pass AND id NOT IN (SELECT id FROM kept))"""


@query(KEPT + """
SELECT id, amount, n, FALSE AS aggregated FROM kept UNION ALL
SELECT '__others__' || ['region', 'nation', 'segment', 'customer'][level], CAST(SUM(amount) AS BIGINT), COUNT(*), TRUE FROM gone GROUP BY level""")
def others_per_column(spark, sf_dir):
    return budget.hierarchy(items(spark, sf_dir), TOP, 40, LEVELS)[0].drop("level")


@query(KEPT + """
SELECT parent AS source, id AS target, amount AS value FROM kept WHERE parent IS NOT NULL UNION ALL
SELECT CASE WHEN p.id IS NOT NULL THEN p.id WHEN g.parent LIKE '%>\\_\\_pass\\_\\_segment' ESCAPE '\\' THEN COALESCE(pp.id, '__others__nation')
       ELSE '__others__' || ['total', 'region', 'nation', 'segment'][g.level] END, '__others__' || ['region', 'nation', 'segment', 'customer'][g.level], CAST(SUM(g.amount) AS BIGINT)
FROM gone g LEFT JOIN kept p ON p.id = g.parent LEFT JOIN kept pp ON pp.id = regexp_replace(g.parent, '>[^>]*$', '') GROUP BY 1, 2""")
def hierarchy_links(spark, sf_dir):
    return budget.hierarchy(items(spark, sf_dir), TOP, 40, LEVELS)[1]


@query(ITEMS + """
SELECT 'region' AS by, region AS name, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS amount FROM i GROUP BY region UNION ALL
SELECT 'nation', nation, COUNT(*), CAST(SUM(amount) AS BIGINT) FROM i GROUP BY nation UNION ALL SELECT 'status', status, COUNT(*), CAST(SUM(amount) AS BIGINT) FROM i GROUP BY status""")
def budget_groups(spark, sf_dir):
    return budget.groups(items(spark, sf_dir), ["region", "nation", "status"])


SPECIAL = ITEMS + """,
v AS (SELECT nation AS account, segment AS sub_account, status <> 'F' AS rev, o_orderpriority LIKE '1%' AS ti, o_orderpriority LIKE '2%' AS t_o, amount FROM i),
s AS (SELECT account, COUNT(DISTINCT sub_account) AS sub_accounts, CAST(COALESCE(SUM(amount) FILTER (WHERE rev), 0) AS BIGINT) AS revenue,
 CAST(COALESCE(SUM(amount) FILTER (WHERE NOT rev), 0) AS BIGINT) AS expenditure, CAST(COALESCE(SUM(amount) FILTER (WHERE rev AND ti), 0) AS BIGINT) AS transfer_in,
 CAST(COALESCE(SUM(amount) FILTER (WHERE NOT rev AND t_o), 0) AS BIGINT) AS transfer_out FROM v GROUP BY 1)"""


def special(spark, sf_dir):
    return budget.account_summary(items(spark, sf_dir).select(
        F.col("nation").alias("account"), F.col("segment").alias("sub_account"), F.when(F.col("status") != "F", "revenue").otherwise("expenditure").alias("side"),
        F.col("o_orderpriority").startswith("1").alias("transfer_in"), F.col("o_orderpriority").startswith("2").alias("transfer_out"), "amount"))


@query(SPECIAL + """SELECT *, CASE WHEN revenue > 0 THEN (revenue - transfer_in)::DOUBLE / revenue ELSE 0 END AS own_rate FROM s""")
def account_summary(spark, sf_dir):
    return special(spark, sf_dir)


@query(SPECIAL + """SELECT account, LEAST(transfer_out, transfer_in) AS from_general, GREATEST(transfer_in - LEAST(transfer_out, transfer_in), 0) AS from_other,
 revenue - transfer_in AS own, revenue + expenditure - transfer_in - transfer_out AS net FROM s""")
def gross_net(spark, sf_dir):
    a = special(spark, sf_dir).withColumns({"sent_by_general": F.col("transfer_out"), "gross": F.col("revenue") + F.col("expenditure"),
                                            "received_by_special": F.col("transfer_in"), "received_between_sub_accounts": F.col("transfer_out")})
    return budget.net_totals(budget.funding(a)).select("account", "from_general", "from_other", "own", "net")


@query("""
SELECT p_type AS line, account FROM (SELECT p_type, b AS account, ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY length(b) DESC NULLS LAST, b DESC) AS k
FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN (VALUES ('STEEL'), ('TIN'), ('STANDARD'), ('ANODIZED TIN'), ('BRASS'), ('POLISHED')) t(b) ON contains(p_type, b)) WHERE k = 1""")
def longest_match_transfer(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in ("STEEL", "TIN", "STANDARD", "ANODIZED TIN", "BRASS", "POLISHED")], "account string")
    return budget.longest_match(A.table(spark, sf_dir, "part").select(F.col("p_type").alias("line")).distinct(), "line", names, "")


@query("""
WITH x AS (SELECT o_orderpriority AS account, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
y AS (SELECT o_orderpriority AS account, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT COALESCE(x.account, y.account) AS account, COALESCE(x.v, 0) AS sent, COALESCE(y.v, 0) AS received, COALESCE(x.v, 0) - COALESCE(y.v, 0) AS difference
FROM x FULL OUTER JOIN y ON x.account = y.account""")
def transfer_reconciliation(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("account"), A.cents("o_totalprice").alias("amount"), "o_orderstatus")
    return budget.reconciled(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"))


@query("""
WITH x AS (SELECT c_mktsegment || '-' || n_name AS name, SUM(CAST(ROUND(c_acctbal * 100) AS BIGINT) + 100000) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
y AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (ORDER BY v DESC, name) <= 20 AND v::DOUBLE / SUM(v) OVER () >= 0.01 THEN name ELSE 'その他' END AS k FROM x)
SELECT k AS name, CAST(SUM(v) AS BIGINT) AS v, COUNT(*) AS members FROM y GROUP BY 1""")
def top_with_other(spark, sf_dir):
    t = A.table(spark, sf_dir, "customer").join(F.broadcast(A.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    x = t.groupBy(F.concat_ws("-", "c_mktsegment", "n_name").alias("name")).agg(F.sum(A.cents("c_acctbal") + 100000).alias("v"))
    return budget.top_with_other(x, "name", "v", 20, 0.01)
