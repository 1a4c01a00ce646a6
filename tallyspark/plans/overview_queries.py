"""The budget overview over lines made of the driver's lines: account kinds by supplier, sides by line number, names by quantity, tax and discount."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import overview
from tallyspark.plans import adapter as A

from .catalog import query


def book(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    c, q = F.col, F.col("l_quantity").cast("int")
    lines = A.table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("general", "special", "agency"))), (F.when(c("l_suppkey") % 10 < 6, 0).when(c("l_suppkey") % 10 < 9, 1).otherwise(2) + 1).cast("int"))
    side = F.when(c("l_linenumber") % 2 == 1, "revenue").otherwise("expenditure")
    tens, cent = lambda x: F.round(c(x) * 100).cast("int"), lambda x: x.cast("string")
    category = (F.when((kind == "special") & (tens("l_discount") == 10), overview.FROM_OTHER).when((kind == "special") & (tens("l_discount") == 9), overview.FROM_SUB)
                .when(q < 20, overview.TAX).when(q < 22, overview.MISC).when(q < 40, "公債金").otherwise(F.concat(F.lit("款"), cent(q))))
    item = (F.when((kind == "special") & (tens("l_discount") == 8), F.concat(F.lit("一般会計より受入"), cent(q)))
            .when((kind == "general") & (tens("l_tax") == 8), F.concat(F.lit("年金"), "o_orderstatus", F.lit("特別会計受入金"))).when((kind == "general") & (tens("l_tax") == 7), overview.MISC)
            .otherwise(F.concat(F.lit("税"), cent(c("l_partkey") % 12))))
    account = F.when(kind != "general", F.concat(F.lit("会計"), cent(c("l_suppkey") % 7)))
    purpose = F.when(q % 10 < 8, cent(q % 10))
    return lines.select("year", kind.alias("kind"), side.alias("side"), account.alias("account"), F.col("l_returnflag").alias("sub_account"), category.alias("category"), item.alias("item"),
                        purpose.alias("purpose"), A.cents("l_extendedprice").alias("amount"))


BOOK = """WITH k AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN l_suppkey % 10 < 6 THEN 'general' WHEN l_suppkey % 10 < 9 THEN 'special' ELSE 'agency' END AS kind,
 CAST(ROUND(l_discount * 100) AS INTEGER) AS d, CAST(ROUND(l_tax * 100) AS INTEGER) AS x, CAST(trunc(l_quantity) AS INTEGER) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT year, kind, l_linenumber % 2 = 1 AS rev, CASE WHEN kind <> 'general' THEN '会計' || l_suppkey % 7 END AS account, l_returnflag AS sub_account,
 CASE WHEN kind = 'special' AND d = 10 THEN '他会計より受入' WHEN kind = 'special' AND d = 9 THEN '他勘定より受入' WHEN q < 20 THEN '租税' WHEN q < 22 THEN '諸収入' WHEN q < 40 THEN '公債金' ELSE '款' || q END AS category,
 CASE WHEN kind = 'special' AND d = 8 THEN '一般会計より受入' || q WHEN kind = 'general' AND x = 8 THEN '年金' || o_orderstatus || '特別会計受入金' WHEN kind = 'general' AND x = 7 THEN '諸収入'
  ELSE '税' || l_partkey % 12 END AS item,
 CASE WHEN q % 10 < 8 THEN CAST(q % 10 AS VARCHAR) END AS purpose, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS amount FROM k),
f AS (SELECT *, rev AND (category = '他会計より受入' OR item LIKE '%一般会計より受入%') AS tin, NOT rev AND COALESCE(purpose, '') = '6' AS tout, rev AND category = '他勘定より受入' AS sub,
 rev AND kind = 'general' AND item LIKE '%特別会計受入金' AS fs FROM r),
t0 AS (SELECT year, """ + ", ".join(f"CAST(COALESCE(SUM(amount) FILTER ({test}), 0) AS BIGINT) AS {name}" for name, test in {
    **{f"{k}_{s}": f"kind = '{k}' AND {'' if s == 'revenue' else 'NOT '}rev" for k in ("general", "special", "agency") for s in ("revenue", "expenditure")},
    "general_to_other": "kind = 'general' AND tout", "special_to_other": "kind = 'special' AND tout", "received_by_special": "kind = 'special' AND tin",
    "received_between_sub_accounts": "kind = 'special' AND sub", "special_to_general": "fs", "special_own": "kind = 'special' AND rev AND NOT tin AND NOT sub"}.items()) + """ FROM f GROUP BY 1),
t1 AS (SELECT *, general_expenditure - general_to_other AS general_net, special_expenditure - special_to_other AS special_net, general_expenditure + special_expenditure + agency_expenditure AS gross FROM t0),
t AS (SELECT *, gross - received_by_special - received_between_sub_accounts AS net FROM t1)"""


@query(BOOK + " SELECT * FROM t")
def overview_totals(spark, sf_dir):
    return overview.totals(overview.flagged(book(spark, sf_dir)))


PURPOSE = "CASE purpose " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in overview.PURPOSES.items()) + f" ELSE '{overview.UNKNOWN_PURPOSE}' END"
GROUPS = BOOK + ",\ng AS (" + " UNION ALL ".join(f"SELECT year, '{n}' AS list, {name} AS name, CAST(SUM(amount) AS BIGINT) AS amount FROM f WHERE {test} GROUP BY 1, 3" for n, test, name in (
    ("general.category", "kind = 'general' AND rev", "category"), ("general.taxes", "kind = 'general' AND rev AND category = '租税'", "item"), ("general.from_special", "fs", "item"),
    ("general.purpose", "kind = 'general' AND NOT rev", PURPOSE), ("general.destination", "kind = 'general' AND tout", "item"), ("special.category", "kind = 'special' AND rev", "category"),
    ("special.own", "kind = 'special' AND rev AND NOT tin AND NOT sub", "category"), ("special.purpose", "kind = 'special' AND NOT rev", PURPOSE),
    ("special.destination", "kind = 'special' AND tout", "item"), ("agency.category", "kind = 'agency' AND rev", "category"), ("agency.agency", "kind = 'agency' AND NOT rev", "account"))) + ")"


@query(GROUPS + " SELECT * FROM g WHERE name <> ''")
def overview_groups(spark, sf_dir):
    return overview.groups(overview.flagged(book(spark, sf_dir)))


FLOWS = GROUPS + """,
less AS (SELECT s.year, COALESCE(c.name, '諸収入') AS name, SUM(s.amount) AS v FROM g s LEFT JOIN g c ON c.list = 'general.category' AND c.year = s.year AND c.name = s.name
         WHERE s.list = 'general.from_special' GROUP BY 1, 2),
named AS (SELECT g.year, 'src-tax-' AS prefix, 6 AS most, g.name, g.amount, c.amount AS total FROM g JOIN g c ON c.year = g.year AND c.list = 'general.category' AND c.name = '租税' WHERE g.list = 'general.taxes'
  UNION ALL SELECT g.year, 'src-general-', 8, g.name, GREATEST(g.amount - COALESCE(less.v, 0), 0), general_revenue FROM g JOIN t USING (year) LEFT JOIN less ON less.year = g.year AND less.name = g.name
   WHERE g.list = 'general.category' AND g.name <> '租税'
  UNION ALL SELECT g.year, 'src-special-', 8, g.name, g.amount, special_own FROM g JOIN t USING (year) WHERE g.list = 'special.own'),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY year, prefix ORDER BY amount DESC, name) AS rk FROM named WHERE amount > 0),
src AS (SELECT year, prefix || CASE WHEN total > 0 AND amount::DOUBLE / total >= 0.01 AND rk <= most THEN name ELSE 'other' END AS id,
         CASE WHEN prefix = 'src-special-' THEN 'account-special' ELSE 'account-general' END AS target, CAST(SUM(amount) AS BIGINT) AS value FROM ranked GROUP BY 1, 2, 3),
fixed AS (
 SELECT year, 'src-from-special' AS id, special_to_general AS value, FALSE AS always FROM t UNION ALL SELECT year, 'src-agency', agency_revenue, FALSE FROM t WHERE agency_expenditure > 0
 UNION ALL SELECT year, 'src-agency-shortfall', agency_expenditure - agency_revenue, FALSE FROM t WHERE agency_expenditure > 0
 UNION ALL SELECT year, 'account-general', general_revenue, TRUE FROM t UNION ALL SELECT year, 'account-special', special_revenue, TRUE FROM t UNION ALL SELECT year, 'account-agency', agency_expenditure, FALSE FROM t
 UNION ALL SELECT year, 'src-special-reentry', received_by_special - general_to_other, FALSE FROM t UNION ALL SELECT year, 'src-subaccount-reentry', received_between_sub_accounts, FALSE FROM t
 UNION ALL SELECT year, 'net-general', general_net, TRUE FROM t UNION ALL SELECT year, 'surplus-general', general_revenue - general_expenditure, FALSE FROM t
 UNION ALL SELECT year, 'transfer-special', special_to_other, FALSE FROM t UNION ALL SELECT year, 'net-special', special_net, TRUE FROM t
 UNION ALL SELECT year, 'surplus-special', special_revenue - special_expenditure, FALSE FROM t UNION ALL SELECT year, 'net-agency', agency_expenditure, FALSE FROM t),
links AS (SELECT year, id AS source, target, value FROM src UNION ALL
 SELECT year, CASE WHEN id LIKE 'src-%' THEN id WHEN id LIKE '%-general' THEN 'account-general' WHEN id LIKE '%-special' THEN 'account-special' ELSE 'account-agency' END,
        CASE WHEN id = 'src-from-special' THEN 'account-general' WHEN id LIKE 'src-agency%' THEN 'account-agency' WHEN id LIKE 'src-%' THEN 'account-special' ELSE id END, value
 FROM fixed WHERE id NOT LIKE 'account-%' AND value > 0 UNION ALL SELECT year, 'account-general', 'account-special', general_to_other FROM t WHERE general_to_other > 0)"""


@query(FLOWS + " SELECT year, id, value FROM src UNION ALL SELECT year, id, value FROM fixed WHERE always OR value > 0")
def overview_nodes(spark, sf_dir):
    return overview.overview(book(spark, sf_dir))[0].select("year", "id", "value")


@query(FLOWS + " SELECT * FROM links")
def overview_flows(spark, sf_dir):
    return overview.overview(book(spark, sf_dir))[1]


@query(FLOWS + """ SELECT year, id, CAST(COALESCE((SELECT SUM(value) FROM links l WHERE l.year = a.year AND target = id), 0) AS BIGINT) AS inflow,
CAST(COALESCE((SELECT SUM(value) FROM links l WHERE l.year = a.year AND source = id), 0) AS BIGINT) AS outflow FROM (SELECT DISTINCT year, id FROM fixed WHERE id LIKE 'account-%' AND value > 0) a""")
def overview_balance(spark, sf_dir):
    return overview.balance(overview.overview(book(spark, sf_dir))[1])
