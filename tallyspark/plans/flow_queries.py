"""Flow graph queries: filters, summaries, comparisons, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import filters, summary
from tallyspark.plans import adapter as A
from tallyspark.plans.query import Filter, Name, Range

from .catalog import query

YEAR = 1997


def model_sql(year: int = YEAR, tag: str = "") -> str:
    """Common table expressions of one year: b(pid, budget, account), s(pid, rid, recipient, amount), p, r."""
    return f"""
o{tag} AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{year}-01-01' AND o_orderdate < TIMESTAMP '{year + 1}-01-01'),
b{tag} AS (SELECT o_custkey AS pid, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT) * 100) AS BIGINT) AS budget,
           CASE WHEN BOOL_OR(o_orderstatus = 'F') AND BOOL_OR(o_orderstatus = 'O') THEN 'both' WHEN BOOL_OR(o_orderstatus = 'F') THEN 'general'
                WHEN BOOL_OR(o_orderstatus = 'O') THEN 'special' ELSE 'none' END AS account FROM o{tag} GROUP BY 1),
s{tag} AS (SELECT o_custkey AS pid, s_name AS recipient,
           CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))) AS BIGINT) AS amount
           FROM lineitem JOIN o{tag} ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
p{tag} AS (SELECT b.pid, c_name AS name, n_name AS ministry, c_mktsegment AS category, b.budget, b.account,
           CAST(COALESCE(t.spent, 0) AS BIGINT) AS spent FROM b{tag} b JOIN customer ON c_custkey = b.pid JOIN nation ON n_nationkey = c_nationkey
           LEFT JOIN (SELECT pid, SUM(amount) AS spent FROM s{tag} GROUP BY 1) t ON t.pid = b.pid),
r{tag} AS (SELECT recipient, total, 'r-' || ROW_NUMBER() OVER (ORDER BY total DESC, recipient) AS id FROM
           (SELECT recipient, CAST(SUM(amount) AS BIGINT) AS total FROM s{tag} GROUP BY 1)),
e{tag} AS (SELECT s.pid, r.id, r.recipient, s.amount FROM s{tag} s JOIN r{tag} r USING (recipient)
           UNION ALL SELECT pid, 'r-no-spending', '支出先なし', 0 FROM p{tag} WHERE budget > 0 AND spent = 0)"""


FILTER = Filter(ministries=(), budget=Range(2_000_000_000, None), spending=Range(None, None), accounts=("general", "both", "none"))

FILTERED = "WITH " + model_sql() + """,
kept AS (SELECT * FROM p WHERE budget >= 2000000000 AND account IN ('general', 'both', 'none')),
ke AS (SELECT e.* FROM e JOIN kept USING (pid)),
inflow AS (SELECT id, SUM(amount) AS inflow FROM ke GROUP BY 1),
top AS (SELECT * FROM inflow ORDER BY inflow DESC, id LIMIT 3)"""


def filtered(spark, sf_dir):
    g = A.graph(spark, sf_dir, YEAR)
    return filters.applied(g, filters.excluded(g, FILTER))


@query(FILTERED + """
SELECT (SELECT COUNT(*) FROM kept) AS project_count, (SELECT CAST(SUM(budget) AS BIGINT) FROM kept) AS budget_total,
       (SELECT CAST(SUM(amount) AS BIGINT) FROM ke) AS spending_total, (SELECT COUNT(*) FROM inflow) AS recipient_count,
       FLOOR((SELECT MAX(inflow) FROM top)::DOUBLE / (SELECT SUM(inflow) FROM inflow) * 10000 + 0.5) / 10000 AS top_share1,
       FLOOR((SELECT SUM(inflow) FROM top)::DOUBLE / (SELECT SUM(inflow) FROM inflow) * 10000 + 0.5) / 10000 AS top_share3,
       (SELECT COUNT(DISTINCT ministry) FROM kept) AS ministry_count""")
def filtered_summary(spark, sf_dir):
    return summary.totals(filtered(spark, sf_dir)).drop("ministries")


@query(FILTERED + """
SELECT k.pid, k.name, k.ministry, k.budget, CAST(COALESCE(SUM(ke.amount), 0) AS BIGINT) AS spending
FROM kept k LEFT JOIN ke USING (pid) GROUP BY 1, 2, 3, 4 ORDER BY spending DESC, budget DESC, pid LIMIT 10""")
def topn_projects(spark, sf_dir):
    return summary.top_projects(filtered(spark, sf_dir)).drop("id")


@query(FILTERED + """
SELECT i.id, MAX(ke.recipient) AS name, CAST(i.inflow AS BIGINT) AS inflow FROM inflow i JOIN ke USING (id) GROUP BY 1, 3 ORDER BY inflow DESC, id LIMIT 10""")
def topn_recipients(spark, sf_dir):
    return summary.top_recipients(filtered(spark, sf_dir)).drop("aggregated")


NODES = """
SELECT 'total' AS id, 'total' AS type, CAST(SUM(budget) AS BIGINT) AS value FROM b
UNION ALL SELECT 'ministry-' || ministry, 'ministry', CAST(SUM(budget) AS BIGINT) FROM p GROUP BY ministry
UNION ALL SELECT 'project-budget-' || pid, 'project-budget', budget FROM p
UNION ALL SELECT 'project-spending-' || pid, 'project-spending', spent FROM p
UNION ALL SELECT id, 'recipient', total FROM r
UNION ALL (SELECT 'r-no-spending', 'recipient', 0 FROM p WHERE budget > 0 AND spent = 0 LIMIT 1)"""


@query("WITH " + model_sql() + NODES)
def graph_nodes(spark, sf_dir):
    return A.graph(spark, sf_dir, YEAR).nodes.select("id", "type", "value")


EDGES = """
SELECT 'total' AS source, 'ministry-' || ministry AS target, CAST(SUM(budget) AS BIGINT) AS value FROM p GROUP BY ministry HAVING SUM(budget) > 0
UNION ALL SELECT 'ministry-' || ministry, 'project-budget-' || pid, budget FROM p WHERE budget > 0
UNION ALL SELECT 'project-budget-' || pid, 'project-spending-' || pid, LEAST(budget, spent) FROM p WHERE LEAST(budget, spent) > 0
UNION ALL SELECT 'project-spending-' || pid, id, amount FROM e"""


@query("WITH " + model_sql() + EDGES)
def graph_edges(spark, sf_dir):
    return A.graph(spark, sf_dir, YEAR).edges


CASCADE = Filter(recipient_name=Name("supplier#0*[1-9]1$", regex=True), budget=Range(None, 60_000_000_000), spending=Range(1_000_000_000, None))


@query("WITH " + model_sql() + """,
gone AS (SELECT id FROM r WHERE total < 1000000000 OR NOT regexp_matches(recipient, '(?i)supplier#0*[1-9]1$')
         UNION ALL SELECT 'r-no-spending' WHERE TRUE),
bad AS (SELECT pid FROM p WHERE budget > 60000000000 UNION SELECT pid FROM p WHERE pid NOT IN (SELECT pid FROM e WHERE id NOT IN (SELECT id FROM gone))),
live AS (SELECT * FROM p WHERE pid NOT IN (SELECT pid FROM bad))
SELECT id FROM gone WHERE id <> 'r-no-spending' OR EXISTS (SELECT 1 FROM p WHERE budget > 0 AND spent = 0)
UNION ALL SELECT 'project-budget-' || pid FROM bad UNION ALL SELECT 'project-spending-' || pid FROM bad
UNION ALL SELECT DISTINCT 'ministry-' || ministry FROM p WHERE ministry NOT IN (SELECT ministry FROM live WHERE budget > 0 OR spent > 0)""")
def cascade_exclusion(spark, sf_dir):
    return filters.excluded(A.graph(spark, sf_dir, YEAR), CASCADE)


@query("WITH " + model_sql() + "," + model_sql(YEAR + 1, "2") + """
SELECT COALESCE(a.pid, c.pid) AS pid, CASE WHEN a.pid IS NULL THEN 'added' WHEN c.pid IS NULL THEN 'removed' WHEN c.spent > a.spent THEN 'increased'
       WHEN c.spent < a.spent THEN 'decreased' ELSE 'same' END AS status,
       a.spent AS spending_base, c.spent AS spending_compare, c.spent - a.spent AS spending_diff, c.budget - a.budget AS budget_diff,
       CASE WHEN a.budget <> 0 THEN FLOOR((c.budget - a.budget)::DOUBLE / a.budget::DOUBLE * 10000 + 0.5) / 10000 END AS budget_diff_rate,
       CASE WHEN a.spent <> 0 THEN FLOOR((c.spent - a.spent)::DOUBLE / a.spent::DOUBLE * 10000 + 0.5) / 10000 END AS spending_diff_rate
FROM p a FULL OUTER JOIN p2 c ON a.pid = c.pid""")
def compare_years(spark, sf_dir):
    return summary.compare_project_tables(A.project_table(spark, sf_dir, YEAR), A.project_table(spark, sf_dir, YEAR + 1)).drop(
        "name", "ministry", "budget_base", "budget_compare")


@query("WITH " + model_sql() + "," + model_sql(YEAR + 1, "2") + """,
x AS (SELECT recipient AS key, CAST(SUM(amount) AS BIGINT) AS v FROM e GROUP BY 1), y AS (SELECT recipient AS key, CAST(SUM(amount) AS BIGINT) AS v FROM e2 GROUP BY 1)
SELECT COALESCE(x.key, y.key) AS key, CASE WHEN x.key IS NULL THEN 'added' WHEN y.key IS NULL THEN 'removed' WHEN y.v > x.v THEN 'increased'
       WHEN y.v < x.v THEN 'decreased' ELSE 'same' END AS status, x.v AS inflow_base, y.v AS inflow_compare, y.v - x.v AS diff,
       CASE WHEN x.v <> 0 THEN FLOOR((y.v - x.v)::DOUBLE / x.v::DOUBLE * 10000 + 0.5) / 10000 END AS diff_rate
FROM x FULL OUTER JOIN y ON x.key = y.key""")
def compare_recipients(spark, sf_dir):
    return summary.compare_recipients(A.graph(spark, sf_dir, YEAR), A.graph(spark, sf_dir, YEAR + 1), by="name").drop("name")


@query("WITH " + model_sql() + "," + model_sql(YEAR + 1, "2") + """
SELECT p2.pid, CAST(p2.spent AS BIGINT) AS spending_compare FROM p2 WHERE pid NOT IN (SELECT pid FROM p) ORDER BY 2 DESC, 1 LIMIT 10""")
def added_projects(spark, sf_dir):
    changes = summary.compare_project_tables(A.project_table(spark, sf_dir, YEAR), A.project_table(spark, sf_dir, YEAR + 1))
    return summary.largest_changes(changes, "added").select("pid", "spending_compare")


# ---- TopN window: projects ranked by budget in the top ministries ------------------------------------------------------

def view():
    from tallyspark.plans.query import View

    return View(top_ministry=8, top_project=20, top_recipient=15, project_offset=3)


TOPN = "WITH " + model_sql() + """,
m AS (SELECT ministry, CAST(SUM(budget) AS BIGINT) AS value, ROW_NUMBER() OVER (ORDER BY SUM(budget) DESC, 'ministry-' || ministry) AS rn FROM p GROUP BY 1),
q AS (SELECT p.*, 'project-spending-' || pid AS id, m.rn <= 8 AS top FROM p JOIN m USING (ministry)),
k AS (SELECT id, ROW_NUMBER() OVER (ORDER BY budget DESC, spent DESC, id) - LEAST(3, GREATEST(0, COUNT(*) OVER () - 20)) AS place FROM q WHERE top),
c0 AS (SELECT q.*, COALESCE(place <= 0, FALSE) AS above, COALESCE(place BETWEEN 1 AND 20, FALSE) AS win, COALESCE(place > 20, FALSE) AS tailp
       FROM q LEFT JOIN k USING (id)),
ri AS (SELECT e.id AS rid, CAST(SUM(e.amount) AS BIGINT) AS amount FROM e JOIN c0 ON c0.pid = e.pid WHERE win GROUP BY 1),
rr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY amount DESC, rid) AS rank, COUNT(*) OVER () AS n FROM ri),
rc AS (SELECT rid, amount, rank <= 15 OR n = 16 AS win, rank > 15 AND n > 16 AS tail FROM rr),
x AS (SELECT e.pid, e.id AS rid, e.amount, COALESCE(rc.win, FALSE) AS rwin, COALESCE(rc.tail, FALSE) AS rtail FROM e LEFT JOIN rc ON rc.rid = e.id),
f AS (SELECT pid, SUM(CASE WHEN rwin OR rtail THEN amount ELSE 0 END) AS shown FROM x GROUP BY 1),
c1 AS (SELECT c0.*, spent > 0 AND NOT above AND NOT tailp AND COALESCE(shown, 0) = 0 AS hidden FROM c0 LEFT JOIN f USING (pid)),
c AS (SELECT *, (tailp AND NOT hidden) OR (NOT top AND NOT win AND NOT hidden) AS other FROM c1),
xe AS (SELECT x.*, c.id AS sid, c.win, c.other, c.above, c.hidden FROM x JOIN c USING (pid)),
mm AS (SELECT ministry, SUM(budget)::DOUBLE AS v FROM c WHERE NOT hidden AND NOT above GROUP BY 1)"""


@query(TOPN + """
SELECT 'total' AS id, SUM(v) AS value FROM mm
UNION ALL SELECT 'ministry-' || ministry, v FROM mm JOIN m USING (ministry) WHERE rn <= 8
UNION ALL SELECT '__agg-ministry', SUM(v) FROM mm JOIN m USING (ministry) WHERE rn > 8
UNION ALL SELECT 'project-budget-' || pid, budget::DOUBLE FROM c WHERE win AND NOT hidden
UNION ALL SELECT id, spent::DOUBLE FROM c WHERE win AND NOT hidden
UNION ALL SELECT '__agg-project-budget', SUM(budget)::DOUBLE FROM c WHERE other
UNION ALL SELECT '__agg-project-spending', SUM(spent)::DOUBLE FROM c WHERE other
UNION ALL SELECT rid, SUM(CASE WHEN NOT above THEN amount ELSE 0 END)::DOUBLE FROM xe WHERE rwin GROUP BY 1
UNION ALL SELECT '__agg-recipient', (SELECT COALESCE(SUM(amount), 0) FROM rc WHERE tail)::DOUBLE
          - (SELECT COALESCE(SUM(amount), 0) FROM xe WHERE hidden AND rtail)::DOUBLE + (SELECT COALESCE(SUM(amount), 0) FROM xe WHERE other AND NOT rwin AND NOT rtail)::DOUBLE
          WHERE EXISTS (SELECT 1 FROM rc WHERE tail) OR EXISTS (SELECT 1 FROM xe WHERE other AND NOT rwin AND NOT rtail)""")
def topn_window_nodes(spark, sf_dir):
    from tallyspark.operators.windows import AGG, windowed

    nodes = windowed(A.graph(spark, sf_dir, YEAR), view()).nodes
    # the SQL has these rows over no project too, with null; the operator leaves such aggregates out, and says 0 for the total as the model does
    always = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("total", AGG["ministry"], AGG["project-budget"], AGG["project-spending"])])).alias("id"))
    return nodes.where("id <> 'total' or raw_value is not null").select("id", "value").join(always, "id", "full_outer")


@query(TOPN + """
SELECT source, target, value FROM (
SELECT CASE WHEN win THEN sid ELSE '__agg-project-spending' END AS source, CASE WHEN rwin THEN rid ELSE '__agg-recipient' END AS target,
       SUM(amount)::DOUBLE AS value FROM xe WHERE (win AND ((rwin AND NOT hidden) OR rtail)) OR other GROUP BY 1, 2) WHERE value > 0
UNION ALL SELECT 'total', 'ministry-' || ministry, v FROM mm JOIN m USING (ministry) WHERE rn <= 8
UNION ALL SELECT 'total', '__agg-ministry', SUM(v) FROM mm JOIN m USING (ministry) WHERE rn > 8
UNION ALL SELECT 'ministry-' || ministry, 'project-budget-' || pid, budget::DOUBLE FROM c WHERE win AND NOT hidden
UNION ALL SELECT 'project-budget-' || pid, id, budget::DOUBLE FROM c WHERE win AND NOT hidden
UNION ALL SELECT CASE WHEN top THEN 'ministry-' || ministry ELSE '__agg-ministry' END, '__agg-project-budget', SUM(budget)::DOUBLE FROM c WHERE other GROUP BY 1
UNION ALL SELECT '__agg-project-budget', '__agg-project-spending', SUM(budget)::DOUBLE FROM c WHERE other""")
def other_bucket_edges(spark, sf_dir):
    from tallyspark.operators.windows import windowed

    return windowed(A.graph(spark, sf_dir, YEAR), view()).edges


@query(TOPN + """,
z AS (SELECT c.*, COALESCE(f.shown, 0) AS shown FROM c LEFT JOIN f USING (pid) WHERE win AND NOT hidden)
SELECT id, CAST(ROW_NUMBER() OVER (ORDER BY budget DESC, shown DESC, id) AS INTEGER) AS place FROM z""")
def project_places(spark, sf_dir):
    from tallyspark.operators.windows import display_order, windowed

    return display_order(windowed(A.graph(spark, sf_dir, YEAR), view()), view())


# ---- stacked drawing ----------------------------------------------------------------------------------------------------------

#: A power of two, so that sums of heights are exact.
SCALE = 2.0**-30
COLUMNS = {"total": 0, "ministry": 1, "project-budget": 2, "project-spending": 3, "recipient": 4}
STACKED = "WITH " + model_sql() + ",\nnodes AS (" + NODES + "),\nedges AS (" + EDGES + """),
cols AS (SELECT *, CASE type WHEN 'total' THEN 0 WHEN 'ministry' THEN 1 WHEN 'project-budget' THEN 2 WHEN 'project-spending' THEN 3 ELSE 4 END AS col,
 GREATEST(1.0::DOUBLE, value * power(2.0::DOUBLE, -30)) AS h FROM nodes),
sized AS (SELECT *, h + CASE WHEN h < 10 THEN 10 ELSE 2 END AS room FROM cols),
placed AS (SELECT id, col * 220.0::DOUBLE + CASE WHEN col >= 2 THEN 40 ELSE 0 END AS x0, SUM(room) OVER (PARTITION BY col ORDER BY value DESC, id ROWS UNBOUNDED PRECEDING) - room AS y0, h FROM sized)"""


def drawn(spark, sf_dir):
    from tallyspark.operators import stacking

    g = A.graph(spark, sf_dir, YEAR)
    col = F.create_map(*[F.lit(x) for pair in COLUMNS.items() for x in pair])[F.col("type")]
    nodes = g.nodes.select("id", col.alias("col"), (-F.col("value")).alias("place"), "value", F.lit(None).cast("long").alias("layout_value"))
    return stacking.stacked_nodes(nodes, SCALE, 220, 10, 40), g.edges


@query(STACKED + " SELECT id, x0, x0 + 18 AS x1, y0, y0 + h AS y1 FROM placed")
def stacked_nodes(spark, sf_dir):
    return drawn(spark, sf_dir)[0].select("id", "x0", "x1", "y0", "y1")


@query(STACKED + """,
j AS (SELECT e.*, a.y0 AS sy, a.h AS sh, b.y0 AS ty, b.h AS th FROM edges e JOIN placed a ON a.id = source JOIN placed b ON b.id = target),
k AS (SELECT *, CAST(SUM(value) OVER (PARTITION BY source ORDER BY ty, target ROWS UNBOUNDED PRECEDING) AS BIGINT) AS su, CAST(SUM(value) OVER (PARTITION BY source) AS BIGINT) AS st,
             CAST(SUM(value) OVER (PARTITION BY target ORDER BY sy, source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tu, CAST(SUM(value) OVER (PARTITION BY target) AS BIGINT) AS tt FROM j),
l AS (SELECT *, CASE WHEN st > 0 THEN sh / st ELSE 0 END AS sk, CASE WHEN tt > 0 THEN th / tt ELSE 0 END AS tk FROM k)
SELECT source, target, value, sy + (su - value) * sk AS source_y, CASE WHEN value = 0 THEN 1 ELSE value * sk END AS source_width,
       ty + (tu - value) * tk AS target_y, CASE WHEN value = 0 THEN 1 ELSE value * tk END AS target_width FROM l""")
def stacked_links(spark, sf_dir):
    from tallyspark.operators import stacking

    nodes, edges = drawn(spark, sf_dir)
    return stacking.stacked_links(edges, nodes)


# ---- projects that pay nobody ---------------------------------------------------------------------------------------------------

@query("WITH " + model_sql() + """, k AS (SELECT pid, budget, CASE WHEN pid % 10 = 3 THEN 0 ELSE spent END AS spent FROM p)
SELECT 'project-spending-' || pid AS source, 'r-no-spending' AS target, 0 AS value, (SELECT COUNT(*) FROM k WHERE spent = 0 AND budget > 0) AS unpaid FROM k WHERE spent = 0 AND budget > 0""")
def unpaid_edges(spark, sf_dir):
    """A tenth of the projects pays nobody: they hang at one node without value."""
    from tallyspark.operators.flow import NO_SPENDING, build_graph

    b = A.budgets(spark, sf_dir, YEAR)
    own = A.projects(spark, sf_dir).join(b.select("pid"), "pid", "left_semi")
    g = build_graph(own, b, A.spending(spark, sf_dir, YEAR).where("pid % 10 <> 3"))
    edges = g.edges.where(F.col("target") == NO_SPENDING).join(g.nodes.where(F.col("type") == "recipient").select(F.col("id").alias("target")), "target")
    return edges.crossJoin(edges.agg(F.count(F.lit(1)).alias("unpaid"))).select("source", "target", F.col("value").cast("int").alias("value"), "unpaid")
