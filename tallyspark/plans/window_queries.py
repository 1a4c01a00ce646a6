"""Windows in the other modes: over recipients, and in focus on a recipient, a ministry or a project; totals and members of a window.

Values of scaled budgets are fractions; the queries give them in tens of thousands, so that the order of a sum doesn't show.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import windows
from tallyspark.plans import adapter as A
from tallyspark.plans.query import View

from .catalog import query
from .flow_queries import TOPN, YEAR, model_sql, view


def mode_sql(*, top="rn <= 8 OR n = 9", base="TRUE", offset=0, visible="spent - tb", pinned="FALSE", ranked="top", order="shown", chosen="COALESCE(place <= 20, FALSE)",
             other="NOT (COALESCE(place <= 20, FALSE)) AND NOT hidden", count="TRUE", seen="rn <= 8 OR n = 9") -> str:
    """The classes of a view of 8 ministries, 20 projects and 15 recipients that doesn't move over projects."""
    last = offset + 15
    return "WITH " + model_sql() + f""",
m AS (SELECT ministry, ROW_NUMBER() OVER (ORDER BY SUM(budget) DESC, 'ministry-' || ministry) AS rn, COUNT(*) OVER () AS n FROM p GROUP BY 1),
q AS (SELECT p.*, 'project-spending-' || pid AS sid, {top} AS top FROM p JOIN m USING (ministry)),
rr AS (SELECT e.id AS rid, CAST(SUM(e.amount) AS BIGINT) AS amount, ROW_NUMBER() OVER (ORDER BY SUM(e.amount) DESC, e.id) AS rk, COUNT(*) OVER () AS n FROM e JOIN q USING (pid) WHERE {base} GROUP BY 1),
rc AS (SELECT rid, amount, (rk > {offset} AND rk <= {last}) OR (rk > {last} AND n = {last + 1}) AS w, rk > {last} AND n > {last + 1} AS t, rk <= {offset} AS bf FROM rr),
x AS (SELECT e.pid, e.id AS rid, e.amount, COALESCE(w, FALSE) AS w, COALESCE(t, FALSE) AS t, COALESCE(bf, FALSE) AS bf FROM e LEFT JOIN rc ON rc.rid = e.id),
f AS (SELECT pid, SUM(CASE WHEN w THEN amount ELSE 0 END) AS tw, SUM(CASE WHEN t THEN amount ELSE 0 END) AS tt, SUM(CASE WHEN bf THEN amount ELSE 0 END) AS tb FROM x GROUP BY 1),
v0 AS (SELECT q.*, COALESCE(tw, 0) AS tw, COALESCE(tt, 0) AS tt, COALESCE(tb, 0) AS tb FROM q LEFT JOIN f USING (pid)),
v1 AS (SELECT *, {visible} AS visible, tw + tt AS shown, spent > 0 AND NOT ({pinned}) AND tw + tt = 0 AS hidden FROM v0),
v AS (SELECT *, budget * CASE WHEN spent > 0 THEN GREATEST(0, LEAST(1, visible::DOUBLE / spent::DOUBLE)) ELSE 1 END AS adj FROM v1),
k AS (SELECT pid, ROW_NUMBER() OVER (ORDER BY {order} DESC, adj DESC, sid) AS place FROM v WHERE {ranked}),
c0 AS (SELECT v.*, {chosen} AS chosen, {other} AS other FROM v LEFT JOIN k USING (pid)),
c1 AS (SELECT *, SUM(other::INT) OVER () = 1 AS lone FROM c0),
c AS (SELECT pid, sid, ministry, budget, spent, top, tw, visible, adj, hidden, chosen OR (other AND lone) AS chosen, other AND NOT lone AS other FROM c1),
mm AS (SELECT ministry, {seen} AS seen, own, sp FROM (SELECT ministry, SUM(adj) AS own, SUM(GREATEST(visible, 0)) AS sp FROM c WHERE NOT hidden AND ({count}) GROUP BY 1) JOIN m USING (ministry)),
y AS (SELECT x.*, c.sid, c.chosen, c.other, c.hidden FROM x JOIN c USING (pid)),
nodes AS (
 SELECT 'total' AS id, SUM(own)::DOUBLE AS value FROM mm UNION ALL SELECT 'ministry-' || ministry, own FROM mm WHERE seen AND (own > 0 OR sp > 0) UNION ALL
 SELECT '__agg-ministry', SUM(own) FROM mm WHERE NOT seen HAVING SUM(own) > 0 OR SUM(sp) > 0 UNION ALL
 SELECT 'project-budget-' || pid, adj FROM c WHERE chosen AND NOT hidden UNION ALL SELECT sid, visible::DOUBLE FROM c WHERE chosen AND NOT hidden UNION ALL
 SELECT '__agg-project-budget', SUM(adj) FROM c WHERE other HAVING SUM(adj) > 0 OR SUM(visible) > 0 UNION ALL
 SELECT '__agg-project-spending', SUM(visible)::DOUBLE FROM c WHERE other HAVING SUM(adj) > 0 OR SUM(visible) > 0 UNION ALL
 SELECT rid, amount::DOUBLE FROM rc WHERE w UNION ALL SELECT '__agg-recipient', SUM(amount)::DOUBLE FROM rc WHERE t HAVING COUNT(*) > 0),
edges AS (
 SELECT 'total' AS source, 'ministry-' || ministry AS target, own AS value FROM mm WHERE seen AND (own > 0 OR sp > 0) UNION ALL
 SELECT 'total', '__agg-ministry', SUM(own) FROM mm WHERE NOT seen HAVING SUM(own) > 0 OR SUM(sp) > 0 UNION ALL
 SELECT 'ministry-' || ministry, 'project-budget-' || pid, adj FROM c WHERE chosen AND NOT hidden UNION ALL SELECT 'project-budget-' || pid, sid, adj FROM c WHERE chosen AND NOT hidden UNION ALL
 SELECT CASE WHEN top THEN 'ministry-' || ministry ELSE '__agg-ministry' END, '__agg-project-budget', SUM(adj) FROM c WHERE other GROUP BY 1 UNION ALL
 SELECT '__agg-project-budget', '__agg-project-spending', SUM(adj) FROM c WHERE other HAVING SUM(visible) > 0 UNION ALL
 SELECT * FROM (SELECT CASE WHEN chosen THEN sid ELSE '__agg-project-spending' END AS a, CASE WHEN w THEN rid ELSE '__agg-recipient' END AS b, SUM(amount)::DOUBLE AS v FROM y
  WHERE (chosen AND ((w AND NOT hidden) OR t)) OR (other AND (w OR t)) GROUP BY 1, 2) WHERE v > 0)"""


NODES = "\nSELECT id, CAST(ROUND(value / 10000) AS BIGINT) AS value FROM nodes"
EDGES = "\nSELECT source, target, CAST(ROUND(value / 10000) AS BIGINT) AS value FROM edges"


def shown(spark, sf_dir, **options) -> windows.Windowed:
    return windows.windowed(A.graph(spark, sf_dir, YEAR), View(top_ministry=8, top_project=20, top_recipient=15, offset_target="recipient", **options))


def coarse():
    return F.round(F.col("value") / 10000).cast("long").alias("value")


def node_values(w: windows.Windowed):
    """The nodes as SQL sums them: over no project at all the total is null, where the operator says 0 as the model does. Its raw value is such a sum."""
    return w.nodes.select("id", F.when((F.col("id") != "total") | F.col("raw_value").isNotNull(), coarse()).alias("value"))


RECIPIENTS = mode_sql(offset=5)


@query(RECIPIENTS + NODES)
def recipient_window_nodes(spark, sf_dir):
    return node_values(shown(spark, sf_dir, recipient_offset=5))


@query(RECIPIENTS + EDGES)
def recipient_window_edges(spark, sf_dir):
    return shown(spark, sf_dir, recipient_offset=5).edges.select("source", "target", coarse())


ON_RECIPIENT = mode_sql(base="e.id = 'r-2'", visible="tw", ranked="tw > 0", order="tw", other="COALESCE(place > 20, FALSE)", count="chosen OR other", seen="TRUE")


@query(ON_RECIPIENT + NODES)
def recipient_focus_nodes(spark, sf_dir):
    return node_values(shown(spark, sf_dir, focus=True, pin_recipient="r-2"))


@query(ON_RECIPIENT + EDGES)
def recipient_focus_edges(spark, sf_dir):
    return shown(spark, sf_dir, focus=True, pin_recipient="r-2").edges.select("source", "target", coarse())


IN_MINISTRY = mode_sql(top="ministry = 'NATION_3'", base="ministry = 'NATION_3'", offset=2, other="NOT (COALESCE(place <= 20, FALSE)) AND NOT hidden AND top", count="ministry = 'NATION_3'", seen="TRUE")


@query(IN_MINISTRY + NODES)
def ministry_focus_nodes(spark, sf_dir):
    return node_values(shown(spark, sf_dir, focus=True, pin_ministry="NATION_3", recipient_offset=2))


@query(IN_MINISTRY + EDGES)
def ministry_focus_edges(spark, sf_dir):
    return shown(spark, sf_dir, focus=True, pin_ministry="NATION_3", recipient_offset=2).edges.select("source", "target", coarse())


PINNED = "project-spending-7"
ON_PROJECT = mode_sql(base="pid = 7", pinned="pid = 7", chosen="pid = 7", other="FALSE", count="pid = 7")


@query(ON_PROJECT + NODES)
def project_focus_nodes(spark, sf_dir):
    return node_values(shown(spark, sf_dir, focus=True, pin_project=PINNED))


@query(TOPN + """
SELECT (SELECT COUNT(*) FROM q WHERE top) AS projects, (SELECT COUNT(*) FROM ri) AS recipients""")
def window_totals(spark, sf_dir):
    return windows.totals(windows.windowed(A.graph(spark, sf_dir, YEAR), view()))


@query(TOPN + """
SELECT '__agg-project-budget' AS node, 'project-budget-' || pid AS id, budget AS value FROM c WHERE other UNION ALL
SELECT '__agg-project-spending', id, spent FROM c WHERE other UNION ALL SELECT '__agg-recipient', rid, amount FROM rc WHERE tail""")
def window_members(spark, sf_dir):
    return windows.members(windows.windowed(A.graph(spark, sf_dir, YEAR), view()))
