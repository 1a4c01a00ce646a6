"""TopN windows over a flow graph with everything else in aggregate nodes.

One row a project and one a recipient carry boolean classes (window, tail, other, hidden ...); nodes and edges of the view are then
sums over the edges by class. Modes: a window of projects (the default), a window of recipients, or a focus on a recipient, ministry or
project. Ties are broken by id.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.plans.query import View
from tallyspark.tables import held

from .flow import NO_SPENDING, Graph
from .prefix import ranked

AGG = {k: f"__agg-{k}" for k in ("ministry", "project-budget", "project-spending", "recipient")}


@dataclass(frozen=True)
class Windowed:
    nodes: DataFrame  # id, type, value, raw_value, members
    edges: DataFrame  # source, target, value
    projects: DataFrame
    recipients: DataFrame


def top_ministries(graph: Graph, n: int, only: str | None = None) -> DataFrame:
    """name, value, top. A single ministry left over is top too; only: that one is, and the others are out."""
    m = graph.nodes.where("type = 'ministry'").select("id", "name", "value").withColumns(  # some tens of ministries
        {"rank": F.row_number().over(Window.orderBy(F.desc("value"), "id")), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    if only is not None:
        return m.where(F.col("name") == only).select("id", "name", "value", F.lit(True).alias("top"))
    return m.select("id", "name", "value", ((F.col("rank") <= n) | (F.col("n") == n + 1)).alias("top"))


def windowed(graph: Graph, view: View, include_zero: bool = True, recipient_filter: bool = False) -> Windowed:
    nodes, c = graph.nodes, F.col
    focus_r = view.focus and view.pin_recipient is not None
    focus_m = view.focus and view.pin_ministry is not None and not focus_r
    focus_p = view.focus and view.pin_project is not None and not focus_r and not focus_m
    by_project = view.offset_target == "project" and not focus_r and not focus_p
    pin = F.lit(view.pin_project)
    no, yes = F.lit(False), F.lit(True)

    ministries = top_ministries(graph, view.top_ministry, view.pin_ministry if focus_m else None)
    budget = nodes.where("type = 'project-budget'").select(c("project_id").alias("pid"), c("value").alias("budget"))
    p = (nodes.where("type = 'project-spending'").select("id", "name", c("project_id").alias("pid"), "ministry", c("value").alias("spent"))
         .join(budget, "pid", "left").join(ministries.select(c("name").alias("ministry"), "top"), "ministry", "left")
         .withColumns({"top": F.coalesce("top", no), "has_budget": c("budget").isNotNull(), "budget": F.coalesce("budget", F.lit(0)),
                       "pinned": F.coalesce(c("id") == pin, no), "zero": no if include_zero else c("spent") == 0}))
    order = [F.desc("budget"), F.desc("spent"), c("id")] if view.sort_by == "budget" else [F.desc("spent"), c("id")]
    classes = {"above": no, "in_window": no, "in_tail": no}
    if by_project:
        scope = ranked(p.where("top and not zero").select("id", "budget", "spent"), *order)
        first = F.least(F.lit(view.project_offset), F.greatest(F.lit(0), c("n") - view.top_project))
        p = p.join(scope.select("id", "rank", (c("rank") - first).alias("place")), "id", "left")
        classes = {"above": F.coalesce(c("place") <= 0, no) & ~c("pinned"),
                   "in_window": F.coalesce(c("place").between(1, view.top_project), no) | (c("pinned") & c("place").isNotNull()),
                   "in_tail": F.coalesce(c("place") > view.top_project, no)}
    p = held(p.withColumns(classes))

    edges = held(graph.edges.where(c("target").startswith("r-"))
                 .join(p.select(c("id").alias("source"), "ministry", "in_window", "above"), "source"))
    inflow = lambda e: e.groupBy(c("target").alias("rid")).agg(F.sum("value").alias("amount"))
    everyone, offset = inflow(edges), view.recipient_offset
    n_all = everyone.count() if by_project else 0
    if focus_r:
        base, offset = everyone.where(c("rid") == view.pin_recipient), 0
    elif by_project:
        base, offset = (everyone if recipient_filter or n_all <= view.top_recipient else inflow(edges.where("in_window"))), 0
    elif focus_m:
        base = inflow(edges.where(c("ministry") == view.pin_ministry))
    elif focus_p:
        base, offset = inflow(edges.where(c("source") == pin)), 0
    else:
        base = everyone
    last = offset + view.top_recipient
    r = (ranked(base, F.desc("amount"), c("rid")).withColumns({
        "window": ((c("rank") > offset) & (c("rank") <= last)) | ((c("rank") > last) & (c("n") == last + 1)),
        "tail": (c("rank") > last) & (c("n") > last + 1), "before": c("rank") <= offset}))

    e = held(edges.join(r.select(c("rid").alias("target"), "window", "tail", "before"), "target", "left").fillna(False, ["window", "tail", "before"]))
    part = lambda test: F.coalesce(F.sum(F.when(test, c("value"))), F.lit(0))
    flows = e.groupBy(c("source").alias("id")).agg(part(c("window")).alias("to_window"), part(c("tail")).alias("to_tail"), part(c("before")).alias("to_before"))
    p = p.join(flows, "id", "left").fillna(0, ["to_window", "to_tail", "to_before"])
    narrow = focus_r or not view.show_agg_recipient
    visible = c("to_window") if narrow else c("spent") - c("to_before")
    share = F.when(c("spent") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), visible.cast("double") / F.nullif("spent", F.lit(0))))).otherwise(1.0)
    p = p.withColumns({"visible": visible, "adjusted": c("budget") * share if view.scale_budget else c("budget").cast("double")})
    shown = c("to_window") + (c("to_tail") if view.show_agg_recipient else 0)
    hidden = (c("spent") > 0) & ~c("pinned") & ~c("above") & ~c("in_tail") & (shown == 0)
    p = p.withColumns({"shown": shown, "hidden": hidden})

    if by_project:
        chosen = c("in_window")
        other = c("in_tail") & ~c("hidden")
        if not focus_m:
            other = other | (~c("top") & ~c("in_window") & ~c("hidden") & ~c("zero"))
    elif focus_r:
        to_pin = e.where(c("target") == view.pin_recipient).groupBy(c("source").alias("id")).agg(F.sum("value").alias("to_pin"))
        q = ranked(p.select("id", "adjusted").join(to_pin, "id"), F.desc("to_pin"), F.desc("adjusted"), c("id"))
        p = p.join(q.select("id", c("rank").alias("q")), "id", "left")
        chosen, other = F.coalesce(c("q") <= view.top_project, no), F.coalesce(c("q") > view.top_project, no)
    else:
        ranks = ranked(p.where(c("top") & ~c("zero") & (c("pinned") | (yes if include_zero else c("shown") > 0))).select("id", "shown", "adjusted"),
                       F.desc("shown"), F.desc("adjusted"), c("id"))
        p = p.join(ranks.select("id", c("rank").alias("q")), "id", "left")
        chosen = F.coalesce(c("q") <= view.top_project, no) | (c("pinned") & ~c("zero"))
        if focus_p:
            chosen, other = c("pinned") & ~c("zero"), no
        else:
            other = ~chosen & ~c("hidden") & ~c("zero") & (c("top") if focus_m else yes)
    p = p.withColumns({"chosen": chosen, "other": other})
    p = held(p)
    p = p.crossJoin(F.broadcast(p.agg((F.count_if("other") == 1).alias("single")))).withColumn("lone", c("other") & c("single")).drop("single")  # one row
    p = held(p.withColumns({"chosen": c("chosen") | c("lone"), "other": c("other") & ~c("lone")}))

    # ---- what the classes add up to
    count = (~c("hidden") & ~c("zero") & ~c("above"))
    if focus_p:
        count = count & c("pinned")
    if focus_r:
        count = count & (c("chosen") | c("other"))
    if focus_m:
        count = count & (c("ministry") == view.pin_ministry)
    if not view.show_agg_project:
        count = count & ~c("other")
    by_ministry = p.where(count).groupBy("ministry").agg(
        F.sum(F.when(c("has_budget"), c("adjusted"))).alias("value"), F.sum(F.when(c("has_budget"), c("budget"))).alias("raw_value"),
        F.sum(F.greatest("visible", F.lit(0))).alias("spending"))
    m = held(ministries.join(by_ministry.withColumnRenamed("ministry", "name").withColumnRenamed("value", "own"), "name", "left").withColumns(
        {"own": F.coalesce("own", F.lit(0.0)), "raw_value": F.coalesce("raw_value", F.lit(0)), "spending": F.coalesce("spending", F.lit(0)),
         "show": yes if focus_r else c("top")}))
    others = p.where("other").agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum(F.when(c("has_budget"), c("adjusted"))), F.lit(0.0)).alias("budget"),
        F.coalesce(F.sum(F.when(c("has_budget"), c("budget"))), F.lit(0)).alias("raw_budget"), F.coalesce(F.sum("visible"), F.lit(0)).alias("spending"),
        F.coalesce(F.sum("spent"), F.lit(0)).alias("raw_spending"), F.coalesce(F.sum("to_window"), F.lit(0)).alias("window"))
    others = others.withColumn("spending", c("window") if narrow else c("spending"))
    e = held(e.drop("in_window", "above", "ministry").join(p.select(c("id").alias("source"), "above", "chosen", "other", "hidden", "pinned"), "source"))
    unpaid = e.where(c("other") & c("window") & (c("target") == NO_SPENDING)).agg((F.count(F.lit(1)) > 0).alias("unpaid"))
    others = others.crossJoin(unpaid).where((c("spending") > 0) | (c("budget") > 0) | c("unpaid")) if view.show_agg_project else others.limit(0)
    others = held(others)
    row = lambda df, i, t, v, raw=F.lit(None), k=F.lit(None): df.select(
        i.alias("id"), F.lit(t).alias("type"), v.cast("double").alias("value"), raw.cast("double").alias("raw_value"), k.cast("long").alias("members"))
    shown_p = p.where("chosen and not hidden")
    inflows = c("amount") if focus_p or focus_m else None
    values = e.where(c("window") & (c("chosen") if not view.show_agg_project else ~c("above") if by_project else yes)).groupBy(c("target").alias("rid")).agg(
        F.sum("value").alias("v"))
    only_other = e.where(c("other") & ~c("window") & ~c("tail")) if by_project else e.limit(0)
    tails = (r.where("tail").agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("amount"), F.lit(0)).alias("v"))
             .crossJoin(e.where("hidden and tail").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("gone")))
             .crossJoin(only_other.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("more"), F.countDistinct("target").alias("k2")))
             .where("k + k2 > 0"))
    rest = m.where("not show").agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("own"), F.lit(0.0)).alias("own"),
                                   F.coalesce(F.sum("raw_value"), F.lit(0)).alias("raw_value"), F.coalesce(F.sum("spending"), F.lit(0)).alias("spending")
                                   ).where("own > 0 or spending > 0")
    seen = m.where("show and (own > 0 or spending > 0)")
    b_id = F.concat(F.lit("project-budget-"), c("pid"))
    out_nodes = [
        row(by_ministry.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("v"), F.sum("raw_value").alias("raw")), F.lit("total"), "total", c("v"), c("raw")),
        row(seen, c("id"), "ministry", c("own"), c("raw_value")), row(rest, F.lit(AGG["ministry"]), "ministry", c("own"), c("raw_value"), c("members")),
        row(shown_p.where("has_budget"), b_id, "project-budget", c("adjusted"), c("budget")),
        row(shown_p, c("id"), "project-spending", c("visible"), c("spent")),
        row(others, F.lit(AGG["project-budget"]), "project-budget", c("budget"), c("raw_budget"), c("members")),
        row(others, F.lit(AGG["project-spending"]), "project-spending", c("spending"), c("raw_spending"), c("members")),
        row(r.where("window").join(values, "rid", "left"), c("rid"), "recipient", inflows if inflows is not None else F.coalesce("v", F.lit(0))),
    ]
    if view.show_agg_recipient:
        out_nodes.append(row(tails, F.lit(AGG["recipient"]), "recipient", c("v") - c("gone") + c("more"), k=c("k") + c("k2")))

    edge = lambda df, a, b, v: df.select(a.alias("source"), b.alias("target"), v.cast("double").alias("value"))
    at = F.concat(F.lit("ministry-"), c("ministry"))
    home = at if focus_r else F.when(c("top"), at).otherwise(AGG["ministry"])
    grouped = p.where("other").withColumn("home", F.when(c("top"), at).otherwise(AGG["ministry"])).groupBy("home").agg(
        F.coalesce(F.sum(F.when(c("has_budget"), c("adjusted"))), F.lit(0.0)).alias("v"))
    live = others.select(F.lit(True).alias("__live"))
    bucket_s = F.when(c("chosen"), c("source")).otherwise(AGG["project-spending"])
    bucket_t = F.when(c("window"), c("target")).otherwise(AGG["recipient"])
    seen_e = e.where((c("chosen") & (c("window") & ~c("hidden") | c("tail"))) | (c("other") & (c("window") | c("tail") | (yes if by_project else no))))
    if not view.show_agg_recipient:
        seen_e = seen_e.where("window")
    if not view.show_agg_project:
        seen_e = seen_e.where("chosen")
    sums = (seen_e.groupBy(bucket_s.alias("source"), bucket_t.alias("target"))
            .agg(F.sum("value").alias("value"), F.bool_or((c("target") == NO_SPENDING) & (c("window") | c("tail"))).alias("zero")))
    out_edges = [
        edge(seen, F.lit("total"), c("id"), c("own")), edge(rest, F.lit("total"), F.lit(AGG["ministry"]), c("own")),
        edge(shown_p, home, b_id, c("adjusted")), edge(grouped.crossJoin(live), c("home"), F.lit(AGG["project-budget"]), c("v")),
        edge(shown_p, b_id, c("id"), c("adjusted")),
        edge(others.where("spending > 0"), F.lit(AGG["project-budget"]), F.lit(AGG["project-spending"]), c("budget")),
        edge(sums.where("value > 0 or zero"), c("source"), c("target"), c("value")),
    ]
    every = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(every(frames[1:]))
    return Windowed(every(out_nodes), every(out_edges), p, r)


def display_order(w: Windowed, view: View) -> DataFrame:
    """id, place: the order in which the view's projects stand. In a window of projects by budget they go by what their budget is after scaling, else by what they
    pay to the recipients shown; in focus on a recipient by what they pay to it. The window is over the shown projects, top_project + 1 at most."""
    c = F.col
    focus_r = view.focus and view.pin_recipient is not None
    focus_p = view.focus and view.pin_project is not None and view.pin_ministry is None
    by_budget = view.sort_by == "budget" and view.offset_target == "project" and not focus_r and not focus_p
    order = [c("q").asc_nulls_last()] if focus_r else [F.desc("adjusted")] * by_budget + [F.desc("shown"), F.desc("adjusted")]
    return w.projects.where("chosen and not hidden").select("id", F.row_number().over(Window.orderBy(*order, c("id"))).alias("place"))


def members(w: Windowed) -> DataFrame:
    """Who is in the aggregate nodes, largest first: node, id, value."""
    p = w.projects.where("other")
    return (p.select(F.lit(AGG["project-budget"]).alias("node"), F.concat(F.lit("project-budget-"), "pid").alias("id"), F.col("budget").alias("value"))
            .unionByName(p.select(F.lit(AGG["project-spending"]).alias("node"), "id", F.col("spent").alias("value")))
            .unionByName(w.recipients.where("tail").select(F.lit(AGG["recipient"]).alias("node"), F.col("rid").alias("id"), F.col("amount").alias("value"))))


def totals(w: Windowed) -> DataFrame:
    """One row: projects that the view could show (in top ministries, or in the one in focus) and recipients that its window moves over."""
    return w.projects.agg(F.count_if(F.col("top") & ~F.col("zero")).alias("projects")).crossJoin(w.recipients.agg(F.count(F.lit(1)).alias("recipients")))  # one row each


def clamped(graph: Graph, view: View) -> View:
    """The view with its recipient offset so far back that the last recipients fill the window."""
    if not view.recipient_offset:
        return view
    last = max(0, graph.nodes.where("type = 'recipient'").count() - view.top_recipient)
    return replace(view, recipient_offset=min(view.recipient_offset, last))
