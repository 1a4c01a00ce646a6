from pyspark.sql import functions as F

from tallyspark.operators import blocks, filters, flow, screening, summary, windows
from tallyspark.plans import adapter, catalog
from tallyspark.plans.query import Filter, Name, Range, View

SF = "/root/testdata/sf0.001"
catalog.load()

NODE = "id string, name string, type string, value long, project_id long, ministry string, aggregated boolean, account_category string, subcontract_depth int, subcontract_recipients array<string>"


def graph(spark, projects, recipients, edges):
    """projects: pid -> (ministry, budget, spending, depth, names)."""
    rows = []
    for m in sorted({p[0] for p in projects.values()}):
        rows.append((f"ministry-{m}", m, "ministry", 1, None, m, False, None, None, None))
    for pid, (m, b, s, depth, names) in projects.items():
        rows.append((f"project-budget-{pid}", f"事業{pid}", "project-budget", b, pid, m, False, None, depth, names))
        rows.append((f"project-spending-{pid}", f"事業{pid}", "project-spending", s, pid, m, False, None, None, None))
    rows += [(i, n, "recipient", v, None, None, agg, None, None, None) for i, n, v, agg in recipients]
    links = [(f"ministry-{m}", f"project-budget-{pid}", b) for pid, (m, b, *_) in projects.items() if b]
    links += [(f"project-spending-{p}", r, v) for p, r, v in edges]
    return flow.Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(links, "source string, target string, value long"))


def small(spark):
    return graph(spark, {1: ("A省", 1000, 900, None, None), 2: ("A省", 500, 400, None, None)},
                 [("r-1", "受領者A", 600, False), ("r-2", "その他", 300, False), ("r-agg", "その他の支出先", 400, True)],
                 [(1, "r-1", 600), (1, "r-2", 300), (2, "r-agg", 400)])


def test_summary(spark):
    t = summary.totals(small(spark)).first()
    assert (t.project_count, t.budget_total, t.spending_total, t.recipient_count, t.top_share1, t.top_share3) == (2, 1500, 1300, 3, 0.6667, 1)
    assert t.ministries == ["A省"]
    out = spark.createDataFrame([("project-budget-2",), ("project-spending-2",), ("r-agg",)], "id string")
    t = summary.totals(filters.applied(small(spark), out)).first()
    assert (t.project_count, t.budget_total) == (1, 1000)


def test_compare(spark):
    make = lambda ps: graph(spark, {k: ("A省", b, s, None, None) for k, (b, s) in ps.items()}, [("r-1", "x", 1, False)], [(k, "r-1", s) for k, (b, s) in ps.items()])
    rows = {r.pid: r for r in summary.compare_projects(make({1: (1000, 900), 2: (200, 150)}), make({1: (0, 1200), 3: (300, 300)})).collect()}
    assert (rows[1].status, rows[1].spending_diff, rows[1].budget_diff_rate) == ("increased", 300, -1)
    assert (rows[2].status, rows[3].status) == ("removed", "added")


def ids(df):
    return set() if df is None else {r.id for r in df.collect()}


def test_filters(spark):
    g = graph(spark, {1: ("A省", 10, 10, 3, ["孫請け"]), 2: ("B省", 10, 10, None, None)}, [("r-1", "直接", 10, False), ("r-2", "他", 10, False)], [(1, "r-1", 10), (2, "r-2", 10)])
    assert filters.excluded(g, Filter()) is None
    two = {"project-budget-2", "project-spending-2", "ministry-B省"}
    assert ids(filters.excluded(g, Filter(has_redelegation=True))) == two
    assert ids(filters.excluded(g, Filter(min_depth=4))) >= {"project-budget-1", "project-budget-2"}
    assert ids(filters.excluded(g, Filter(recipient_name=Name("孫請け", include_subcontract=True)))) == two
    assert ids(filters.excluded(g, Filter(recipient_name=Name("直接")))) == two | {"r-2"}
    assert ids(filters.excluded(g, Filter(), exclude_project=spark.createDataFrame([(2,)], "pid long"))) == two
    kept = ids(filters.excluded(g, Filter(recipient_name=Name("直接")), ["project-spending-2"]))
    assert "project-budget-2" not in kept and "r-2" in kept
    assert ids(filters.excluded(g, Filter(budget=Range(11, None)))) >= {"project-budget-1", "ministry-A省", "ministry-B省"}


def test_windows_keep_totals(spark):
    g = graph(spark, {p: (f"M{p % 3}", 100 * p, 90 * p, None, None) for p in range(1, 9)}, [(f"r-{i}", f"n{i}", 1, False) for i in range(1, 6)],
              [(p, f"r-{1 + (p + k) % 5}", 30 * p) for p in range(1, 9) for k in range(3)])
    total = g.edges.where(F.col("target").startswith("r-")).agg(F.sum("value")).first()[0]
    for v in (View(top_ministry=2, top_project=3, top_recipient=2), View(top_ministry=1, top_project=2, top_recipient=2, offset_target="recipient"),
              View(top_project=2, focus=True, pin_recipient="r-1"), View(top_project=2, top_recipient=2, focus=True, pin_ministry="M1"),
              View(focus=True, pin_project="project-spending-4", top_recipient=1)):
        w = windows.windowed(g, v)
        known = {r.id for r in w.nodes.collect()}
        edges = w.edges.collect()
        assert all(e.source in known and e.target in known for e in edges), v
        if v == View(top_ministry=2, top_project=3, top_recipient=2):
            assert sum(e.value for e in edges if e.target.startswith("r-") or e.target == "__agg-recipient") == total
        assert w.projects.where("chosen and other").count() == 0


def test_depths_survive_cycles(spark):
    f = spark.createDataFrame([(1, None, "A"), (1, "A", "B"), (1, "B", "A"), (2, None, "X"), (2, "X", "Y")], "pid long, source string, target string")
    assert {(r.pid, r.block): r.depth for r in blocks.shortest_depths(f).collect()} == {(1, "A"): 1, (1, "B"): 2, (2, "X"): 1, (2, "Y"): 2}
    assert {r.pid: r.max_depth for r in blocks.longest_depth(f).collect()} == {1: 30, 2: 2}
    o = blocks.origins(spark.createDataFrame([(1, "S", "T"), (1, "A", "T"), (1, None, "A")], "pid long, source string, target string"),
                       spark.createDataFrame([(1, "A")], "pid long, block string"))
    assert [(r.block, r.strong) for r in o.collect()] == [("S", True)]


def test_years_are_held_against_each_other_as_written_tables(spark):
    # else one task sorts and sums all that both years are made of at once
    plan = catalog.QUERIES["compare_years"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "HashAggregate" not in plan


def test_lines_are_not_sorted(spark):
    plan = adapter.lines(spark, SF, 1997)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan


def test_levels_of_blocks_are_not_broadcast(spark, monkeypatch):
    # a frontier sent to all tasks goes through the driver, at every level
    plans, held = [], blocks.held
    monkeypatch.setattr(blocks, "held", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or held(df))
    rows = [(1, None, "A"), (1, "A", "B"), (1, "B", "C"), (1, "C", "B"), (2, None, "X"), (2, "X", "Y"), (3, "P", "Q")] + [(k, None, "A") for k in range(4, 12)]
    flows = spark.createDataFrame(rows, "pid long, source string, target string")
    depths = {r.pid: r.max_depth for r in blocks.longest_depth(flows).collect()}
    assert depths == {1: 30, 2: 2, 3: 1} | {k: 1 for k in range(4, 12)}
    assert {(r.pid, r.block): r.depth for r in blocks.shortest_depths(flows).collect() if r.pid < 4} == {(1, "A"): 1, (1, "B"): 2, (1, "C"): 3, (2, "X"): 1, (2, "Y"): 2}
    own = flows.withColumn("origin", F.when((F.col("source") == "P"), "separate-origin").when(F.col("pid") == 2, None).otherwise("subcontract"))
    assert {(r.pid, r.block): r.depth for r in blocks.shortest_depths(own).collect() if r.pid == 3} == {(3, "P"): 1, (3, "Q"): 2}
    assert plans and not any("Broadcast" in p for p in plans)


def test_highlights(spark):
    rows = spark.createDataFrame([(1, 10**9 - 1, 10, 5), (2, 10**9, 10, 9)], "pid long, spend_total long, total long, top_amount long")
    assert [r.pid for r in screening.concentration(rows).collect()] == [2]
    b = spark.createDataFrame([(1, 5), (2, 7)], "pid long, budget long")
    both = {"execBudgetGap": b, "otherRatio": b.where("pid = 2")}
    assert [(r.pid, r.signals) for r in screening.multi_signal(both, b).collect()] == [(2, ["otherRatio", "execBudgetGap"])]


def test_spending_is_read_once(spark, tmp_path):
    from tallyspark.operators.flow import build_graph

    at = f"file://{tmp_path}/spent"
    spark.createDataFrame([(1, "a", "1", 5), (2, "b", "2", 7)], "pid long, recipient string, number string, amount long").write.parquet(at)
    own = spark.createDataFrame([(1, "x", "m"), (2, "y", "m")], "pid long, name string, ministry string")
    budgets = spark.createDataFrame([(1, 9, "general"), (2, 9, "both")], "pid long, budget long, account_category string")
    g = build_graph(own, budgets, spark.read.parquet(at))
    assert not any(f.endswith(".parquet") and "/spent/" in f for x in (g.nodes, g.edges) for f in x.inputFiles())
    assert {(r.source, r.target, r.value) for r in g.edges.where("target like 'r-%'").collect()} == {("project-spending-1", "r-2", 5), ("project-spending-2", "r-1", 7)}
