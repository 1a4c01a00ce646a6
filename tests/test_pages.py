"""Page predicates, searches, sorts, legends and decisions on small tables: nulls, ties, empty tables, texts."""

from tallyspark.operators import decision, pages


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_predicates(spark):
    t = spark.createDataFrame([(1, "道路（改良）", 5, True, None), (2, "Road", None, None, True), (3, None, 9, False, False)], "id int, name string, score int, a boolean, b boolean")
    assert ids(pages.within(t, {"score": (None, None)})) == [1, 2, 3]
    assert ids(pages.within(t, {"score": (0, None)})) == [1, 3] and ids(pages.within(t, {"score": (None, 5)})) == [1]
    assert ids(pages.containing(t, " (改良) ", ["name"])) == [1] and ids(pages.containing(t, "ROAD", ["name"])) == [2] and ids(pages.containing(t, " ", ["name"])) == [1, 2, 3]
    assert ids(pages.containing(t, "%", ["name"])) == []
    assert ids(pages.any_flag(t, ["a", "b"])) == [1, 2] and ids(pages.any_flag(t, [])) == [1, 2, 3]
    assert ids(pages.equal_to(t, {"id": [3, 1], "name": []})) == [1, 3]


def test_nested_search(spark):
    p = spark.createDataFrame([(1, "a", "m"), (2, "b", "m"), (31, "c", "n")], "pid int, name string, ministry string")
    b = spark.createDataFrame([(2, "Works"), (9, "works")], "pid int, block string")
    r = spark.createDataFrame([(1, "works ltd"), (1, "works two"), (2, None)], "pid int, recipient string")
    assert sorted(ids(pages.nested_search(p, b, r, "WORKS"), "pid")) == [1, 2]
    assert ids(pages.nested_search(p, b, r, "31"), "pid") == [31] and len(ids(pages.nested_search(p, b, r, ""), "pid")) == 3


def test_facets_follow_the_choices_before_them(spark):
    t = spark.createDataFrame([("x", "1", "p"), ("x", "2", "q"), ("y", "1", "q"), (None, "1", "q")], "a string, b string, c string")
    got = {(r.facet, r.value): r.n for r in pages.facets(t, {"a": "x", "b": "2", "c": None}).collect()}
    assert got == {("a", "x"): 2, ("a", "y"): 1, ("b", "1"): 1, ("b", "2"): 1, ("c", "q"): 1}
    assert pages.facets(t.limit(0), {"a": None}).count() == 0


def test_node_search(spark):
    nodes = spark.createDataFrame([
        ("project-budget-7", "Dam", "project-budget", 50, 7, "m"), ("project-spending-7", "Dam", "project-spending", 20, 7, "m"), ("r-1", "Dam builders", "recipient", 30, None, None),
        ("r-2", "Dam others", "recipient", 40, None, None), ("ministry-m", "m", "ministry", 60, None, "m")], "id string, name string, type string, value long, project_id long, ministry string")
    edges = spark.createDataFrame([("project-spending-7", "r-1", 20)], "source string, target string, value long")
    find = lambda *a, **k: ids(pages.node_search(nodes, edges, *a, **k))
    assert find("dam") == ["project-budget-7", "r-2", "r-1"] and find("dam", page=1, size=2) == ["r-1"]
    assert find("dam", ministries=("m",)) == ["project-budget-7", "r-1"] and find("dam", ministries=("z",)) == []
    assert find("7") == find("007") == ["project-budget-7"] and find("8") == [] and find("d") == []
    assert find("^dam (b|o)", regex=True) == ["r-2", "r-1"] and find("(", regex=True) == [] and find("x" * 101, regex=True) == []


def test_sorts(spark):
    t = lambda *v: spark.createDataFrame(list(enumerate(v)), "id int, k string")
    assert ids(pages.sorted_page(t("10", "9", None, "010"), "k", "id")) == [1, 0, 3, 2]
    assert ids(pages.sorted_page(t("10", "9", None, "x"), "k", "id", descending=True)) == [3, 1, 0, 2]
    assert ids(pages.sorted_page(t("さ", "ア", "い"), "k", "id")) == [1, 2, 0]
    assert pages.sorted_page(t().limit(0), "k", "id").count() == 0
    n = spark.createDataFrame([("a", "その他", 9, False), ("b", "x", 1, None), ("c", "y", 5, True), ("d", "z", 3, False)], "id string, name string, value int, aggregated boolean")
    assert ids(pages.in_display_order(n)) == ["d", "b", "a", "c"]
    assert spark.range(1).select(pages.display_rank(pages.F.lit("縮小"), pages.RECOMMENDATIONS), pages.display_rank(pages.F.lit("?"), pages.ACTIONS)).first()[:] == (4, None)
    assert {r.id: r.place for r in pages.places_of(n, "id", "value", ["d", "b", "nobody"]).collect()} == {"d": 2, "b": 3}


def test_scales_and_legend(spark):
    t = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9), ("c", 5), ("d", None)], "k string, v int")
    got = [tuple(r) for r in pages.legend(t, "k", "v", 1, 3).collect()]
    assert got == [(1, "a", 2, 2, 1), (2, "b", 1, 9, 1), (4, "__other__", 2, 5, 2)]
    assert pages.ticks(t, "v").first()[:] == (5.0, 9.0, 9.0) and pages.ticks(t.limit(0), "v").first()[:] == (None, None, None)
    s = pages.percentile_summary(t, "v", 9).first()
    assert (s.n, s.distinct, s.p50, s.iqr, s.ceiling_share) == (4, 3, 1.0, 4.0, 0.25)
    n = spark.createDataFrame([("project-budget", 250_100_000_000), ("recipient", 5)], "type string, value long")
    assert pages.slider_limits(n).first()[:] == (3000, 1000) and pages.slider_limits(n.limit(0)).first()[:] == (1000, 1000)


def test_decisions(spark):
    columns = "id int, readiness int, confidence double, outcome int, causal int, cost int, durability int, alternative int, duplication int, obsolescence int, legal boolean, v int, v_applies boolean"
    rows = [(1, 3, 0.7, 4, 4, 4, 4, 0, 0, 0, False, 4, True), (2, 2, 0.9, 4, 4, 4, 4, 0, 0, 0, False, 4, True), (3, 4, 1.0, 0, 0, 0, 0, 4, 4, 4, False, 0, True),
            (4, 4, 1.0, 0, 0, 0, 0, 4, 4, 4, True, 0, True), (5, 4, 1.0, 4, None, 4, 4, 0, 0, 0, False, 4, True), (6, 4, 1.0, 4, 4, 4, 4, 0, 0, 0, False, None, False)]
    got = {r.id: (r.effect_score, r.value_score, r.priority_score, r.recommendation, r.human_decision) for r in decision.decisions(spark.createDataFrame(rows, columns), ["v"]).collect()}
    assert got == {1: (100, 100, 0, "CONTINUE", False), 2: (100, 100, None, "EVIDENCE_REQUIRED", True), 3: (0, 0, 100, "ABOLITION_CANDIDATE", True),
                   4: (0, 0, 100, "REFORM_LEGAL_SCHEME", True), 5: (None, 100, None, "EVIDENCE_REQUIRED", True), 6: (100, None, None, "EVIDENCE_REQUIRED", True)}
