"""The engine's API."""

import pytest

from tallyspark.engine import Engine, QueryError

from .test_flow import graph


def test_scores(spark):
    e = Engine({}, {"scores": spark.createDataFrame([(p, float(p)) for p in range(400)], "pid long, total_score double")})
    pids = [*[7] * 200, *range(399, 149, -1), 1000, 7, 999]
    found, missing = e.scores(pids)
    assert [r.pid for r in found.collect()] == [7, *range(399, 149, -1)] and found.columns == ["pid", "total_score"]
    assert [r.pid for r in missing.collect()] == [1000, 999]
    assert e.scores(list(range(300)))[0].count() == 300
    for bad in ([], list(range(301))):
        with pytest.raises(QueryError):
            e.scores(bad)
    every, none = e.scores()
    assert every.count() == 400 and none.count() == 0


def test_highlights_of_six_lists(spark):
    def year(spent):
        return graph(spark, {p: ("A省", 4 * 10**9, v, None, None) for p, v in spent.items()}, [("r-1", "その他", 1, False), ("r-2", "x", 1, False), ("r-3", "集約", 1, True)],
                     [(p, f"r-{1 + p % 2}", v) for p, v in spent.items()] + [(p, "r-3", 10**12) for p in spent])

    # 1 to 12 spend more and more of the increase; 13 is removed, 14 added; 15 has no change but is deep
    prior = {p: 10**9 for p in range(1, 14)} | {15: 3 * 10**9}
    now = {p: 10**9 + p for p in range(1, 13)} | {14: 10**9, 15: 3 * 10**9}
    rows = [(p, 4 * 10**9, v, v, 50.0 - p, 5 if p in (12, 15) else 0) for p, v in now.items()]
    scores = spark.createDataFrame(rows, "pid long, budget long, executed long, spend_total long, total_score double, depth int")
    lists = Engine({"2023": year(prior), "2024": year(now)}, {"scores": scores}).highlights()
    assert list(lists) == [*("spendingChange", "otherRatio", "concentration", "lowScoreHighBudget", "execBudgetGap", "subcontractDepth"), "multiSignal"]
    assert sorted((r.status, r.pid) for r in lists["spendingChange"].collect()) == sorted([*(("increased", p) for p in range(3, 13)), ("added", 14), ("removed", 13)])
    assert {r.pid for r in lists["otherRatio"].collect()} == {2, 4, 6, 8, 10, 12, 14}
    got = {r.pid: r.signals for r in lists["multiSignal"].collect()}
    assert {p for p, s in got.items() if "spendingChange" in s} >= {4, 12, 14} and 13 not in got
    assert got[12][0] == "spendingChange" and got[12][-1] == "subcontractDepth"
    alone = Engine({"2024": year(now)}, {"scores": scores}).highlights("2024")
    assert "spendingChange" not in alone and "otherRatio" in alone
