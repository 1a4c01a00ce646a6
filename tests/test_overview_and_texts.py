"""Budget overview, text normalisation, effect scores, bounded answers, counted rows and the engine's routes, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.engine import Engine, QueryError
from tallyspark.functions.normalise import normalised
from tallyspark.operators import flow, overview, review, screening, search, shaping, stats
from tallyspark.plans import text_queries

LINE = "year int, kind string, side string, account string, sub_account string, category string, item string, purpose string, amount long"


def book(spark):
    rows = [("general", "revenue", None, None, "租税", "所得税", None, 700), ("general", "revenue", None, None, "租税", "印紙", None, 3), ("general", "revenue", None, None, "諸収入", "外為特別会計受入金", None, 40),
            ("general", "revenue", None, None, "諸収入", "雑入", None, 10), ("general", "revenue", None, None, "公債金", "公債", None, 300), ("general", "revenue", None, None, None, None, None, 7),
            ("general", "expenditure", None, None, None, "年金特別会計へ繰入", "6", 200), ("general", "expenditure", None, None, None, "給与", "1", 800),
            ("special", "revenue", "年金", "国民", "保険収入", "一般会計より受入", None, 150), ("special", "revenue", "年金", "厚生", "他会計より受入", "x", None, 80),
            ("special", "revenue", "年金", "厚生", "他勘定より受入", "x", None, 20), ("special", "revenue", "年金", "国民", "保険収入", "保険料", None, 500),
            ("special", "expenditure", "年金", "国民", None, "国債整理基金", "6", 90), ("special", "expenditure", "年金", "厚生", None, "給付", None, 600),
            ("agency", "revenue", "公庫", None, "事業益金", "x", None, 5), ("agency", "expenditure", "公庫", None, None, "x", "9", 9)]
    return spark.createDataFrame([(2025, *r) for r in rows] + [(2024, "general", "revenue", None, None, "租税", "酒税", None, 5), (2024, "general", "expenditure", None, None, None, "a", None, 9)], LINE)


def test_overview(spark):
    rows = book(spark)
    nodes, links = overview.overview(rows)
    got = {r.id: r.value for r in nodes.where("year = 2025").collect()}
    assert got == {"src-tax-所得税": 700, "src-tax-other": 3, "src-general-公債金": 300, "src-general-other": 10, "src-from-special": 40, "src-special-保険収入": 500, "src-agency": 5,
                   "src-agency-shortfall": 4, "account-general": 1060, "account-special": 750, "account-agency": 9, "src-special-reentry": 30, "src-subaccount-reentry": 20, "net-general": 800,
                   "surplus-general": 60, "transfer-special": 90, "net-special": 600, "surplus-special": 60, "net-agency": 9}
    assert {r.id for r in nodes.where("year = 2025 and is_deduction").collect()} == {"src-special-reentry", "src-subaccount-reentry", "transfer-special"}
    flows = {(r.year, r.id): (r.inflow, r.outflow) for r in overview.balance(links).collect()}
    # 7 of the revenue has no name, and so no source
    assert flows[2025, "account-general"] == (1053, 1060) and flows[2025, "account-special"] == (750, 750) and flows[2025, "account-agency"] == (9, 9) and flows[2024, "account-general"] == (5, 9)
    assert {r.id: r.value for r in nodes.where("year = 2024").collect()} == {"src-tax-酒税": 5, "account-general": 5, "account-special": 0, "net-general": 9, "net-special": 0}
    t = overview.totals(overview.flagged(rows)).where("year = 2025").first()
    assert (t.gross, t.net, t.special_own) == (1699, 1699 - 230 - 20, 500)
    a = overview.special_accounts(rows.where("year = 2025")).first()
    assert (a.account, a.sub_accounts, a.revenue, a.transfer_in, a.transfer_out) == ("年金", 2, 750, 230, 90)
    empty = overview.overview(rows.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_normalised(spark):
    cases = {"①②⑫㉑㊿": "12122150", "令和元年と平成 31 年度、昭和64年": "2019年と2019年度、1989年", "（株）［甲］": "(株)[甲]", "ア‐イ—ウ": "アーイーウ", "ｶﾞｽ ﾀﾝｸ": "ガスタンク", "サ ー ー  バ": "サーバ",
             "a  b　c": "a b c", "明治大学": "明治大学", "": "", None: None, "令和 99 年": "2117年", "A-1": "A-1"}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r.n for r in rows.select("i", normalised(F.col("t")).alias("n")).orderBy("i").collect()] == list(cases.values())


def test_texts_are_spread(spark, tmp_path):
    # a small file is read by one task, but its rows take long
    parts = spark.range(120_001).selectExpr("id AS p_partkey", "'ring' AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type", "CAST(id % 50 AS INT) AS p_size").coalesce(1)
    parts.write.parquet(f"{tmp_path}/part.parquet")
    out = text_queries.normalised_texts(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 3 and out.count() == 120_001
    circled = [chr(c) for c in (0x24EA, *range(0x2460, 0x2474), *range(0x3251, 0x3260), *range(0x32B1, 0x32C0))]
    rows = spark.createDataFrame(list(enumerate(circled)), "i int, t string")
    assert [r.n for r in rows.select("i", normalised(F.col("t")).alias("n")).orderBy("i").collect()] == [str(i) for i in range(51)]


def test_effects(spark):
    rows = [("国民生活の安全を守る", None, "短い"), ("国民の生活の安全と健康を守り、地域の防災を進める。" * 3, "年間１２ 件", "概要"), (None, None, None), ("あ" * 20, "", "")]
    got = [r.effective for r in review.effects(spark.createDataFrame(rows, "purpose string, issues string, overview string")).collect()]
    assert got == [0, 10, 0, 3]


def test_shaping(spark):
    rows = spark.createDataFrame([(1, ["x" * 50] * 9, ["y" * 10] * 9), (2, None, []), (3, ["z" * 5000], ["q"])], "id int, a array<string>, b array<string>")
    got = {r.id: r for r in shaping.clamped_payload(rows, ["id", "a", "b"], ["a", "b"], 400).collect()}
    assert len(got[1].a) == 3 and len(got[1].b) == 9 and len(json.dumps({"id": 1, "a": got[1].a, "b": got[1].b}, separators=(",", ":"))) <= 400
    assert got[2].a is None and got[2].b == [] and len(got[3].a) == 1
    t = spark.createDataFrame([(" x" * 400,), ("　 ",), (None,), ("ok ",)], "t string").select(shaping.clamped_text(F.col("t"), 10).alias("t"))
    assert [r.t for r in t.collect()] == ["x x x x x " + "…", None, None, "ok"]
    light = shaping.score_projection(spark.createDataFrame([(1, "n", 5.0, "big")], "pid long, name string, total_score double, other string"))
    assert light.columns == list(shaping.SCORE_FIELDS) and light.first().total_score == 5.0


def test_counted_rows(spark):
    rows = spark.createDataFrame([(1, "a", 5, "A"), (1, " ", 5, "A"), (1, None, 5, "A"), (1, "b", 0, "A"), (1, "b", None, "A"), (1, "b", 7, " "), (1, "c", 9, "B"), (1, "c", 9, None), (9, "z", 1, "A")],
                                 "pid long, recipient string, amount long, block string")
    links = spark.createDataFrame([(1, "B", False), (1, "A", False), (1, "A", True)], "pid long, block string, flag boolean")
    table, counts = flow.counted_rows(rows, spark.createDataFrame([(1,), (1,), (2,)], "pid long"), links)
    assert counts == {"no name": (2, 10), "no amount": (2, 0), "no block": (2, 16), "indirect": (1, 9), "direct": (1, 5)}
    assert table.count() == 8 and table.where("kind = 'direct'").first().recipient == "a"
    numbers = spark.createDataFrame([("r", 1, "1" * 13, 5), ("r", 1, "2" * 13, 9), ("r", 1, "bad", 50), ("r", 2, None, 1)], "recipient string, pid long, number string, amount long")
    assert {r.pid: (r.amount, r.numbers) for r in flow.recipient_projects(numbers).collect()} == {1: (64, ["2" * 13, "1" * 13]), 2: (1, [])}


def test_levels(spark):
    r = stats.levels(spark.createDataFrame([(5.0,), (5.2,), (5.0,), (6.0,), (10.0,), (None,)], "v double"), "v", 0, 10).first()
    assert (r.n, r["distinct"], r.used, r.band_share, r.band_from, r.cover_width, r.high_share) == (5, 4, 3, 0.8, 4, 2, 0.2) and abs(r.tie_rate - 0.1) < 1e-12
    assert stats.levels(spark.createDataFrame([], "v double"), "v", 0, 10).count() == 0


def test_quantiles(spark):
    t = spark.createDataFrame([(i, float(i % 7), None) for i in range(20)], "id int, a double, b double")
    xs = sorted(i % 7 for i in range(20))
    r = screening.quantiles(t, {"p": ("a", 0.25), "q": ("a", 0.9), "none": ("b", 0.5)}).first()
    assert (r.p, r.q, r.none) == (xs[int(19 * 0.25)], xs[int(19 * 0.9)], float("inf"))
    ranks = {x.a: x.rank for x in screening.percentile_rank(t, "a", "rank").collect()}
    assert ranks[0.0] == 0 and abs(ranks[6.0] - sum(x < 6 for x in xs) / 19 * 100) < 1e-9


def test_routes(spark):
    items = spark.createDataFrame([("initial", f"項目{i}", "ＡＩ活用" if i % 2 else "その他", i) for i in range(150)] + [("revised", "x", "AI", 1)], "budget_type string, name string, description string, amount long")
    runs = spark.createDataFrame([(1, 2023, 100, 50), (1, 2024, 0, 0), (1, 2022, 10, 5), (1, 2022, 10, 15), (2, 2023, 1, 1)], "pid long, year int, budget long, executed long")
    judged = spark.createDataFrame([(1, "A", "x", 5), (1, "B", "y", 9), (2, "A", "z", 1)], "pid long, block string, name string, amount long")
    scores = spark.createDataFrame([(1, 50.0, "長" * 700), (2, 60.0, None)], "pid long, total_score double, effective_reason string")
    e = Engine({}, {"budget_items": items, "executions": runs, "score_rows": judged, "budget_lines": book(spark), "scores": scores})
    assert e.items("initial").count() == 100 and [r.amount for r in e.items("initial", "ai", 3, 1).collect()] == [147, 145, 143]
    assert [tuple(r) for r in e.execution_history(1).collect()] == [(2022, 20, 20, 1.0), (2023, 100, 50, 0.5), (2024, 0, 0, None)]
    assert [r.year for r in e.execution_history(1, 2).collect()] == [2023, 2024]
    assert [r.name for r in e.score_rows(1).collect()] == ["y", "x"]
    assert e.overview(2024)[1].count() == 2 and e.overview_accounts(2025).count() == 1
    assert [len(r.effective_reason or "") for r in e.score_projection([1, 2]).collect()] == [601, 0]
    with pytest.raises(QueryError):
        e.highlights(metric="nothing")
    info = search.page_info(items, 100, 100).first()
    assert (info.total, info.next_offset) == (151, None) and search.page_info(items, 500, 0).first().next_offset == 100


def test_map_route(spark):
    s = spark.createDataFrame([(i, f"n{i}", "m", 10**9, 5 * 10**8, "c", 50.0, 50.0, 50.0, float(i), 5.0, 5.0, 5.0, 0.5, 0.1, 1, 0) for i in range(1, 9)],
                              "pid long, name string, ministry string, budget long, executed long, category string, identify double, purpose double, budget_axis double, design double, evidence double, "
                              "proportionality double, necessity double, prior_rate double, opaque_ratio double, depth int, orphan_blocks int")
    points = spark.createDataFrame([(i, 0.1, 0.2, 1) for i in range(5, 12)], "pid long, x double, y double, cluster int")
    got = Engine({}, {"scores": s, "map_points": points}).project_map()
    assert {r.pid for r in got.collect()} == {5, 6, 7, 8} and {"recommendation", "overall", "name", "x"} <= set(got.columns)
