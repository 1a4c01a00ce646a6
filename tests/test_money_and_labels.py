"""Amounts as they are shown, and labels of queries."""

from pyspark.sql import functions as F

from tallyspark.functions import money
from tallyspark.plans.label import exploration_label
from tallyspark.plans.query import Filter, Name, Query, Range


def test_money(spark):
    amounts = [0, 9_999, 10_000, 123_456_789, 12_345_678_900, 1_234_567_890_000, -1_234_567_890_000, -50_000, None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(amounts)], "i int, a long").orderBy("i")
    show = lambda c: [r[0] for r in rows.select(c.alias("t")).collect()]
    a = F.col("a")
    assert show(money.yen_short(a)) == ["0円", "9,999円", "1万円", "1.2億円", "123.5億円", "1.23兆円", "-1.23兆円", "-5万円", None]
    assert show(money.yen_or_dash(a))[-1] == "—" and show(money.oku(a))[3:6] == ["1億円", "123億円", "1.2兆円"]
    assert show(money.budget_from_yen(a))[2:6] == ["1.00万円", "1.23億円", "123.46億円", "1.23兆円"]
    thousands = spark.createDataFrame([(1_234_567_890,), (123_456_789_0,), (123_456_789,), (12_345_678,), (1_234,), (9,), (None,)], "t long")
    got = [r[0] for r in thousands.select(money.budget(F.col("t"))).collect()]
    assert got == ["約1.23兆円", "約1.23兆円", "約1,235億円", "約123.5億円", "約123.4万円", "約9,000円", None]
    assert thousands.select(money.budget(F.col("t"), about=False)).first()[0] == "1.23兆円"
    assert [r[0] for r in spark.createDataFrame([(0.9996,), (None,)], "r double").select(money.rate(F.col("r"))).collect()] == ["100.0%", "—"]
    assert [money.yen(x) for x in (10**12, 123 * 10**8, 15 * 10**7, 12_345, 12.5, -(10**10))] == ["1.00兆円", "123億円", "1.50億円", "1万円", "13円", "-100億円"]


def test_labels():
    assert exploration_label(Query()) == "2024・フィルタなし"
    f = Filter(project_name=Name(" 半導体 "), recipient_name=Name("x", include_subcontract=True), ministries=("A省", "B省", "C省"), budget=Range(10**10, None), spending=Range(10**8, 2 * 10**12),
               accounts=("general", "none"), min_depth=3)
    assert exploration_label(Query("2025", f)) == '2025・A省/B省 他1・事業名"半導体"・支出先/再委託先"x"・予算100億円以上・受領額1.00億円〜2.00兆円・一般会計/区分なし・再委託階層3以上'
    assert exploration_label(Query(filter=Filter(spending=Range(None, 5000), has_redelegation=True))) == "2024・受領額5,000円以下・再委託あり"
