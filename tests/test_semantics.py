import pytest
from pyspark.sql import functions as F

from tallyspark.functions import semantics as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first().x


def test_rounding(spark):
    assert one(spark, S.half_up(F.lit(-2.5))) == -2 and one(spark, S.half_up(F.lit(0.285), 2)) == 0.28


def test_corporate_numbers(spark):
    rows = spark.createDataFrame([("7010001064648",), ("8010001064648",), ("9999999999999",), ("701",), (" 7010001064648 ",), ("",), (None,)], "n string")
    assert [r.v for r in rows.select(S.is_valid_corporate_number(F.col("n")).alias("v")).collect()] == [True, False, False, False, True, False, False]


@pytest.mark.parametrize(("name", "number", "key"), [("x", "7010001064648", "7010001064648"), ("㈱ＡＢＣ", "9999999999999", "name:株式会社abc"),
                                                      ("Ａ Ｂ（株）", "", "name:ab株式会社"), ("X", "8010001064648", "name:x")])
def test_recipient_keys(spark, name, number, key):
    assert one(spark, S.recipient_key(F.lit(name), F.lit(number))) == key


def test_amounts_and_labels(spark):
    assert one(spark, S.amount(F.lit("1,234"))) == 1234 and one(spark, S.amount(F.lit("-"))) == 0 and one(spark, S.amount_or_null(F.lit(""))) is None
    assert one(spark, S.scaled_amount(F.lit("△1,5"))) == -15000
    assert one(spark, S.era_label(F.lit(2019))) == "令和元年度" and one(spark, S.era_label(F.lit(2018))) == "平成30年度"
    assert one(spark, S.format_yen(F.lit(1_234_000_000_000))) == "1.23兆円" and one(spark, S.format_yen(F.lit(12_300_000_000))) == "123億円"
    assert one(spark, S.diff_rate(F.lit(0), F.lit(5))) is None and one(spark, S.diff_rate(F.lit(1000), F.lit(0))) == -1
    assert one(spark, S.weighted_available([(F.lit(None).cast("double"), 3), (F.lit(4.0), 1)])) == 4.0


def test_excerpt():
    text = "あ" * 100 + "ＡＢ Ｃ" + "い" * 100
    cut = S.excerpt_of(text, "abc")
    assert "ＡＢ Ｃ" in cut and cut.startswith("…") and cut.endswith("…")
    assert S.excerpt_of("short", "zz") == "short" and S.excerpt_of("x" * 200, "zz") == "x" * 120 + "…"


def test_rules_in_order(spark):
    rules = [("その他", "exact", 3), ("職員", "prefix", 2), ("個人", "contains", 1)]
    rows = spark.createDataFrame([("その他",), ("職員A",), ("職員",), ("A個人",), ("z",)], "n string")
    assert [r.x for r in rows.select(S.opaque_level(F.col("n"), rules).alias("x")).collect()] == [3, 2, 0, 1, 0]


def test_change_rate_and_terms(spark):
    rows = spark.createDataFrame([(None, 5), (0, 5), (4, 5), (4, None)], "p long, c long").select(S.change_rate(F.col("p"), F.col("c")).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in rows] == [None, (None, True), (0.25, False), (-1.0, False)]
    text = spark.createDataFrame([("霞ヶ関ヵ所 サービス 々々",)], "t string").select(S.terms(F.col("t")).alias("x")).first().x
    assert text == ["サービス"]
