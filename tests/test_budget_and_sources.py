import zipfile

from pyspark.sql import functions as F

from tallyspark.operators import budget, recipients, search, stats
from tallyspark.sources import files, sinks


def test_hierarchy_conserves(spark):
    rows = [("A", f"o{i % 3}", None if i % 2 else f"s{i % 4}", f"x{i % 5}", f"i{i}", 10 + i) for i in range(40)]
    items = spark.createDataFrame(rows, "ministry string, organization string, sub_account string, section string, item string, amount long")
    nodes, links = budget.hierarchy(items, {"organization": 2, "section": 2, "item": 2}, 3)
    total = sum(r[-1] for r in rows)
    by = {r.id: r.amount for r in nodes.collect()}
    assert by["total"] == total
    assert all(e.source in by and e.target in by for e in links.collect())
    last = nodes.where("level = 5").agg(F.sum("amount")).first()[0]
    assert last == total


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿"a",b\n"x, ""y""", 1 \n,\nz,2\n', encoding="utf-8")
    assert [(r.a, r.b) for r in files.read_csv(spark, str(path)).collect()] == [('x, "y"', "1"), ("z", "2")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("r.csv", "主管,令和7年度予算額\nM,10\n")
        z.writestr("note.txt", "no")
    members = files.zip_members(spark, str(tmp_path / "b.zip"))
    row = files.member_rows(members).first()
    assert row.side == "revenue" and row.row["令和7年度予算額"] == "10" and files.amount_column(["主管", "令和7年度予算額"]) == "令和7年度予算額"
    sinks.write_csv(spark.createDataFrame([("a,b", 1)], "k string, v int"), str(tmp_path / "out"), bom=True)
    assert files.read_csv(spark, str(tmp_path / "out")).first().k == "a,b"


def test_xml_cells(spark):
    t = spark.createDataFrame([("d", '<clm id="p1-2.1-3">x</clm><clm id="p1-3.1-3.2"> <b>y</b></clm>')], "doc string, text string")
    assert [(r.page, r.row, r.col, r["sub"], r.value) for r in files.cell_grid(t).orderBy("row").collect()] == [(1, 2, 3, 0, "x"), (1, 3, 3, 2, "y")]
    c = spark.createDataFrame([("d", 1, 1, "S"), ("d", 1, 2, ""), ("d", 2, 1, None)], "doc string, page int, row int, section string")
    assert [r.section for r in files.carried_forward(c, "section").orderBy("page", "row").collect()] == ["S", "S", "S"]


def test_search(spark):
    rows = spark.createDataFrame([("1", "調査 ＡＢＣ", "", 5, 0), ("1", "", "abc契約", 7, 1), ("2", "z", "z", 9, 0)], "pid string, role string, cc string, amount long, depth int")
    hits = search.spending_hits(search.with_normal(rows, ["role", "cc"]), "Ａbc")
    assert [(r.matched_in, r.amount) for r in hits.collect()] == [("cc", 7), ("role", 5)]
    assert search.spending_totals(hits).first().asDict() == {"hits": 2, "projects": 1, "direct": 5, "subcontract": 7}
    assert search.spending_hits(search.with_normal(rows, ["role", "cc"]), "a").count() == 0


def test_recipient_resolution(spark):
    a, b = "7010001064648", "8010001064647"
    rows = spark.createDataFrame([("㈱甲", a), ("株式会社甲", ""), ("乙", "")], "name string, number string")
    register = spark.createDataFrame([(a, "株式会社甲"), (b, "丙")], "number string, name string")
    merged, supplement = recipients.resolution(rows, register)
    keys = {r.name: r.key for r in recipients.resolved_keys(rows, merged, supplement).collect()}
    assert keys == {"㈱甲": a, "株式会社甲": a, "乙": "name:乙"}


def test_statistics(spark):
    rows = spark.createDataFrame([(float(x), float(x * x)) for x in range(1, 6)], "x double, y double")
    assert abs(stats.spearman(rows, "x", "y").first().rho - 1) < 1e-12 and abs(stats.kendall(rows, "x", "y").first().tau - 1) < 1e-12
    assert [r.segment for r in stats.segments(spark.range(12), "id", "id").orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 4]
