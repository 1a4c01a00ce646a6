"""Archives, forms and folders: what is read is what was written, and nothing is lost."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import adapter, source_queries
from tallyspark.sources import archives, files, layouts, sinks

REVENUE, SPENT = "款コード,名称,令和7年度予定額(千円),\r\n", "使途別分類,名称,令和元年度要求額\n"


def zipped(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("_", "."), data)


def test_records(spark, tmp_path):
    zipped(tmp_path / "DL1.zip", a_csv=b"\xef\xbb\xbf" + (REVENUE + '1,"x, ""y""\nz",5\r\n \r\n2,short\n3,q,7,,more\n').encode(), b_CSV=(SPENT + "1,s,-3\n2,,9\n").encode(), n_txt=b"no")
    rows = archives.archive_rows(spark, str(tmp_path / "*.zip"))
    got = {(r.member, r.line): (r.side, r.row, r.fault) for r in rows.collect()}
    assert got["a.csv", 1] == ("revenue", {"款コード": "1", "名称": 'x, "y"\nz', "令和7年度予定額(千円)": "5"}, None)
    assert got["a.csv", 2][1:] == ({"款コード": "2", "名称": "short", "令和7年度予定額(千円)": ""}, "short") and got["a.csv", 3][2] == "long" and len(got) == 5
    assert sorted(tuple(r)[1:] for r in archives.faults(rows).collect()) == [("a.csv", "revenue", 3, 1, 1), ("b.CSV", "expenditure", 2, 0, 0)]
    revenue, spent = archives.budget_tables(rows)
    assert [tuple(r) for r in archives.sums_by_name(revenue, "名称").collect()] == [("q", 7000), ('x, "y"\nz', 5000), ("short", 0)]
    assert [tuple(r) for r in archives.sums_by_name(spent, "名称").collect()] == [("s", -3000)]
    assert {r.side for r in files.member_rows(files.zip_members(spark, str(tmp_path / "DL1.zip"))).collect()} == {"revenue"}


def test_side_missing(spark, tmp_path):
    zipped(tmp_path / "x.zip", a_csv=(REVENUE + "1,a,2\n").encode(), b_csv=b"key,value\n1,2\n")
    rows = archives.archive_rows(spark, str(tmp_path / "x.zip"))
    assert {r.member: r.side for r in rows.collect()} == {"a.csv": "revenue", "b.csv": None}
    with pytest.raises(ValueError, match="x.zip .revenue"):
        archives.budget_tables(rows)
    with pytest.raises(ValueError, match="amounts"):
        archives.sums_by_name(rows.where("side is null"), "key")


def test_last_table_of_a_side(spark, tmp_path):
    zipped(tmp_path / "x.zip", a_csv=(REVENUE + "1,a,2\n").encode(), b_csv=(SPENT + "1,b,2\n").encode(), c_csv=(REVENUE + "1,c,2\n").encode())
    revenue, _ = archives.budget_tables(archives.archive_rows(spark, str(tmp_path / "x.zip")))
    assert [r.row["名称"] for r in revenue.collect()] == ["c"]


def test_bad_bytes(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,\xff\xfex\n")
    (row,) = archives.file_rows(spark, str(tmp_path / "x.csv")).collect()
    assert row.row == {"a": "1", "b": "��x"} and row.member == "x.csv"


def test_form_odd(spark):
    texts = spark.createDataFrame([("none", "<table/>"), ("null", None), ("head", '<header><clm id="p1-1.1-4.1"><l><![CDATA[事項]]></l></clm></header>')], "doc string, text string")
    for form in (layouts.standard, layouts.revised, layouts.settlement):
        assert form(texts).count() == 0
    cell = lambda r, c, s, t: f'<clm id="p1-{r}.1-{c}.{s}"><l><![CDATA[{t}]]></l></clm>'
    body = cell(2, 2, 1, "7") + cell(2, 3, 1, "S") + cell(2, 4, 1, "n1") + cell(2, 6, 1, "△1, 234") + cell(3, 2, 1, "大麦等") + cell(3, 3, 1, "172") + cell(3, 4, 1, "n2") + cell(3, 6, 1, "5")
    head = "<header>" + cell(1, 4, 1, "事項") + cell(1, 6, 1, "平成29年度予定額") + "</header>"
    got = layouts.standard(spark.createDataFrame([("d", head + body)], "doc string, text string")).orderBy("row").collect()
    assert [(r.section_code, r.section_name, r.name, r.amount, r.major_code, r.previous) for r in got] == [("7", "S", "n1", -1_234_000, "", None), ("7", "S", "n2", 5000, "", None)]


def test_titles(spark):
    rows = spark.createDataFrame([("<running_title>\n <![CDATA[ 皇室費　]]></running_title><title_for_list><![CDATA[一般 ]]></title_for_list>", "general")], "text string, account string")
    parts = layouts.running_parts("text")
    r = rows.select(layouts.scope("account", parts).alias("scope"), layouts.list_title("text").alias("t"), layouts.is_form("standard", "一般", "text").alias("f"),
                    F.lit("1").alias("section_code"), F.lit("n").alias("name"), "account").withColumn("key", layouts.item_key("account", F.lit("initial"))).first()
    assert tuple(r.scope) == ("皇室費", "皇室費", "", "", "") and r.t == "一般" and r.f and r.key == "general|initial|皇室費|皇室費||||1|n"


def test_years_and_memo(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_by_year(spark.createDataFrame([(1, 2024), (2, 2025)], "x int, year int"), root)
    assert files.years(spark, root) == [2024, 2025] and files.years(spark, str(tmp_path)) == []
    plan = files.read_year(spark, root, 2025)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    before = files.fingerprint(spark, root)
    assert before == files.fingerprint(spark, root)
    sinks.write_by_year(spark.createDataFrame([(3, 2025)], "x int, year int"), root)
    assert before != files.fingerprint(spark, root)


def test_graph_follows_its_tables(spark, tmp_path):
    tables = {"customer": [(1, "C", 0, 1.0, "S")], "nation": [(0, "N", 0)], "orders": [(1, 1, "F", 10.0, "1997-03-01")], "lineitem": [(1, 1, 1, 1, 5.0, 0.0, "A")], "supplier": [(1, "P", 0, 1.0)]}
    shapes = {"customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "nation": "n_nationkey int, n_name string, n_regionkey int",
              "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string",
              "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string",
              "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"}

    def write(name, rows):
        df = spark.createDataFrame(rows, shapes[name])
        df = df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")) if name == "orders" else df
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")

    for name, rows in tables.items():
        write(name, rows)
    total = lambda: adapter.graph(spark, str(tmp_path), 1997).nodes.where("id = 'total'").first().value
    assert total() == 10 * 10_000 and adapter.graph(spark, str(tmp_path), 1997) is adapter.graph(spark, str(tmp_path), 1997)
    write("orders", [(1, 1, "F", 30.0, "1997-03-01")])
    assert total() == 30 * 10_000


def test_json_file(spark, tmp_path):
    import gzip

    (tmp_path / "a.json").write_text('{"x":\n 1}')
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write('[{"x": 2},\n {"x": 3}]')
    assert [[r.x for r in files.read_json_file(spark, str(tmp_path / n), "x int").collect()] for n in "ab"] == [[1], [2, 3]]
    with pytest.raises(FileNotFoundError):
        files.read_json_file(spark, str(tmp_path / "c"), "x int")


def test_members_of_unequal_size_share_an_archive(spark, tmp_path):
    """Both members of an archive come from frames grouped by it, and adaptive execution merges only the small ones' partitions."""
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        member = lambda name, n: (spark.range(20 * n, numPartitions=2).withColumn("of", F.concat(F.lit("a"), F.col("id") % 20)).groupBy("of")
                                  .agg(archives.csv_text([F.sha2(F.col("id").cast("string"), 256)], [F.col("id")]).alias("text"))
                                  .select(F.col("of").alias("archive"), F.lit(name).alias("member"), "text"))
        archives.write_archives(member("b.csv", 15000).unionByName(member("a.csv", 2)), f"file://{tmp_path}")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = {p.name: {m: z.read(m).count(b"\n") + 1 for m in z.namelist()} for p in tmp_path.glob("*.zip") for z in [zipfile.ZipFile(p)]}
    assert sizes == {f"a{i}.zip": {"a.csv": 2, "b.csv": 15000} for i in range(20)}


@pytest.mark.parametrize("layout", ["standard", "revised", "settlement"])
def test_documents_are_taken_apart_in_place(spark, tmp_path, layout):
    """Cells and rows aren't shuffled, joined or sorted as rows, so what is shuffled and spilled doesn't grow with them; and the text is searched for cells once."""
    spark.createDataFrame([(1, "")], "doc long, text string").write.parquet(f"file://{tmp_path}/t")
    plan = getattr(layouts, layout)(spark.read.parquet(f"file://{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort ", "Window", "Join"))
    assert plan.count(r'<clm id="p\d+') == (2 if layout == "standard" else 1)  # a standard form's header is apart


@pytest.mark.parametrize("layout", ["standard", "revised", "settlement"])
def test_cells_are_columns_in_a_task(spark, tmp_path, layout):
    """What a cell, place or row is isn't worked out by lambdas, which Spark runs uncompiled for each element: they took most of the time of the forms' queries."""
    spark.createDataFrame([(1, "")], "doc long, text string").write.parquet(f"file://{tmp_path}/t")
    plan = getattr(layouts, layout)(spark.read.parquet(f"file://{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan


def test_odd_cells(spark, monkeypatch):
    """Cells out of order, several in a place, numbers beyond an int, CDATA that isn't closed or opens twice, documents larger than what is taken apart at once."""
    cell = lambda r, c, s, *t: f'<clm id="p1-{r}.1-{c}.{s}">' + "".join(f"<l><![CDATA[{x}]]></l>" for x in t) + "</clm>"
    head = cell(1, 4, 1, "事項") + cell(1, 5, 1, "歳出予算額(円)") + cell(1, 8, 1, "支出済歳出額(円)")
    body = [cell(3, 5, 1, " n", "2　"), cell(3, 4, 1, "07"), cell(2, 2, 1, "1"), cell(2, 3, 1, "S"), cell(2, 4, 1, "07"), cell(2, 5, 1, "a"), cell(2, 5, 2, "b"),
            '<clm id="p1-2.1-8.1"><l><![CDATA[9]</l></clm>', '<clm id="p1-3.1-8.1"><l><![CDATA[x CDATA[9]]></l></clm>', cell("99999999999", 5, 1, "far"), cell("0000000000004", 5, 1, "5")]
    head = head.replace("-5.1", "-6.1")
    body += [cell(2, 6, 1, "△1, 000"), cell(3, 6, 1, "3"), cell(3, 6, 2, "4"), cell(4, 6, 1, "8"), cell("99999999999", 6, 1, "9")]
    texts = spark.createDataFrame([(k, head + "".join(body)) for k in "ab"] + [("null", None)], "doc string, text string")
    want = [(2, "ab", -1000, "1", "S"), (3, "n2", 3, "1", "S")]
    for size in (1, 50_000):
        monkeypatch.setattr(layouts, "CELLS", size)
        got = layouts.settlement(texts).orderBy("doc", "row").collect()
        assert [(r.doc, r.row, r.name, r.amount, r.section_code, r.section_name, r.spent) for r in got] == [(k, *w, None) for k in "ab" for w in want]


def test_settlement_lines_are_dealt_once(spark):
    """A settlement's header and sums are written with its lines, not joined to them as rows of their own, and lines go to their document before their cells are written."""
    plan = source_queries.settlement_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
    shuffled = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert any("o_custkey" in x and "REPARTITION_BY_" in x for x in shuffled) and not any("cells" in x or "doc#" in x for x in shuffled)


@pytest.mark.parametrize("name", ["standard_items", "revised_items", "settlement_items"])
def test_texts_of_forms_are_made_by_tasks_of_some_lines(spark, monkeypatch, name):
    """Adaptive execution doesn't merge tasks by the size of the shuffled lines, which is far below that of the texts made of them: their number follows the lines'."""
    monkeypatch.setattr(source_queries, "TASK_LINES", 200)
    n = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 200)
    plan = getattr(source_queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    last = next(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)  # the one nearest to the result
    assert "REPARTITION_BY_NUM" in last and f", {n})" in last
