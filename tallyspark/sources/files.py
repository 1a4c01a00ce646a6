"""Readers of the public releases: CSV (also by position, with a byte order mark, or in ZIP archives), XML cell grids, JSON and JSON lines."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.sources import archives

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, names: list[str] | None = None, keep_order: bool = False) -> DataFrame:
    """Every column as text, trimmed; rows of another width and blank rows are dropped. names: columns by position instead of the header's.
    keep_order adds line_no, which grows in file order (it's the order that "the first row wins" rules go by)."""
    reader = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
                                mode="DROPMALFORMED", nullValue=None, emptyValue="")
    df = reader.csv(path)
    df = df.toDF(*[c.removeprefix(BOM).strip() for c in df.columns])
    if names:
        df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=False)])
    df = df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns])
    blank = F.forall(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]), lambda x: x == "")
    df = df.where(~blank)
    return df.withColumn("line_no", F.monotonically_increasing_id()) if keep_order else df


def zip_members(spark: SparkSession, path: str, pattern: str = r".*\.csv$", encoding: str = "utf-8-sig") -> DataFrame:
    """archive, member, text of every member whose name matches; an archive is a task's, a member a row."""

    def each(batches):
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in sorted(z.namelist()):
                        if re.match(pattern, name):
                            yield pa.RecordBatch.from_pydict({"archive": [archive], "member": [name], "text": [z.read(name).decode(encoding, "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, "archive string, member string, text string")


table_side = archives.side_of


def amount_column(header: list[str]) -> str:
    """The column of the year's amounts, named by its era year."""
    for name in header:
        if re.match(r"^(令和|平成)(元|\d+)年度", name):
            return name
    raise ValueError(f"no column of amounts in {header}")


def member_rows(members: DataFrame) -> DataFrame:
    """Members' CSV text as member, i, side, row (a map from header to value), fault. Every record is a row, see `archives`."""
    archive = F.col("archive") if "archive" in members.columns else F.lit("")
    return archives.text_rows(members.withColumn("archive", archive)).select("member", F.col("line").alias("i"), "side", "row", "fault")


CELL = r'<clm id="p(\d+)-(\d+)\.(\d+)-(\d+)(?:\.(\d+))?"[^>]*>(.*?)</clm>'


def cell_grid(texts: DataFrame) -> DataFrame:
    """texts(doc, text) -> doc, page, row, line, col, sub, value of each cell of an XML table."""
    cell = F.explode(F.regexp_extract_all("text", F.lit(CELL), 0)).alias("cell")
    part = lambda i: F.regexp_extract("cell", CELL, i)
    number = lambda i: part(i).try_cast("int")
    return texts.select("doc", cell).select("doc", number(1).alias("page"), number(2).alias("row"), number(3).alias("line"), number(4).alias("col"),
                                            F.coalesce(number(5), F.lit(0)).alias("sub"), F.trim(F.regexp_replace(part(6), "<[^>]+>", "")).alias("value"))


def carried_forward(rows: DataFrame, column: str, by: str = "doc", order: tuple[str, ...] = ("page", "row")) -> DataFrame:
    """Fills a column that is only printed where it changes, in reading order within a document."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.nullif(F.trim(column), F.lit("")), ignorenulls=True).over(w))


def menu_entries(pages: DataFrame, text: str = "text") -> DataFrame:
    """Names of XML files in LineOut(...) calls of a menu page."""
    return pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"LineOut\([^)]*?([A-Za-z0-9_]+\.xml)"), 1)).alias("name")).distinct()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A torn line is dropped; .gz files are read as they are."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_file(spark: SparkSession, stem: str, schema: str) -> DataFrame:
    """{stem}.json, or where there is none {stem}.json.gz: one document of many lines. FileNotFoundError where there is neither."""
    for path in (f"{stem}.json", f"{stem}.json.gz"):
        if _store(spark, path).exists(_path(spark, path)):
            return spark.read.schema(schema).option("multiLine", True).json(path)
    raise FileNotFoundError(f"{stem}.json, {stem}.json.gz")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    """The file system of a path, whichever Spark can read."""
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of the files below some paths: it changes with the files. Only the listing is read."""
    found = []
    for path in paths:
        files = _store(spark, path).listFiles(_path(spark, path), True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def read_year(spark: SparkSession, root: str, year: int) -> DataFrame:
    """One year of a table partitioned by year; only its files are read."""
    return spark.read.parquet(root).where(F.col("year") == year)


def years(spark: SparkSession, root: str) -> list[int]:
    """Years that a table has, by the names of its folders; no file is read."""
    found = _store(spark, root).globStatus(_path(spark, f"{root.rstrip('/')}/year=*")) or []
    return sorted(int(m[1]) for f in found if f.isDirectory() and (m := re.fullmatch(r"year=(\d+)", f.getPath().getName())))
