"""CSV tables in ZIP archives, as the budget book is released: a table's side is told by its header, columns' names by the year.

Records are split by a CSV state machine over the member's stream, so quoted line ends, commas and quotes are data; a task holds an archive's
bytes and a batch of records. No record is dropped: one with too few cells is filled with empty ones, one with too many keeps those that have
a name, and both carry a fault, which `faults` counts. Bytes that aren't text become U+FFFD; a byte order mark is no part of the first name.
"""

from __future__ import annotations

import csv
import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.tables import storage

#: What a header of either side holds. A header with one of the first is expenditure, whatever else it holds.
EXPENDITURE, REVENUE = ("主要経費別分類", "使途別分類"), ("款コード", "主管")
ERA_YEAR = r"^(令和|平成)(元|\d+)年度"
#: Amounts are in thousands.
THOUSAND = 1000
#: Records of a batch; characters of a cell at most (csv's own limit is lower than real cells are long).
ROWS, CELL = 2000, 1 << 30
SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("place", pa.int32()), ("line", pa.int64()), ("side", pa.string()),
                    ("header", pa.list_(pa.string())), ("row", pa.map_(pa.string(), pa.string())), ("fault", pa.string())])
SHAPE = "archive string, member string, place int, line long, side string, header array<string>, row map<string,string>, fault string"


def side_of(header: list[str]) -> str | None:
    """revenue or expenditure, by the header and not by the file's name; None for a table that is neither."""
    for side, marks in (("expenditure", EXPENDITURE), ("revenue", REVENUE)):
        if any(m in name for name in header for m in marks):
            return side
    return None


def records(stream, archive: str, member: str, place: int):
    """Record batches of a text stream's CSV."""
    csv.field_size_limit(CELL)
    header, side, width, out = None, None, 0, []
    for line, cells in enumerate(c for c in csv.reader(stream) if len(c) > 1 or c and c[0].strip()):
        cells = [c.strip() for c in cells]
        if header is None:
            header, side = cells, side_of(cells)
            width = max((i for i, h in enumerate(header, 1) if h), default=0)  # forms may end in columns without a name
            continue
        fault = "short" if len(cells) < width else "long" if any(cells[width:]) else None
        cells += [""] * (len(header) - len(cells))
        out.append({"archive": archive, "member": member, "place": place, "line": line, "side": side, "header": header,
                    "row": list({h: c for h, c in zip(header, cells, strict=False) if h}.items()), "fault": fault})
        if len(out) == ROWS:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, SCHEMA)


def archive_rows(spark: SparkSession, path: str, suffix: str = ".csv", encoding: str = "utf-8-sig") -> DataFrame:
    """A row for each record of the archives' tables: archive, member, place (of the member), line, side, header, row (name -> cell), fault."""

    def each(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for place, name in enumerate(n for n in z.namelist() if n.lower().endswith(suffix)):
                        with z.open(name) as raw:
                            yield from records(io.TextIOWrapper(raw, encoding, "replace", newline=""), archive, name, place)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, SHAPE)


def file_rows(spark: SparkSession, path: str, encoding: str = "utf-8-sig") -> DataFrame:
    """The same of plain CSV files: bytes that aren't text are replaced, a byte order mark goes."""

    def each(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from records(io.TextIOWrapper(io.BytesIO(content.as_buffer()), encoding, "replace", newline=""), name, name.rpartition("/")[2], 0)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, SHAPE)


def text_rows(texts: DataFrame) -> DataFrame:
    """The same of texts(archive, member, text)."""

    def each(batches):
        for batch in batches:
            for archive, member, text in zip(*[batch.column(i) for i in range(3)], strict=True):
                yield from records(io.StringIO(text.as_py() or "", newline=""), archive.as_py(), member.as_py(), 0)

    return texts.select("archive", "member", "text").mapInArrow(each, SHAPE)


def faults(rows: DataFrame) -> DataFrame:
    """archive, member, side, records, short, long: how many records a table has, and how many of them have too few or too many cells."""
    return rows.groupBy("archive", "member", "side").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("fault") == "short").alias("short"),
                                                         F.count_if(F.col("fault") == "long").alias("long"))


def budget_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revenue, expenditure) of archives' rows, each side the last table of its kind in an archive. ValueError where an archive lacks a side."""
    last = rows.where("side is not null").groupBy("archive", "side").agg(F.max("place").alias("place"))
    found = rows.select("archive").distinct().join(last, "archive", "left").groupBy("archive").agg(F.collect_set("side").alias("sides"))
    lacking = [f"{r.archive} ({', '.join(r.sides) or 'neither'})" for r in found.where(F.size("sides") < 2).orderBy("archive").limit(20).collect()]
    if lacking:
        raise ValueError(f"revenue or expenditure can't be read, only what is in parentheses: {'; '.join(lacking)}")
    own = rows.join(last, ["archive", "side", "place"], "left_semi")
    return own.where("side = 'revenue'"), own.where("side = 'expenditure'")


def year_column(header: Column) -> Column:
    """The name of the column of the year's amounts, null where there is none."""
    return F.get(F.filter(header, lambda h: h.rlike(ERA_YEAR)), F.lit(0))


def amount(row: Column, column: Column, scale: int = THOUSAND) -> Column:
    """A cell's leading whole number in yen; empty and other texts are 0."""
    return F.coalesce(F.regexp_extract(F.element_at(row, column), r"^[+-]?\d+", 0).try_cast("long"), F.lit(0)) * scale


def sums_by_name(rows: DataFrame, name: str) -> DataFrame:
    """name, amount: the year's amounts by a column, largest first; rows without a name are left out. ValueError where a table has no amounts."""
    named = rows.withColumn("__year", year_column(F.col("header")))
    bad = named.where("__year is null").select("archive", "member", "header").limit(1).collect()
    if bad:
        raise ValueError(f"no column of amounts in {bad[0].archive}, {bad[0].member}: {', '.join(bad[0].header)}")
    cell = F.coalesce(F.element_at("row", F.lit(name)), F.lit(""))
    return (named.where(cell != "").groupBy(cell.alias("name")).agg(F.sum(amount(F.col("row"), F.col("__year"))).alias("amount"))
            .orderBy(F.desc("amount"), "name"))


def write_archives(members: DataFrame, folder: str) -> None:
    """Writes members(archive, member, text) as {folder}/{archive}.zip; a task streams its archives' members, under a temporary name until an archive is whole."""
    store, at = storage(folder)
    store.create_dir(at, recursive=True)

    def each(batches):
        store, at = storage(folder)
        name = out = z = temp = None

        def close():
            if z:
                z.close()
                out.close()
                store.move(temp, f"{at}/{name}.zip")

        for batch in batches:
            for archive, member, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if archive != name:
                    close()
                    name, temp = archive, f"{at}/.{archive}.{uuid.uuid4().hex}.tmp"
                    out = store.open_output_stream(temp)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(member), (text or "").encode("utf-8"))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([name or ""])], names=["archive"])

    # by a hash of its own: an exchange by the name itself is left out over a union of frames grouped by it, whose partitions are then merged apart
    rows = members.select("archive", "member", "text").repartition(F.xxhash64("archive")).sortWithinPartitions("archive", "member")
    rows.mapInArrow(each, "archive string").write.format("noop").mode("overwrite").save()


def csv_text(cells: list[Column], order: list[Column]) -> Column:
    """An aggregate: a group's rows as CSV lines in order, quoted where they must be; a null is no cell."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *map(quoted, cells))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")))), lambda x: x["line"]), "\r\n")
