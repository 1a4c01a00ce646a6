"""Writers: tables by year, JSON for exchange, CSV as spreadsheets want it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_year(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet in a folder a year; rows of a year are kept together, so few files are written."""
    df.repartition("year").write.mode(mode).partitionBy("year").parquet(path)


def write_json(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def write_csv(df: DataFrame, path: str, bom: bool = False, crlf: bool = False) -> None:
    """Quotes where needed. bom marks the first header for spreadsheets."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', lineSep="\r\n" if crlf else "\n", emptyValue="").csv(path)


def nested(rows: DataFrame, key: str, fields: list[str], name: str, order: str) -> DataFrame:
    """Rows of a key as one array of structs, largest first."""
    largest = F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *fields)), asc=False)
    return rows.groupBy(key).agg(F.transform(largest, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
