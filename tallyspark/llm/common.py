"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves, but only in local
    mode, where there is one machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a written table: it cuts the lineage, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.own_path = path
    return out


def discard(*tables: DataFrame | str | None) -> None:
    """Delete written tables or folders of this run that nothing reads any more."""
    for x in tables:
        if x is not None:
            store, at = storage(x if isinstance(x, str) else x.own_path)
            store.delete_dir(at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def storage(path: str):
    """(file system, path in it) of a folder URI, for Python code on executors."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


def publish(store, folder: str, name: str, data) -> None:
    """Write data under a temporary name, then rename it: a repeated or lost task leaves no torn file."""
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp) as out:
        out.write(data)
    store.move(temp, f"{folder}/{name}")
