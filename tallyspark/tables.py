"""Intermediate tables. A frame that is read several times is written once to the folder that the cluster shares
(spark.checkpoint.dir): its plan ends there, and a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. A local session that names none gets a temporary one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df as a written table."""
    path = shared_path(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df in partitions of about so many rows: for steps whose rows take long though their bytes are few, as a small file is read by one task."""
    return df.repartition(max(1, -(-df.count() // rows)))


def storage(path: str):
    """(file system, path in it) of a folder URI, for Python code on executors."""
    from pyarrow import fs

    parts = urlparse(path)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)
