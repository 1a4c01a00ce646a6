"""Keeps the spending table of a graph fresh from files as they arrive: an extension, as the model itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spending_stream(spark: SparkSession, source: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(source)


def keep_fresh(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    """Appends each micro-batch to target as sums by pid and recipient with its batch id; a batch that is repeated overwrites its own folder."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.groupBy("pid", "recipient").agg(F.sum("amount").alias("amount")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("pid", "recipient").agg(F.sum("amount").alias("amount"))
