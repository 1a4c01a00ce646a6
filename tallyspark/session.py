"""Sessions for the engine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tallyspark", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, ANSI arithmetic and UTC; conf overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
