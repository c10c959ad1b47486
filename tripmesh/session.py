"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Size checks for joins without a hint, at plan time and again on measured
# shuffle sizes, and splitting of hot partitions. Flights are small in a shuffle
# but each may become a day of minutes, so their partitions are not merged down
# to megabytes while cores stand idle.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.ansi.enabled": "true",
}


def build(app: str = "tripmesh", **extra: str) -> SparkSession:
    """Session with the recommended settings; master and sizes come from spark-submit or ``extra``."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Where that is unset it is the warehouse folder, which executors share too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
