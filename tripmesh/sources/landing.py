"""Landing of fetched departure records: JSON lines in, a table partitioned by arrival day out.

Fetch windows overlap, so records come again and again, but a copy has the same arrival
and so the same day. A batch is compared with the days it touches and with nothing else of the history,
and those days are overwritten as whole partitions: landing a file twice changes nothing, nor does a
job that is run again after it was cut short.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmesh.config import Settings
from tripmesh.functions.time import local_wall
from tripmesh.schemas import RECORD

DAY = "arrival_day"
CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Landed:
    """What one landing did: lines that are no records, records that were new, days written."""

    rejected: int
    fresh: int
    days: int


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All fields of the records; a line that is none keeps its text in ``_corrupt_record``."""
    schema = T.StructType([*RECORD.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def with_day(records: DataFrame, settings: Settings) -> DataFrame:
    """Distinct records with the local date of arrival; records without an arrival have none."""
    day = F.to_date(local_wall(F.col("lastSeen"), settings.timezone))
    return records.select(*RECORD.fieldNames()).distinct().withColumn(DAY, day)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """The landed table; empty where nothing has landed yet."""
    schema = T.StructType([*RECORD.fields, T.StructField(DAY, T.DateType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def on_days(landed: DataFrame, days: list) -> DataFrame:
    """Landed records of some days, null among them; the list prunes partitions."""
    wanted = F.col(DAY).isin([d for d in days if d is not None])
    return landed.where(wanted | F.col(DAY).isNull() if None in days else wanted)


def fresh_records(batch: DataFrame, landed: DataFrame) -> DataFrame:
    """Records of a batch that the landed ones do not hold; fields that are null in both are equal."""
    there = landed.select(*[F.col(c).alias(f"_{c}") for c in batch.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in batch.columns])
    return batch.join(there, same, "left_anti")


def land(spark: SparkSession, records: str, path: str, rejects: str, settings: Settings) -> Landed:
    """Land a file or folder of JSON records under ``path``; lines that are no records go to ``rejects``."""
    read = read_records(spark, records)
    read.where(F.col(CORRUPT).isNotNull()).write.mode("overwrite").json(rejects)
    n_rejected = spark.read.schema(read.schema).json(rejects).count()
    batch = with_day(read.where(F.col(CORRUPT).isNull()), settings)
    counted = batch.groupBy(DAY).count().collect()  # one row for each calendar day of the batch
    days = [r[DAY] for r in counted]
    if not days:
        return Landed(n_rejected, 0, 0)
    old = on_days(read_landed(spark, path), days)
    n_old = old.count()
    merged = old.unionByName(fresh_records(batch, old))
    ordered = merged.repartitionByRange(DAY, "icao24", "firstSeen").sortWithinPartitions(DAY, "lastSeen")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return Landed(n_rejected, on_days(read_landed(spark, path), days).count() - n_old, len(days))
