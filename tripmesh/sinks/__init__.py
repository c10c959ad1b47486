"""Writers. Each task writes its own files; nothing goes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_sorted_parquet(
    df: DataFrame,
    path: str,
    *sort: str,
    range_by: tuple[str, ...] | None = None,
    partition_by: tuple[str, ...] = (),
    mode: str = "errorifexists",
) -> None:
    """Parquet in global order of ``sort``: range shuffle, then a sort inside each range.

    ``range_by=()`` takes a frame that is already range-partitioned, as a panel is
    when its flights were before they were expanded. The bounds of a range
    shuffle come from samples, so a frequent leading value needs enough sort
    columns behind it to be divisible.
    """
    keys = sort if range_by is None else range_by
    ranged = df.repartitionByRange(*keys) if keys else df
    writer = ranged.sortWithinPartitions(*partition_by, *sort).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    df.write.mode(mode).options(header=True, **options).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
