"""Writing stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Full rewrite of a table, or of the partitions present in ``df`` when it is partitioned."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


def write_deliveries(deliveries: DataFrame, path: str) -> None:
    """Deliveries partitioned by season; undated balls go to season 0."""
    season = F.coalesce(F.year("date"), F.lit(0))
    # One season spreads over several files by match, so a long season is not written by one task.
    rows = deliveries.withColumn("season", season).repartition("season", F.pmod(F.hash("match_id"), F.lit(32)))
    write_table(rows, path, partition_by="season")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
