"""The history table: Parquet partitioned by season, the panel every plan reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlake.session import with_setting


# Seasons that a task writes side by side; rows of more seasons are sorted by season first.
OPEN_SEASONS = 20


def write_history(hist: DataFrame, path: str) -> None:
    """Replace the seasons present in ``hist``. Each task writes its rows of a season to a file of its own: dealing the wide rows
    by season would move all of them, and their tasks are as large as the work before left them."""
    with with_setting(hist.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_SEASONS)):
        hist.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("season_name").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
