"""Small helpers to run a stream to the end of its input and to keep per-batch tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.session import scratch_path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage, for as long as the application runs."""
    return scratch_path(spark, name)


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of files. A stream takes a plain path
    for a folder; as a pattern (its last character in brackets) it may name a file as well."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def append_to(stream: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Run to the end of the available input into a Parquet table."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint").partitionBy(*partition_by)
        .trigger(availableNow=True).outputMode("append").start(f"{path}/rows")
    )
    query.awaitTermination()


def keep_state_on_disk(spark: SparkSession) -> None:
    """Processors with named states need a state store that keeps them apart."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def each_batch(
    stream: DataFrame, path: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Run ``handle(batch, id)`` to the end of the available input. Handlers write under the
    batch id in overwrite mode, so that a repeated batch replaces itself."""
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(availableNow=True).outputMode(mode).start()
    )
    query.awaitTermination()


class BatchTable:
    """A table with one folder per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, df: DataFrame, batch: int, partition_by: Sequence[str] = ()) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(f"{self.path}/batch={batch}")

    def of(self, batch: int) -> DataFrame:
        return self.all().filter(F.col("batch") == batch)

    def upto(self, batch: int) -> DataFrame:
        """What the batches up to ``batch`` have written; a later one may be there when a batch is repeated."""
        return self.all().filter(F.col("batch") <= batch)

    def all(self) -> DataFrame:
        """Every batch, with its number in the column ``batch``."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
