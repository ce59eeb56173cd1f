"""Session settings and the few runtime knobs the library reads."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MAX_GROUP_ROWS = "spark.rosterlake.maxGroupRows"

_DEFAULTS = {
    MAX_GROUP_ROWS: 1_000_000,
}


def build_session(app: str = "rosterlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan in the library expects."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on, on a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    return spark


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it. Only a session in one process may do
    without: it gets a temporary folder of its own. On a cluster a missing setting is an error."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="rosterlake-"))
    return context.getCheckpointDir()


def pin(df: DataFrame) -> DataFrame:
    """Materialise once in shared storage, so that every later read sees the same rows
    and a lost executor costs a re-read, not a re-computation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in shared storage, in a folder that is deleted when the application ends."""
    root = f"{shared_dir(spark)}/rosterlake"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in shared storage: computed once, however many plans read them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """More partitions for heavy per-row work when the input comes in fewer pieces than there
    are cores (a few small files). Larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored_by(df: DataFrame, name: str, key: str, pieces: int) -> DataFrame:
    """``stored``, in ``pieces`` buckets by ``key``: what then works by this key reads a bucket a task and shuffles nothing. Rows
    should come dealt by ``repartition(pieces, key)``, so that a task writes one file. The catalog only serves to write and read
    the buckets; the name is taken back at once, the files stay as long as those of ``stored``."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"rosterlake_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(pieces, key).option("path", path).option("compression", "zstd").saveAsTable(table, format="parquet")
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


@contextmanager
def with_setting(spark: SparkSession, name: str, value: str):
    """A session setting for one write, as it was before afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fewer_keys(spark: SparkSession):
    """For work that is planned and run inside: sides dealt alike by some of their join's keys are joined where they are. Spark
    would deal both again by all keys, against skew; what is laid out in pieces has been checked for that. Rows are the same."""
    return with_setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")
