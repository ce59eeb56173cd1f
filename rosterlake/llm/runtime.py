"""What the operators of this subpackage share: shipping code, scratch tables, sizes."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlake.session import scratch_path

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_rosterlake_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="rosterlake-"), "rosterlake_code.zip")
    with zipfile.ZipFile(path, "w") as bundle:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    bundle.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    context.addPyFile(path)
    context._rosterlake_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(total: int, each: int) -> int:
    """How many pieces of about ``each`` bytes hold ``total`` bytes."""
    return max(1, -(-total // each))


def sha_hex(c: Column | str) -> Column:
    return F.sha2(F.encode(c if isinstance(c, Column) else F.col(c), "UTF-8"), 256)


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with more columns."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)
