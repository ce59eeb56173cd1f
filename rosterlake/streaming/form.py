"""Running form over a stream (T4R): the batch operator inside each micro-batch, keyed state across them."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rosterlake.constants import ROLLING_WINDOW
from rosterlake.operators.ordered import lookback, top_rows
from rosterlake.streaming.sinks import BatchTable, each_batch, keep_state_on_disk

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Tail(StatefulProcessor):
    """A ring of the last values of an entity. For every batch that the entity has rows in, it hands out what the ring held
    before: the sum and number of its last 1, 2, ... values. Then the batch's own last values go in."""

    def __init__(self, keys: list[str], size: int):
        self.keys, self.size = keys, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [None if v is None or v != v else float(v) for (v,) in self.ring.get()] if self.ring.exists() else []
        batches, carried = [], []
        for r in pd.concat(list(rows)).sort_values("batch").itertuples(index=False):
            last = held[::-1][: self.size]
            known = [[v for v in last[:k] if v is not None] for k in range(1, self.size + 1)]
            batches.append(r.batch)
            carried.append([(float(sum(k)), len(k)) for k in known])
            held = [*held, *(None if v is None or v != v else float(v) for v in r.tail)][-self.size :]
        self.ring.put([(v,) for v in held])
        yield pd.DataFrame({**{k: [v] * len(batches) for k, v in zip(self.keys, key)}, "batch": batches, "sums": [[s for s, _ in c] for c in carried], "counts": [[n for _, n in c] for c in carried]})

    def close(self) -> None:
        pass


class RunningForm:
    """Mean of the previous rows per entity for every arriving row. Entities must arrive in order across batches; inside a
    batch any order will do.

    A batch's rows are windowed by the batch operator, which splits a hot entity. All rows with enough rows before them
    in their batch are done; the first few of each entity wait for what earlier batches left behind. An entity passes on
    one row a batch, its last values, to the keyed state, whatever the number of its rows; only entities that arrive are
    written. The state runs when the batches have been landed.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str],
        stat: str, size: int = ROLLING_WINDOW,
    ):
        self.spark, self.keys, self.order, self.stat, self.size, self.path = spark, list(keys), list(order), stat, size, path
        self.columns = [f.name for f in schema]
        partial = T.StructType.fromDDL("_before int, _sum double, _count long, _head boolean")
        self.landed = BatchTable(spark, f"{path}/landed", T.StructType([*schema.fields, *partial.fields]))
        keyed = [schema[k] for k in self.keys]
        self.tails = BatchTable(spark, f"{path}/tails", T.StructType([*keyed, T.StructField("tail", T.ArrayType(T.DoubleType()))]))
        self.out = T.StructType([*keyed, *T.StructType.fromDDL("batch long, sums array<double>, counts array<long>").fields])
        self.carried = BatchTable(spark, f"{path}/carried", self.out)

    def __call__(self, batch: DataFrame, number: int) -> None:
        def before(w):
            seen = w.rowsBetween(-self.size, -1)
            stat = F.col(self.stat).cast("double")
            return {"_before": F.count(F.lit(1)).over(seen).cast("int"), "_sum": F.coalesce(F.sum(stat).over(seen), F.lit(0.0)), "_count": F.count(stat).over(seen)}

        rows = lookback(batch.select(self.columns), self.keys, self.order, self.size, before)
        self.landed.write(rows.withColumn("_head", F.col("_before") < self.size), number, ["_head"])
        newest = [s[1:] if s.startswith("-") else f"-{s}" for s in self.order]
        last = top_rows(self.landed.of(number).select(self.columns), self.keys, newest, self.size)
        names = [s.lstrip("-") for s in self.order]
        compare = lambda a, b: _compared(a, b, self.order)
        tail = F.array_sort(F.collect_list(F.struct(*names, F.col(self.stat).cast("double").alias("_stat"))), compare)
        self.tails.write(last.groupBy(*self.keys).agg(F.transform(tail, lambda x: x["_stat"]).alias("tail")), number)

    def run(self, stream: DataFrame) -> None:
        each_batch(stream, self.path, self)
        keep_state_on_disk(self.spark)
        schema = T.StructType([*self.tails.schema.fields, T.StructField("batch", T.LongType())])
        tails = self.spark.readStream.schema(schema).option("basePath", f"{self.path}/tails").parquet(f"{self.path}/tails")
        carried = tails.groupBy(*self.keys).transformWithStateInPandas(
            statefulProcessor=Tail(self.keys, self.size), outputStructType=self.out, outputMode="Append", timeMode="None"
        )
        each_batch(carried, f"{self.path}/state", lambda df, n: self.carried.write(df.withColumnRenamed("batch", "_of"), n))

    def rows(self) -> DataFrame:
        """Every row that has arrived, with the mean of the ``size`` rows before it."""
        name = f"{self.stat}_ma{self.size}"
        landed, mean = self.landed.all(), F.col("_sum") / F.nullif(F.col("_count"), F.lit(0))
        done = landed.filter(~F.col("_head")).select(*self.columns, mean.alias(name))
        carried = self.spark.read.schema(T.StructType([*[f for f in self.out if f.name != "batch"], T.StructField("_of", T.LongType())])).parquet(f"{self.path}/carried")
        kept = carried.select(*[F.col(k).alias(f"_c_{k}") for k in self.keys], "_of", "sums", "counts")
        same = F.col("batch") == F.col("_of")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        at = F.lit(self.size - 1) - F.col("_before")
        total, n = F.col("_sum") + F.get("sums", at), F.col("_count") + F.get("counts", at)
        heads = landed.filter("_head").join(kept, same).select(*self.columns, (total / F.nullif(n, F.lit(0))).alias(name))
        return done.unionByName(heads)


def _compared(a: F.Column, b: F.Column, order: Sequence[str]) -> F.Column:
    """-1, 0 or 1 for two rows under ``order``; nulls last."""
    out = F.lit(0)
    for spec in reversed(order):
        x, y = a[spec.lstrip("-")], b[spec.lstrip("-")]
        less = 1 if spec.startswith("-") else -1
        out = (
            F.when(x.isNull() & y.isNull(), out).when(x.isNull(), 1).when(y.isNull(), -1)
            .when(x < y, less).when(x > y, -less).otherwise(out)
        )
    return out
