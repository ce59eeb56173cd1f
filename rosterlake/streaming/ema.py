"""Keyed EMA bias over a stream (T3R); the batch twin is ``plans.state.replay_state``."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rosterlake.constants import EMA_ALPHA
from rosterlake.plans.state import KINDS
from rosterlake.streaming.sinks import BatchTable, each_batch, keep_state_on_disk

# the processor travels with the job, so that workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SUMS = "season_name string, kind string, key string, gw int, total double, n long"
_STATE = "season string, gws array<int>, totals array<double>, ns array<long>"
OUTPUT = "season_name string, kind string, key string, bias double, last_gw int"


class EmaBias(StatefulProcessor):
    """The rounds of the running season as (sum, count), folded into the bias in the order of the rounds, so the result
    depends neither on how rows were cut into batches nor on the order of the batches. A key's state has one entry a round. A
    new season starts from nothing, and rows of an older one are not counted any more."""

    alpha = EMA_ALPHA

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bias", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, name = key
        season, gws, totals, ns = self.state.get() if self.state.exists() else ("", [], [], [])
        new = pd.concat(list(rows))
        newest = max(season, new["season_name"].max())
        held = pd.DataFrame({"gw": gws, "total": totals, "n": ns}) if season == newest else new[["gw", "total", "n"]].iloc[:0]
        both = pd.concat([held, new.loc[new["season_name"] == newest, ["gw", "total", "n"]]])
        rounds = both.groupby("gw", as_index=False)[["total", "n"]].sum().sort_values("gw")
        bias = 0.0
        for r in rounds.itertuples(index=False):
            bias = (1.0 - self.alpha) * bias + self.alpha * r.total / r.n
        self.state.update((newest, rounds["gw"].astype(int).tolist(), rounds["total"].astype(float).tolist(), rounds["n"].astype(int).tolist()))
        yield pd.DataFrame(
            {"season_name": [newest], "kind": [kind], "key": [name], "bias": [bias], "last_gw": [int(rounds["gw"].max())]}
        )

    def close(self) -> None:
        pass


def round_sums(residuals: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """(season_name, kind, key, gw, total, n) of residuals (season_name, gw, residual, key columns)."""
    tagged = residuals.select(
        "season_name", F.col("gw").cast("int").alias("gw"), F.col("residual").cast("double").alias("residual"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in kinds.items()])
        ).alias("_k"),
    ).select("season_name", "_k.kind", "_k.key", "gw", "residual").filter(
        F.col("season_name").isNotNull() & F.col("key").isNotNull() & F.col("gw").isNotNull() & F.col("residual").isNotNull()
    )
    return tagged.groupBy("season_name", "kind", "key", "gw").agg(F.sum("residual").alias("total"), F.count(F.lit(1)).alias("n"))


def run_ema(residuals: DataFrame, path: str, kinds: dict[str, str] = KINDS, files_per_batch: int | None = None) -> DataFrame:
    """Run to the end of the input and return the newest bias per key.

    Two levels: each batch is first summed by key and round, with partial sums where the rows are, so that a key that holds a
    third of them reaches the state as one row a round. The state reads those sums as a stream of its own.
    """
    spark = residuals.sparkSession
    keep_state_on_disk(spark)
    sums = BatchTable(spark, f"{path}/sums", StructType.fromDDL(_SUMS))
    updates = BatchTable(spark, f"{path}/updates", StructType.fromDDL(OUTPUT))
    each_batch(residuals, path, lambda batch, n: sums.write(round_sums(batch, kinds), n))
    reader = spark.readStream.schema(sums.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    biases = reader.parquet(f"{path}/sums/*").groupBy("kind", "key").transformWithStateInPandas(
        statefulProcessor=EmaBias(), outputStructType=OUTPUT, outputMode="Update", timeMode="None"
    )
    each_batch(biases, f"{path}/state", lambda batch, n: updates.write(batch, n), "update")
    return updates.all().groupBy("kind", "key").agg(
        F.max_by(F.struct("season_name", "bias", "last_gw"), "batch").alias("_u")
    ).select("kind", "key", "_u.*")
