"""Streaming ingest with dedup, and the finality gate (T1R, T2R)."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rosterlake.streaming.sinks import BatchTable, append_to, each_batch, keep_state_on_disk

# the processor travels with the job, so that workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keys are spread over so many states; a state holds the keys of one watermark delay.
BUCKETS = 128
_SEEN = np.dtype([("a", "<i8"), ("b", "<i8"), ("at", "<i8")])
_FIRST = "bucket int, a long, b long, at long, id binary, late boolean"
#: The period of rows without event time, and the moment (microseconds) that stands for theirs.
_UNDATED, _NO_MOMENT = "undated", -62_135_596_800_000_000


class FirstArrivals(StatefulProcessor):
    """The keys of a bucket that are met for the first time. A key is remembered until the watermark is ``delay`` past
    its event time; a timer at that time clears what no new row touches. Rows behind the watermark are not dropped: a
    key that the state does not know any more, or never knew, is passed on as late."""

    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "keys binary")

    def _known(self) -> np.ndarray:
        return np.frombuffer(self.seen.get()[0], dtype=_SEEN) if self.seen.exists() else np.zeros(0, dtype=_SEEN)

    def _keep(self, known: np.ndarray, watermark_us: int) -> None:
        known = known[known["at"] >= watermark_us - self.delay_us]
        if len(known):
            self.seen.update((known.tobytes(),))
            self.handle.registerTimer((int(known["at"].min()) + self.delay_us) // 1000 + 1)
        elif self.seen.exists():
            self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        first = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable").drop_duplicates(["a", "b"])
        known = self._known()
        new = first[~pd.MultiIndex.from_frame(first[["a", "b"]]).isin(pd.MultiIndex.from_arrays([known["a"], known["b"]]))]
        late = (new["at"] < watermark).to_numpy()
        added = np.zeros(int((~late).sum()), dtype=_SEEN)
        for name in _SEEN.names:
            added[name] = new[name].to_numpy()[~late]
        self._keep(np.concatenate((known, added)), watermark)
        yield pd.DataFrame({"bucket": key[0], "a": new["a"], "b": new["b"], "at": new["at"], "id": new["id"], "late": late})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(), timerValues.getCurrentWatermarkInMs() * 1000)
        yield pd.DataFrame({n: [] for n in ("bucket", "a", "b", "at", "id", "late")})

    def close(self) -> None:
        pass


class DedupIngest:
    """Keeps the first arrival of every key and loses none, whatever the order of arrival.

    Arrivals are landed once, as they are, by period (the day of the event). Their keys alone, as two hashes, pass through
    keyed state. First arrivals in time are accepted as the state finds them. Late ones go to a side table after an anti-join
    with the accepted keys of their periods, which the state may have forgotten; only those periods' files are read. Copies
    of a row are at most ``delay_seconds`` of event time apart. Rows without event time are always late, in a period
    of their own. Of several arrivals of a key in one batch the earliest event counts.
    """

    def __init__(self, spark: SparkSession, path: str, event_time: str, keys: Sequence[str], delay_seconds: int = 3600, buckets: int = BUCKETS):
        self.spark, self.path, self.event_time, self.keys = spark, path, event_time, list(keys)
        self.delay, self.buckets = delay_seconds, buckets
        self.firsts = BatchTable(spark, f"{path}/firsts", T.StructType.fromDDL("a long, b long, at long, id binary, late boolean, period string"))
        self.late = BatchTable(spark, f"{path}/late", T.StructType.fromDDL("a long, b long, at long, id binary, period string"))

    def _period(self, at) -> F.Column:
        return F.coalesce(F.date_format(F.timestamp_micros(at), "yyyy-MM-dd"), F.lit(_UNDATED))

    def run(self, stream: DataFrame, files_per_batch: int | None = None) -> None:
        """Land what has arrived, then pass the keys of what is newly landed through the state."""
        self.columns = stream.columns
        landed = stream.withColumns({"_id": F.unhex(F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))), "_period": self._period(F.unix_micros(F.col(self.event_time).cast("timestamp")))})
        self.schema = landed.schema
        append_to(landed, f"{self.path}/landed", ["_period"])
        reader = self.spark.readStream.schema(self.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        keyed = reader.parquet(f"{self.path}/landed/rows").select(
            F.coalesce(F.col(self.event_time).cast("timestamp"), F.timestamp_micros(F.lit(_NO_MOMENT))).alias("moment"), F.col("_id").alias("id"),
            F.xxhash64(*self.keys).alias("a"), F.xxhash64(F.lit(1), *self.keys).alias("b"),
        ).withWatermark("moment", f"{self.delay} seconds")
        # the state sees event times as numbers, so that no operator drops what is behind the watermark
        plain = keyed.select(F.pmod("a", F.lit(self.buckets)).cast("int").alias("bucket"), "a", "b", F.unix_micros("moment").alias("at"), "id")
        keep_state_on_disk(self.spark)
        firsts = plain.groupBy("bucket").transformWithStateInPandas(
            statefulProcessor=FirstArrivals(self.delay * 1_000_000), outputStructType=_FIRST, outputMode="Append", timeMode="EventTime"
        )
        each_batch(firsts, f"{self.path}/keys", self._accept)

    def _accept(self, batch: DataFrame, number: int) -> None:
        undated = F.col("at") == _NO_MOMENT
        period = F.when(undated, F.lit(_UNDATED)).otherwise(self._period(F.col("at")))
        self.firsts.write(batch.select("a", "b", "at", "id", (F.col("late") | undated).alias("late"), period.alias("period")), number, ["late", "period"])
        arrived = self.firsts.upto(number)
        late = self.firsts.of(number).filter("late")
        reach = late.filter(f"period <> '{_UNDATED}'").agg(F.min("at"), F.max("at")).first()
        near = F.col("period") == _UNDATED
        if reach[0] is not None:
            low, high = (F.lit(t + d * self.delay * 1_000_000) for t, d in zip(reach, (-1, 1)))
            near = near | F.col("period").between(self._period(low), self._period(high))
        known = arrived.filter(~F.col("late") & near).select("a", "b").union(self.late.upto(number - 1).filter(near).select("a", "b"))
        once = late.groupBy("a", "b").agg(F.min_by(F.struct("at", "id", "period"), F.struct("at", "id")).alias("_first")).select("a", "b", "_first.*")
        self.late.write(once.join(known, ["a", "b"], "left_anti"), number, ["period"])

    def accepted(self) -> DataFrame:
        """(id, period, late): the arrival that stands for each key."""
        on_time = self.firsts.all().filter(~F.col("late")).select("id", "period", "late")
        return on_time.union(self.late.all().select("id", "period", F.lit(True)))

    def rows(self) -> DataFrame:
        """The first arrival of every key, with ``late``."""
        landed = self.spark.read.schema(self.schema).parquet(f"{self.path}/landed/rows")
        found = self.accepted().select(F.col("id").alias("_id"), F.col("period").alias("_period"), "late")
        return landed.join(found, ["_period", "_id"]).select(*self.columns, "late")

    def counts(self) -> DataFrame:
        """(batch, n_on_time, n_late, n_late_new): first arrivals, those behind the watermark, and how many of these were new."""
        seen = self.firsts.all().groupBy("batch").agg(F.count(F.when(~F.col("late"), 1)).alias("n_on_time"), F.count(F.when(F.col("late"), 1)).alias("n_late"))
        new = self.late.all().groupBy("batch").agg(F.count(F.lit(1)).alias("n_late_new"))
        return seen.join(new, "batch", "left").fillna(0, ["n_late_new"])


class FinalityGate:
    """Passes rows of final rounds on and keeps provisional ones until their round turns final.

    Arrivals are written once, to a log by batch. A release is a marker (period, batch) beside it: what is
    released or waiting follows from both, and no row is written again however long it waits. ``rounds`` returns the current
    round table (id, finished, data_checked); it is read again for every batch, so a flip releases what has been waiting. A
    round that was released stays so. Rows without a period wait for good.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, period: str, rounds: Callable[[], DataFrame]
    ):
        self.spark, self.period, self.rounds, self.path = spark, period, rounds, path
        self.log = BatchTable(spark, f"{path}/log", schema)
        self.periods = BatchTable(spark, f"{path}/periods", T.StructType([schema[period]]))
        self.markers = BatchTable(spark, f"{path}/markers", T.StructType([schema[period]]))

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.log.write(batch.select([f.name for f in self.log.schema]), number)
        self.periods.write(self.log.of(number).select(self.period).distinct(), number)
        final = self.rounds().filter(
            F.coalesce("finished", F.lit(False)) & F.coalesce("data_checked", F.lit(False))
        ).select(F.col("id").cast(self.markers.schema[0].dataType).alias(self.period))
        met = self.periods.upto(number).select(self.period).distinct()
        marked = self.markers.upto(number - 1).select(self.period)
        self.markers.write(met.join(final, self.period, "left_semi").join(marked, self.period, "left_anti"), number)

    def run(self, stream: DataFrame) -> None:
        each_batch(stream, self.path, self)

    def _marked(self) -> DataFrame:
        return self.markers.all().groupBy(self.period).agg(F.min("batch").alias("_marked"))

    def released(self, batch: int | None = None) -> DataFrame:
        """Released rows with the ``batch`` that released them, or only those that ``batch`` released."""
        passed = self.log.all().join(self._marked(), self.period).withColumn("batch", F.greatest("batch", "_marked")).drop("_marked")
        return passed if batch is None else passed.filter(F.col("batch") == batch)

    def waiting(self) -> DataFrame:
        return self.log.all().join(self._marked(), self.period, "left_anti")
