"""The stream forms on the events table; the SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.catalog.base import query, rounded, table
from rosterlake.streaming.ema import run_ema
from rosterlake.streaming.form import RunningForm
from rosterlake.streaming.ingest import DedupIngest, FinalityGate
from rosterlake.streaming.sinks import read_files, scratch


def event_stream(spark, sf):
    return read_files(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


@query("stream_dedup", "select event_id, user_id, event_type, value from events")
def stream_dedup(spark, sf):
    """Every event arrives twice and is kept once."""
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    ingest = DedupIngest(spark, scratch(spark, "dedup"), "ts", ["event_id"], 86_400)
    ingest.run(twice)
    return ingest.rows().select("event_id", "user_id", "event_type", "value")


@query("stream_dedup_late", """
select event_id, user_id, event_type, value, first_value(day(ts)) over (order by ts desc, event_id) - day(ts) > 1 as behind from events""")
def stream_dedup_late(spark, sf):
    """Events landed in files of falling time, one file a batch: all that lies behind the watermark comes by the side table."""
    path = scratch(spark, "dedup-falling")
    day = F.dayofmonth("ts")
    events = table(spark, sf, "events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    newest = events.agg(F.max(day)).first()[0] or 0
    ingest = DedupIngest(spark, path, "ts", ["event_id"], 86_400)
    # three landings: the newest days, the middle ones, the oldest
    for low, high in ((newest - 1, newest), (newest - 10, newest - 2), (0, newest - 11)):
        events.filter(day.between(low, high)).write.mode("append").parquet(f"{path}/in")
        ingest.run(read_files(spark, f"{path}/in", events.schema))
    return ingest.rows().select("event_id", "user_id", "event_type", "value", F.col("late").alias("behind"))


@query("finality_gate", """
select day(ts) as gw, case when day(ts) <= 20 and day(ts) % 6 <> 0 then 'released' else 'waiting' end as state, count(*) as n from events group by 1, 2""")
def finality_gate(spark, sf):
    rows = event_stream(spark, sf).select("event_id", F.dayofmonth("ts").alias("gw"), "value")

    def rounds():
        days = table(spark, sf, "events").select(F.dayofmonth("ts").alias("id")).distinct()
        return days.withColumns({"finished": F.col("id") <= 20, "data_checked": F.col("id") % 6 != 0})

    gate = FinalityGate(spark, scratch(spark, "gate"), rows.schema, "gw", rounds)
    gate.run(rows)
    released = gate.released().withColumn("state", F.lit("released"))
    return released.unionByName(gate.waiting().withColumn("state", F.lit("waiting"))).groupBy("gw", "state").agg(F.count(F.lit(1)).alias("n"))


@query("stream_form", """
select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding), 6) as value_ma5 from events""")
def stream_form(spark, sf):
    rows = event_stream(spark, sf).select("event_id", "user_id", "ts", "value")
    path = scratch(spark, "form")
    running = RunningForm(spark, path, rows.schema, ["user_id"], ["ts", "event_id"], "value")
    running.run(rows)
    return rounded(running.rows().select("event_id", "value_ma5"), "value_ma5")


@query("stream_ema", """
with recursive e as (select event_type as t, cast(user_id as varchar) as u, day(ts) as gw, round(value - 10, 6) as residual from events),
k as (select 'player' as kind, u as key, gw, avg(residual) as m from e group by 1, 2, 3 union all select 'position', t, gw, avg(residual) from e group by 1, 2, 3),
n as (select *, row_number() over (partition by kind, key order by gw) as i from k),
f as (select kind, key, i, gw, 0.15 * m as bias from n where i = 1
  union all select n.kind, n.key, n.i, n.gw, 0.85 * f.bias + 0.15 * n.m from f join n on n.kind = f.kind and n.key = f.key and n.i = f.i + 1)
select kind, key, round(bias, 6) as bias, gw as last_gw from f qualify row_number() over (partition by kind, key order by i desc) = 1""")
def stream_ema(spark, sf):
    residuals = event_stream(spark, sf).select(
        F.lit("2023-24").alias("season_name"), F.dayofmonth("ts").alias("gw"), F.round(F.col("value") - 10, 6).alias("residual"),
        "user_id", "event_type",
    )
    out = run_ema(residuals, scratch(spark, "ema"), {"player": "user_id", "position": "event_type"})
    return rounded(out, "bias").select("kind", "key", "bias", "last_gw")
