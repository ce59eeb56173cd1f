"""Streams and their batch twins agree, however the input is cut into batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlake.operators import panel
from rosterlake.plans import state
from rosterlake.streaming.ema import run_ema
from rosterlake.streaming.form import RunningForm
from rosterlake.streaming.ema import round_sums
from rosterlake.streaming.ingest import DedupIngest, FinalityGate
from rosterlake.streaming.sinks import read_files, scratch

SCHEMA = "season_name string, gw int, player_id long, element_type int, residual double"


@pytest.fixture
def landed(spark, tmp_path):
    """Residuals in six files, in time order, cut in the middle of rounds; a new season at the end."""
    rng = np.random.default_rng(3)
    n = 240
    pdf = pd.DataFrame({
        "season_name": ["2024-25"] * 180 + ["2025-26"] * 60, "gw": [i // 16 + 1 for i in range(180)] + [i // 16 + 1 for i in range(60)],
        "player_id": np.where(rng.random(n) < 0.34, 1, rng.integers(2, 8, n)), "element_type": rng.integers(1, 5, n), "residual": rng.normal(0, 3, n).round(3),
    })
    for i in range(6):
        part = spark.createDataFrame(pdf.iloc[i * 40:(i + 1) * 40]).select(
            "season_name", F.col("gw").cast("int").alias("gw"), "player_id", F.col("element_type").cast("int").alias("element_type"), "residual"
        )
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return pdf, str(tmp_path / "in")


def test_ema_stream_equals_the_replay(spark, landed):
    pdf, folder = landed
    schema = spark.createDataFrame([], SCHEMA).schema
    out = run_ema(read_files(spark, folder, schema, 1), scratch(spark, "t-ema"))
    got = {(r["kind"], r["key"]): (r["season_name"], r["bias"]) for r in out.collect()}
    twin = {(r["season_name"], r["kind"], r["key"]): r["bias"] for r in state.replay_state(spark.createDataFrame(pdf)).collect()}
    for (kind, key), (season, bias) in got.items():
        assert bias == pytest.approx(twin[(season, kind, key)])
        assert season == max(s for s, k, v in twin if (k, v) == (kind, key))
    assert len(got) == len({(k, v) for _, k, v in twin})


@pytest.mark.parametrize("limit", [None, "3"])
def test_running_form_equals_the_batch(spark, tmp_path, limit):
    from rosterlake.session import MAX_GROUP_ROWS

    rows = spark.range(120).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("k"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    for i in range(4):
        rows.filter((F.col("id") >= i * 30) & (F.col("id") < (i + 1) * 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    if limit:
        spark.conf.set(MAX_GROUP_ROWS, limit)
    try:
        form = RunningForm(spark, scratch(spark, "t-form"), rows.schema, ["k"], ["id"], "v")
        form.run(read_files(spark, str(tmp_path / "in"), rows.schema, 1))
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
    got = {r["id"]: r["v_ma5"] for r in form.rows().collect()}
    want = {r["id"]: r["v_ma5"] for r in panel.form(rows, ["k"], ["id"], ["v"], lags=False).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == (None if want[i] is None else pytest.approx(want[i]))
    # an entity leaves one row a batch for the state, and no batch writes entities that it does not hold
    tails = form.tails.all()
    assert tails.count() == tails.select("k", "batch").distinct().count() == 4 * 5


def test_running_form_with_nulls_and_a_second_run(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, None if i % 3 == 0 else float(i)) for i in range(24)], "id long, k int, v double")
    form = RunningForm(spark, scratch(spark, "t-form"), rows.schema, ["k"], ["id"], "v", 3)
    for i in range(3):
        rows.filter((F.col("id") >= i * 8) & (F.col("id") < (i + 1) * 8)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        form.run(read_files(spark, str(tmp_path / "in"), rows.schema))
    got = {r["id"]: r["v_ma3"] for r in form.rows().collect()}
    want = {r["id"]: r["v_ma3"] for r in panel.form(rows, ["k"], ["id"], ["v"], (3,), lags=False).collect()}
    assert got == {i: None if v is None else pytest.approx(v) for i, v in want.items()}


def test_ema_does_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rows = [("2024-25", gw, 1 if n % 3 else 2, 1, float(gw * n % 7)) for gw in range(1, 7) for n in range(6)]
    biases = []
    for name, order in (("rising", rows), ("falling", rows[::-1])):
        for i in range(4):
            spark.createDataFrame(order[i * 9 : (i + 1) * 9], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        out = run_ema(read_files(spark, str(tmp_path / name), spark.createDataFrame([], SCHEMA).schema, 1), scratch(spark, "t-ema"), files_per_batch=1)
        biases.append({(r["kind"], r["key"]): pytest.approx(r["bias"]) for r in out.collect()})
    assert biases[0] == biases[1] and len(biases[0]) == 3


def test_a_hot_key_reaches_the_state_as_one_row_a_round(spark):
    rows = spark.range(3_000).select(F.lit("2024-25").alias("season_name"), (F.col("id") % 2).cast("int").alias("gw"), (F.col("id") % 1_000).alias("player_id"), F.lit(4).alias("element_type"), F.lit(1.0).alias("residual"))
    sums = round_sums(rows)
    assert sums.filter("kind = 'position'").count() == 2
    assert sums.filter("kind = 'position'").agg(F.sum("n")).first()[0] == 3_000


def test_gate_releases_on_the_flip_and_writes_arrivals_once(spark, tmp_path):
    rows = spark.range(20).select("id", (F.col("id") % 2 + 1).cast("int").alias("gw"))
    flags = {"checked": False}

    def rounds():
        return spark.createDataFrame([(1, True, True), (2, True, flags["checked"])], "id int, finished boolean, data_checked boolean")

    gate = FinalityGate(spark, scratch(spark, "t-gate"), rows.schema, "gw", rounds)
    gate(rows.filter("id < 10"), 0)
    assert gate.released().count() == 5 and gate.waiting().count() == 5
    gate(rows.filter("id < 10"), 0)  # a repeated batch replaces itself
    gate(rows.filter("id >= 10"), 1)
    assert gate.log.of(1).count() == 10 and gate.released().count() == 10 and gate.released(1).count() == 5
    flags["checked"] = True
    gate(rows.limit(0), 2)
    assert gate.log.of(2).count() == 0 and gate.log.all().count() == 20
    assert sorted(r["id"] for r in gate.released().collect()) == list(range(20)) and gate.released(2).count() == 10
    assert gate.waiting().count() == 0
    gate(rows.limit(0), 2)  # and a repeated flip too
    assert gate.markers.all().count() == 2
    late = spark.createDataFrame([(20, 2), (21, None), (22, 3)], "id long, gw int")
    gate(late, 3)
    assert [r["id"] for r in gate.released(3).collect()] == [20] and gate.waiting().count() == 2


def test_no_first_arrival_is_lost_in_falling_order(spark, tmp_path):
    schema = "key long, ts timestamp, note string"
    rows = spark.range(15).select(F.col("id").alias("key"), F.timestamp_seconds(F.col("id") * 7_200).alias("ts"), F.lit("x").alias("note"))
    ingest = DedupIngest(spark, scratch(spark, "t-dedup"), "ts", ["key"], 3_600, buckets=4)
    for low in (10, 5, 0):  # one file a batch, the newest first
        rows.filter((F.col("key") >= low) & (F.col("key") < low + 5)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.run(read_files(spark, f"{tmp_path}/in", rows.schema, 1), 1)
    out = ingest.rows().collect()
    assert sorted(r["key"] for r in out) == list(range(15))
    assert sorted(r["key"] for r in out if r["late"]) == list(range(10))
    # copies of late rows, of forgotten ones and of new ones; a row without event time, twice
    more = rows.union(rows.filter("key < 3")).union(spark.createDataFrame([(99, None, "y"), (99, None, "y")], schema))
    more.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.run(read_files(spark, f"{tmp_path}/in", rows.schema, 1), 1)
    assert sorted(r["key"] for r in ingest.rows().collect()) == [*range(15), 99]
    counted = ingest.counts().agg(F.sum("n_on_time"), F.sum("n_late_new"), F.sum("n_late")).first()
    assert counted[0] == 5 and counted[1] == 11 and counted[2] >= 11


def test_dedup_keeps_one_row_per_key(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 20).alias("key"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest = DedupIngest(spark, scratch(spark, "t-dedup"), "ts", ["key"], 3_600, buckets=4)
    ingest.run(read_files(spark, str(tmp_path / "in"), rows.schema, 1), 1)
    out = ingest.rows()
    assert out.count() == out.select("key").distinct().count() == 20
    assert ingest.counts().agg(F.sum("n_late")).first()[0] == 0


@pytest.mark.parametrize("name", ["stream_dedup", "stream_dedup_late", "finality_gate", "stream_form", "stream_ema"])
def test_stream_queries_on_a_folder_of_files(spark, tmp_path, name):
    import __spark_entry__ as driver
    from tests.compare import canonical, differences, duck

    source = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(source).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    df = driver.queries()[name](spark, str(tmp_path))
    cursor = duck("/root/testdata/sf0.001").execute(driver.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert not differences(canonical([tuple(r) for r in df.collect()], df.columns), canonical(cursor.fetchall(), columns))[:3]
