"""Scores, bands, residuals, state and scenario draws."""

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import aggregates, scenario
from rosterlake.plans import scoring, state


def long(spark, rows):
    return spark.createDataFrame(rows, "player_id long, model string, expected_points_raw double, expected_points double, p_start double, p_appear double")


def test_ensemble_does_not_reapply_corrections(spark):
    out = scoring.ensemble(long(spark, [(1, "a", 0.0, 0.1, 0.5, 0.6), (1, "b", 0.2, 0.3, 0.7, 0.8)]), ["player_id"]).first()
    assert out["expected_points_raw"] == pytest.approx(0.1) and out["expected_points"] == pytest.approx(0.2)
    assert out["start_probability"] == pytest.approx(0.6) and out["model_std"] == pytest.approx(0.1)


def test_blend_is_bounded_and_optional(spark):
    df = spark.createDataFrame([(1, 8.0, "4.0"), (2, 4.0, None)], "player_id long, expected_points double, official_ep_next string")
    rows = scoring.blend_outside(df).orderBy("player_id").collect()
    assert rows[0]["expected_points"] == pytest.approx(6.6) and rows[1]["expected_points"] == 4.0
    assert [r["official_ep_blend_weight"] for r in rows] == [0.35, 0.0]
    with pytest.raises(ValueError):
        scoring.blend_outside(df, 1.5)


def test_expected_value_zero_points_for_a_non_starter(spark):
    made = scoring.expected_value(F.lit(0.8), F.lit(0.9), F.lit(5.0), F.lit(1.0), F.lit(1.0), F.lit(0.5))
    row = spark.range(1).select(*[c.alias(n) for n, c in made.items()]).first()
    assert row["expected_points_raw"] == pytest.approx(4.1) and row["expected_points"] == pytest.approx(4.5)


def test_confidence_falls_with_doubt(spark):
    df = spark.createDataFrame(
        [(1, 5.0, 0.95, 0.1, 2, 1.0, 1.0), (2, 5.0, 0.5, 2.0, 2, 0.0, 0.25)],
        "player_id long, expected_points double, start_probability double, model_std double, model_count int, reliability_weight double, availability_next_round double",
    )
    sure, doubtful = scoring.add_confidence(df).orderBy("player_id").collect()
    assert sure["confidence_level"] == "High" and doubtful["confidence_level"] == "Low"
    assert sure["expected_points_lower_80"] > doubtful["expected_points_lower_80"]
    assert sure["expected_points_lower_80"] < 5.0 < sure["expected_points_upper_80"]


def test_residual_of_the_current_season_only(spark):
    hist = spark.createDataFrame([(1, "2025-26", 1, 1.0, None), (1, "2026-27", 1, 7.0, None)],
                                 "player_id long, season_name string, round int, total_points double, element_type int")
    scored = spark.createDataFrame([(1, 1.0, 1.0, 4.0)], "player_id long, p_start double, p_appear double, points_hat double")
    elements = spark.createDataFrame([(1, 3)], "player_id long, element_type int")
    cameo = spark.createDataFrame([(3, 1.0)], "element_type int, cameo_points double")
    rows = state.residuals(hist, scored, elements, cameo, 1, "2026-27").collect()
    assert [(r["residual"], r["element_type"]) for r in rows] == [(3.0, 3)]


def empty_state(spark):
    return spark.createDataFrame([], "season_name string, kind string, key string, bias double, last_gw int")


def test_replay_equals_round_by_round_updates(spark):
    rows = [(1, 3, 2.0, 1), (1, 3, 4.0, 1), (2, 3, -1.0, 1), (1, 3, 6.0, 2), (2, 4, 0.5, 3), (1, 3, -2.0, 3)]
    found = spark.createDataFrame(rows, "player_id long, element_type int, residual double, gw int")
    step = empty_state(spark)
    for gw in (1, 2, 3):
        step = state.update_state(step, found.filter(F.col("gw") == gw), "2026-27")
    want = {(r["kind"], r["key"]): r["bias"] for r in step.collect()}
    got = {(r["kind"], r["key"]): r["bias"] for r in state.replay_state(found.withColumn("season_name", F.lit("2026-27"))).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert want[("player", "1")] == pytest.approx(0.85 * (0.85 * 0.45 + 0.9) - 0.3)


def test_state_of_another_season_is_empty(spark):
    old = spark.createDataFrame([("2025-26", "player", "1", 5.0, 30)], "season_name string, kind string, key string, bias double, last_gw int")
    found = spark.createDataFrame([(1, 3, 1.0, 1)], "player_id long, element_type int, residual double, gw int")
    got = {(r["kind"], r["key"]): (r["bias"], r["last_gw"]) for r in state.update_state(old, found, "2026-27").collect()}
    assert got[("player", "1")] == (pytest.approx(0.15), 1)


def test_refresh_rounds_stop_at_the_season_end(spark):
    df = spark.createDataFrame([(1,), (36,), (39,)], "n int").select("n", state.refresh_rounds(F.col("n"), 5).alias("r"))
    assert {r["n"]: r["r"] for r in df.collect()} == {1: [1, 2, 3, 4, 5], 36: [36, 37, 38], 39: []}


def test_cameo_fallbacks(spark):
    df = spark.createDataFrame([(1, 30, 2.0), (2, 90, 9.0), (2, 10, 4.0)], "pos int, minutes int, pts double")
    got = {r["pos"]: r["cameo_points"] for r in aggregates.conditional_means(df, "pos", [1, 2, 3], "pts", F.col("minutes").between(1, 59)).collect()}
    assert got == {1: 2.0, 2: 4.0, 3: 3.0}
    none = aggregates.conditional_means(df, "pos", [1], "pts", F.lit(False)).first()
    assert none["cameo_points"] == 1.0


def test_past_rounds_move_forecasts_and_keep_absences(spark):
    forecasts = spark.createDataFrame([(1, 5.0), (2, 1.0)], "player_id long, expected_points double")
    history = spark.createDataFrame([(1, 1, 2.0, 90), (1, 2, 8.0, 20), (2, 2, 9.0, 90)], "player_id long, gameweek int, pts double, minutes int")
    rows = scenario.scenarios(forecasts, history, ["player_id"], "gameweek", ["pts", "minutes"])
    means = history.groupBy("player_id").agg(F.avg("pts").alias("mean"))
    moved = {(r.player_id, r.scenario_id): r.scenario_points for r in scenario.moved_scores(rows, "pts", means, ["player_id"], "mean").collect()}
    assert moved == {(1, 1): 2.0, (1, 2): 8.0, (2, 1): 1.0, (2, 2): 1.0}
    lived = {(r.player_id, r.scenario_id): (r.outcome, r.points) for r in scenario.outcomes(rows, "pts", F.col("minutes") >= 60).collect()}
    assert lived == {(1, 1): ("starts", 2.0), (1, 2): ("cameo", 8.0), (2, 1): ("absent", 0.0), (2, 2): ("starts", 9.0)}
