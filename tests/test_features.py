"""The feature plan on small domain fixtures."""

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import seasons
from rosterlake.operators import joins
from rosterlake.plans import features

HIST = ("player_id long, season_name string, round int, fixture int, kickoff_time string, total_points double, minutes int, "
        "was_home boolean, team int, opponent_team int, team_h_score int, team_a_score int, value int")


def match(player, round_, points, team=1, season="2025-26", fixture=None, home=None, h=None, a=None, value=75, minutes=90):
    home = team == 1 if home is None else home
    h, a = (2, 0) if h is None and home else (0, 2) if h is None else (h, a)
    year = int(season[:4]) + (1 if round_ > 20 else 0)
    return (player, season, round_, fixture or round_, f"{year}-08-{(round_ % 28) + 1:02d}T15:00:00Z", float(points), minutes,
            home, team, 3 - team, h, a, value)


@pytest.fixture
def elements(spark):
    return spark.createDataFrame(
        [(1, 1001, "Player One", 1, 3, 7.5, 6.4), (2, 1002, "Player Two", 2, 4, 8.0, 2.1)],
        "player_id long, code long, full_name string, team_id int, element_type int, now_cost_millions double, official_ep_next double",
    )


@pytest.fixture
def teams(spark):
    return spark.createDataFrame([(1, "Alpha", "ALP"), (2, "Beta", "BET")], "team_id int, name string, short_name string")


def fixtures(spark, rows):
    return spark.createDataFrame(rows, "id int, event int, team_h int, team_a int, team_h_difficulty int, team_a_difficulty int")


def prepared(spark, elements, rows):
    return features.prepare_history(spark.createDataFrame(rows, HIST), elements)


def test_training_rows_hold_only_earlier_matches(spark, elements):
    p = prepared(spark, elements, [match(1, r, r * 2) for r in range(1, 7)])
    rows = {r["round"]: r for r in features.training_frame(p, 5).collect()}
    assert sorted(rows) == [4, 5]  # three earlier matches needed; round 6 is not final
    assert rows[4]["total_points_ma5"] == pytest.approx((2 + 4 + 6) / 3)
    assert rows[5]["total_points_lag1"] == 8.0 and rows[5]["minutes_share_ma5"] == 1.0


def test_windows_restart_each_season(spark, elements):
    p = prepared(spark, elements, [match(1, r, 9, season="2024-25") for r in range(1, 6)] + [match(1, r, 1) for r in range(1, 6)])
    row = [r for r in features.training_frame(p, 38).collect() if r["season_name"] == "2025-26" and r["round"] == 4][0]
    assert row["total_points_ma5"] == 1.0


def test_team_form_counts_a_match_once(spark, elements):
    rows = [match(1, 1, 1), match(3, 1, 1), match(1, 2, 1, h=1, a=1), match(3, 2, 1, h=1, a=1)]
    out = features.add_team_context(prepared(spark, elements, rows)).filter("round = 2").collect()
    assert [r["team_goals_for_ma5"] for r in out] == [2.0, 2.0]


def test_later_rows_change_nothing(spark, elements, teams):
    known = [match(1, r, r) for r in range(1, 5)] + [match(2, r, 1, team=2) for r in range(1, 5)]
    # (the price of the target round itself is known on entering it)
    later = known + [match(1, r, 50) for r in range(5, 9)] + [match(1, 1, 70, season="2026-27")]
    fx = fixtures(spark, [(5, 5, 1, 2, 2, 4)])
    frames = [
        features.target_frame(prepared(spark, elements, rows), elements, teams, fx, 6, 4, "2025-26").orderBy("player_id").collect()
        for rows in (known, later)
    ]
    assert frames[0] == frames[1]


def test_target_row_includes_the_last_match(spark, elements, teams):
    p = prepared(spark, elements, [match(1, r, r) for r in range(1, 5)])
    fx = fixtures(spark, [(5, 5, 1, 2, 2, 4)])
    for mode, lag in (("target_row", 4.0), ("latest_row", 3.0)):
        row = features.target_frame(p, elements, teams, fx, 5, 4, mode=mode).filter("player_id = 1").first()
        assert row["total_points_lag1"] == lag
    assert row["was_home"] == 1.0 and row["fixture_difficulty"] == 2.0 and row["history_match_count"] == 4


def test_cold_player_has_zero_features(spark, elements, teams):
    p = prepared(spark, elements, [match(1, r, r) for r in range(1, 5)])
    row = features.target_frame(p, elements, teams, fixtures(spark, [(5, 5, 1, 2, 2, 4)]), 5, 4).filter("player_id = 2").first()
    assert row["total_points_ma5"] == 0.0 and row["history_match_count"] == 0
    assert row["opp_team_goals_for_ma5"] == 2.0 and row["position_fwd"] == 1.0


def test_older_season_is_the_fallback(spark, elements, teams):
    rows = [match(1, r, 3) for r in range(1, 4)] + [match(2, r, 8, team=2, season="2024-25") for r in range(30, 36)]
    row = features.target_frame(prepared(spark, elements, rows), elements, teams, fixtures(spark, [(5, 5, 1, 2, 2, 4)]), 4, 3).filter(
        "player_id = 2"
    ).first()
    assert row["total_points_ma5"] == 8.0


def test_replay_takes_the_price_of_the_round(spark, elements, teams):
    p = prepared(spark, elements, [match(1, r, r, value=70 + r) for r in range(1, 7)])
    row = features.target_frame(p, elements, teams, fixtures(spark, [(5, 5, 1, 2, 2, 4)]), 5, 4).filter("player_id = 1").first()
    assert row["now_cost_millions"] == 7.5


def test_double_round_averages_its_fixtures(spark, elements, teams):
    p = prepared(spark, elements, [match(1, r, r) for r in range(1, 5)] + [match(2, r, r, team=2) for r in range(1, 5)])
    fx = fixtures(spark, [(5, 5, 1, 2, 2, 4), (6, 5, 2, 1, 5, None)])
    row = features.target_context(p, fx, 5, 4).filter("team_id = 1").first()
    assert (row["fixture_count"], row["was_home"], row["fixture_difficulty"]) == (2, 0.5, 2.5)


def test_forecast_is_gated(spark, elements):
    assert features.gate_forecast(elements, 8, 7).filter("official_ep_next is not null").count() == 0
    assert features.gate_forecast(elements, 7, 7).filter("official_ep_next is not null").count() == 2


def test_blank_round_counts_zero_and_empty_round_one(spark, elements):
    fx = fixtures(spark, [(7, 7, 1, 3, 2, 2)])
    got = {r["player_id"]: r["fixture_multiplier"] for r in joins.round_multiplier(elements, fx).collect()}
    assert got == {1: 1.0, 2: 0.0}
    none = joins.round_multiplier(elements, fx.filter("event = 9"), ["now_cost_millions"]).collect()
    assert [r["fixture_multiplier"] for r in none] == [1.0, 1.0] and none[0]["now_cost_millions"] > 0


def test_code_remap(spark, elements):
    archive = spark.createDataFrame([(777, 1001, "2025-26", 4), (888, 9999, "2025-26", 2)],
                                    "player_id long, player_code long, season_name string, element_type int")
    rows = joins.remap_by_code(archive, elements).collect()
    assert [(r["player_id"], r["element_type"], r["current_element_type"], r["position_changed"]) for r in rows] == [(1, 4, 3, True)]


def test_provisional_round_is_not_final(spark):
    events = spark.createDataFrame(
        [(1, True, True, False, "2025-08-15T17:30:00Z"), (2, True, False, False, "2025-08-22T17:30:00Z"), (3, False, False, True, None)],
        "id int, finished boolean, data_checked boolean, is_next boolean, deadline_time string",
    )
    bounds = seasons.round_bounds(events)
    assert tuple(bounds.first()) == (3, 1)
    assert seasons.infer_season(events).first()[0] == "2025-26"
    published = spark.createDataFrame([(1,), (2,), (4,)], "gameweek int")
    assert seasons.choose_round(published, bounds).first()[0] == 2


def test_season_helpers(spark):
    row = spark.range(1).select(
        seasons.season_for_date(F.lit("2026-06-30").cast("date")).alias("a"), seasons.season_for_date(F.lit("2026-07-01").cast("date")).alias("b"),
        seasons.previous_season(F.lit("2000-01")).alias("c"), seasons.season_start_year(F.lit("n/a")).alias("d"),
    ).first()
    assert tuple(row) == ("2025-26", "2026-27", "1999-00", None)


def panel_rows():
    return [match(p, r, p * r % 7, season=s, fixture=100 * p + r) for p in (1, 2, 3) for s in ("2024-25", "2025-26") for r in range(1, 4 + p)]


def test_a_panel_in_pieces_is_not_shuffled_again(spark, elements):
    hist = spark.createDataFrame(panel_rows(), HIST)
    assert features.player_pieces(hist) == 1
    p = features.laid_out(features.prepare_history(hist, elements, pieces=3), 3)
    for frame in (features.player_form(p, 3, "2025-26"), features.entry_prices(p, 2, "2025-26"), features.as_of(p, 3, "2025-26").groupBy("player_id").count()):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    plain = features.laid_out(features.prepare_history(hist, elements))
    assert sorted(map(str, p.collect())) == sorted(map(str, plain.collect()))
    assert "panel" not in " ".join(t.name for t in spark.catalog.listTables())


def test_a_panel_in_pieces_gives_the_same_target_frame(spark, elements, teams):
    hist, fx = spark.createDataFrame(panel_rows(), HIST), fixtures(spark, [(5, 5, 1, 2, 2, 4)])
    frames = [
        features.target_frame(features.laid_out(features.prepare_history(hist, elements, pieces=n), n), elements, teams, fx, 5, 4).orderBy("player_id").collect()
        for n in (None, 3)
    ]
    assert frames[0] == frames[1] and [r["history_match_count"] for r in frames[0]] == [8, 9]


def test_form_of_a_player_is_read_once(spark, elements):
    p = features.prepare_history(spark.createDataFrame(panel_rows(), HIST), elements)
    out = features.player_form(p, 4, "2025-26")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("row_number() windowspecdefinition") == 1
    row = out.filter("player_id = 3").first()  # rounds 1 to 4 are known; those of 2024-25 do not count
    assert row["total_points_lag1"] == 5.0 and row["total_points_ma5"] == (3 + 6 + 2 + 5) / 4


def test_a_player_with_too_many_rows_is_not_one_piece(spark, elements, teams, hot):
    hist = spark.createDataFrame(panel_rows(), HIST)
    assert features.player_pieces(hist) is None
