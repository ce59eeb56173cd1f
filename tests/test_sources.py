"""Landed documents and the prediction store."""

import json

import pytest
from pyspark.sql import functions as F

from rosterlake.constants import CHIP_NAMES, EXPECTED_SCORING
from rosterlake.operators import quality
from rosterlake.sources import history, landed, predictions as store
from rosterlake.sources.archive import RoundArchive, migrate


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def row(fixture, points, **extra):
    return {"element": 1, "fixture": fixture, "round": fixture, "total_points": points, "minutes": 90, "was_home": True,
            "kickoff_time": "2026-08-16T14:00:00Z", "influence": "12.5", "expected_goals": "bad", "value": 75, **extra}


def test_histories_by_file_name_and_roster(spark, tmp_path):
    for name in ("player_1", "player_2", "player_999", "player_invalid", "bootstrap-static"):
        write(tmp_path / f"{name}.json", {"history": [] if name == "player_2" else [row(1, 5), row(2, 3, season_name="2025-26")]})
    roster = spark.createDataFrame([(1,), (2,)], "player_id long")
    rows = landed.player_histories(spark, str(tmp_path), roster, "2026-27").orderBy("fixture").collect()
    assert [(r["player_id"], r["total_points"], r["season_name"]) for r in rows] == [(1, 5.0, "2026-27"), (1, 3.0, "2025-26")]
    assert rows[0]["influence"] == 12.5 and rows[0]["expected_goals"] is None


def test_histories_as_lines_that_name_their_documents(spark, tmp_path):
    docs = [{"doc": f"player_{k}.json", "history": [row(1, 5), row(2, 3, season_name="2025-26")]} for k in (1, 999, "invalid")]
    docs += [{"doc": "player_1.json", "history": [row(3, 2)]}, {"history": [row(4, 1)]}]
    write(tmp_path / "part-0.json", "\n".join(map(json.dumps, docs)))
    roster = spark.createDataFrame([(1,), (2,)], "player_id long")
    rows = landed.player_histories(spark, str(tmp_path), roster, "2026-27", lines=True).orderBy("fixture").collect()
    assert [(r["player_id"], r["total_points"], r["season_name"]) for r in rows] == [(1, 5.0, "2026-27"), (1, 3.0, "2025-26"), (1, 2.0, "2026-27")]
    assert rows[0]["influence"] == 12.5 and rows[0]["expected_goals"] is None


def test_landed_histories_write_no_file_per_player(spark, tmp_path, monkeypatch):
    from rosterlake.catalog import landings

    lines = [(k, k % 100, 1, 3.0, 0.05, "2020-01-02") for k in range(400)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_shipdate string").withColumn(
        "l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, 1.0) for k in range(100)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(landings, "scratch", lambda _, name: str(tmp_path / name))
    assert landings.landed_histories(spark, str(tmp_path)).count() == 400
    assert len(list((tmp_path / "histories").rglob("part-*"))) < 50


def bootstrap(**rules):
    limits = {"GKP": (2, 1, 1), "DEF": (5, 3, 5), "MID": (5, 2, 5), "FWD": (3, 1, 3)}
    return {
        "elements": [{"id": 1, "code": 1001, "first_name": "Player", "second_name": "One", "team": 1, "element_type": 3, "now_cost": 75},
                     {"id": 2, "code": 1002, "first_name": "Player", "second_name": None, "team": 2, "element_type": 4, "now_cost": 80}],
        "teams": [{"id": 1, "name": "Alpha", "short_name": "ALP"}], "events": [{"id": 1, "finished": True, "is_next": False}],
        "element_types": [{"id": i + 1, "singular_name_short": n, "squad_select": v[0], "squad_min_play": v[1], "squad_max_play": v[2]}
                          for i, (n, v) in enumerate(limits.items())],
        "chips": [{"name": n, "number": 1, "start_event": (2 if n == "freehit" else 1) if half == 0 else 20, "stop_event": 19 if half == 0 else 38}
                  for n in CHIP_NAMES for half in (0, 1)],
        "game_config": {"rules": {"squad_squadplay": 11, "squad_squadsize": 15, "squad_team_limit": 3, "squad_total_spend": 1000,
                                  "ui_currency_multiplier": 10, "max_extra_free_transfers": 4, "transfers_cap": 20, **rules},
                        "scoring": EXPECTED_SCORING},
    }


def test_bootstrap_projections_and_rules(spark, tmp_path):
    write(tmp_path / "b.json", bootstrap())
    b = landed.Bootstrap(spark, str(tmp_path / "b.json"))
    names = {r["player_id"]: (r["full_name"], r["now_cost_millions"]) for r in b.elements.collect()}
    assert names == {1: ("Player One", 7.5), 2: (None, 8.0)}
    assert b.teams.first()["team_id"] == 1 and b.events.count() == 1 and b.positions.count() == 4 and b.chips.count() == 8
    assert landed.live_rule_drift(b).collect() == []


def test_rule_drift_is_reported(spark, tmp_path):
    doc = bootstrap(squad_team_limit=4)
    doc["game_config"]["scoring"] = {**EXPECTED_SCORING, "goals_scored": {**EXPECTED_SCORING["goals_scored"], "DEF": 7}}
    write(tmp_path / "b.json", doc)
    found = landed.live_rule_drift(landed.Bootstrap(spark, str(tmp_path / "b.json")))
    assert {(r["path"], r["position"], r["actual"], r["expected"]) for r in found.collect()} == {
        ("max_per_team", None, 4, 3), ("scoring.goals_scored", "DEF", 7, 6)}


def test_archive_season_with_two_headers(spark, tmp_path):
    s = tmp_path / "2025-26"
    write(s / "teams.csv", "id,name,code\n1,Alpha,3\n2,Beta,4\n")
    write(s / "players_raw.csv", "code,id,web_name\n999001,77,X\n999002,78,Y\n")
    write(s / "fixtures.csv", "id,event,team_h,team_a,team_h_difficulty,team_a_difficulty\n5,1,1,2,2,4\n6,2,2,1,3,5\n")
    write(s / "gws/gw1.csv", "element,name,position,team,round,fixture,total_points,minutes,was_home,xP\n77,Player,DEF,Alpha,1,5,6,90,True,3.7\n")
    write(s / "gws/gw2.csv", "name,element,position,round,team,fixture,total_points,minutes,was_home,xP,tackles\nPlayer,77,DEF,2,Alpha,6,2,90,maybe,1.5,4\n")
    one, two = landed.archive_histories(spark, str(tmp_path), ["2025-26"]).orderBy("round").collect()
    assert (one["player_code"], one["element_type"], one["official_expected_points"], one["fixture_difficulty"]) == (999001, 2, 3.7, 2.0)
    assert one["team"] == 1 and one["recoveries"] == 0.0 and one["season_name"] == "2025-26"
    assert two["was_home"] is None and two["tackles"] == 4.0 and two["total_points"] == 2.0


def test_archive_seasons_with_their_own_columns(spark, tmp_path):
    """Quotes, a byte order mark, blank and short lines, a season that lacks what another has, one that is not there."""
    for season, head, lines in (
        ("2023-24", "\ufeffelement,name,position,team,round,fixture,total_points,was_home,xP",
         ['7,"Last, First",MID,"Alpha ""A""",1,5,6,True,3.5', "", '8,"Back\\"slash",gk,Beta,,5,,no,']),
        ("2024-25", "player_id,round,fixture,total_points,was_home,element_type,fixture_difficulty,tackles,starts",
         ["7,2,5,4,False,4,1.5,9,1", "9,3,6,1,maybe,2"]),
    ):
        s = tmp_path / season
        write(s / "teams.csv", 'name,id\n"Alpha ""A""",1\nBeta,2\n' if season == "2023-24" else "id,code,name\n3,1,Beta\n")
        write(s / "players_raw.csv", "id,code\n7,1007\n8,1008\n9,1009\n7,9999\n")
        write(s / "fixtures.csv", "id,team_a_difficulty,team_h_difficulty\n5,4,2\n6,,5\n")
        write(s / "gws/gw1.csv", "\n".join([head, *lines, head]) + "\n")
    with pytest.warns(UserWarning, match="1901-02"):
        rows = landed.archive_histories(spark, str(tmp_path), ["2023-24", "2024-25", "1901-02"]).collect()
    got = {(r.season_name, r.player_id): r for r in rows}
    a, b, c, d = (got[k] for k in (("2023-24", 7), ("2023-24", 8), ("2024-25", 7), ("2024-25", 9)))
    assert len(rows) == 4 and {r.player_code for r in rows} == {1007, 1008, 1009}
    assert (a["name"], a.team, a.element_type, a.official_expected_points, a.fixture_difficulty, a.tackles) == ("Last, First", 1, 3, 3.5, 2.0, 0.0)
    assert (b["name"], b.team, b.element_type, b["round"], b.total_points, b.was_home) == ('Back"slash', 2, 1, 0, None, None)
    assert (c.element_type, c.fixture_difficulty, c.tackles, c.starts, c.official_expected_points, c.team) == (4, 1.5, 9.0, 1.0, None, None)
    assert (d.element_type, d.tackles, d.starts, d.recoveries, d.fixture_difficulty) == (2, None, None, 0.0, None)
    with pytest.raises(ValueError, match="1901-02"):
        landed.archive_histories(spark, str(tmp_path), ["2023-24", "1901-02"], strict=True)


def test_scoring_of_any_shape(spark):
    docs = spark.createDataFrame([(1, '{"a": 3, "b": {"GK": 1, "DEF": -2, "X": null}, "c": "text", "d": [1], "e": 2.0, "f": {}}'), (2, "[1]"), (3, None), (4, "{}")], "id int, j string")
    rows = landed.scoring_rows(docs.select("id", F.try_parse_json("j").alias("v")), "v", "id").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        (1, "scoring.a", None, 3), (1, "scoring.b", "GK", 1), (1, "scoring.b", "DEF", -2), (1, "scoring.b", "X", None), (1, "scoring.c", None, None),
        (1, "scoring.d", None, None), (1, "scoring.e", None, 2)], key=str)


def test_live_rows_win_over_the_archive(spark):
    schema = "player_id long, fixture int, round int, season_name string, total_points double"
    live = spark.createDataFrame([(1, 1, 1, "2025-26", 5.0)], schema)
    archive = spark.createDataFrame([(1, 1, 1, "2025-26", 4.0), (1, 2, 2, "2025-26", 3.0)], schema).withColumn("extra", F.lit(1))
    rows = landed.merge_histories(live, archive).orderBy("fixture").collect()
    assert [(r["total_points"], r["extra"]) for r in rows] == [(5.0, None), (3.0, 1)]


def test_team_file_picks_standings_fixtures(spark, tmp_path):
    write(tmp_path / "team.csv", "full_name,player_id,captain\nA,1,1\nB,2,x\nC,,0\n")
    rows = landed.team_csv(spark, str(tmp_path / "team.csv")).orderBy("player_id").collect()
    assert [(r["player_id"], r["captain"], r["starting"]) for r in rows] == [(1, 1, 0), (2, 0, 0)]
    write(tmp_path / "bad.csv", "name\nA\n")
    with pytest.raises(ValueError):
        landed.team_csv(spark, str(tmp_path / "bad.csv"))
    write(tmp_path / "picks.json", {"picks": [{"element": 9, "position": 11, "multiplier": 2, "is_captain": True, "is_vice_captain": False},
                                              {"element": 8, "position": 12, "multiplier": 0, "is_captain": False, "is_vice_captain": False}]})
    p = {r["player_id"]: (r["starting"], r["bench"], r["captain"], r["multiplier"]) for r in landed.picks(spark, str(tmp_path / "picks.json")).collect()}
    assert p == {9: (1, 0, 1, 2), 8: (0, 1, 0, 0)}
    for page in (1, 2):
        write(tmp_path / f"league/{page}.json", {"league": {"id": 3}, "standings": {"has_next": page == 1, "page": page, "results": [{"entry": page, "total": 10}]}})
    assert sorted(r["entry"] for r in landed.standings(spark, str(tmp_path / "league")).collect()) == [1, 2]
    write(tmp_path / "fx.json", [{"id": 5, "event": None, "team_h": 1, "team_a": 2}])
    assert landed.fixtures(spark, str(tmp_path / "fx.json")).first()["event"] is None


def test_double_round_points(spark):
    hist = spark.createDataFrame([(1, 3, 10, "b", 2.0), (1, 3, 9, "a", 5.0)], "player_id long, round int, fixture int, kickoff_time string, total_points double")
    assert landed.actual_points(hist, 3).first()["actual_points"] == 7.0
    assert landed.actual_points(hist, 3, first_only=True).first()["actual_points"] == 5.0


def predictions_frame(spark):
    return spark.createDataFrame(
        [(1, "David Raya Martin", "Arsenal", 1, 1, 5.5, 5.25), (2, "Second Player", "Arsenal", 1, 2, 4.5, 3.0)],
        "player_id long, full_name string, team_name string, team_id int, element_type int, now_cost_millions double, expected_points double",
    )


def test_archive_round_is_checked_and_repeatable(spark, tmp_path):
    p = predictions_frame(spark)
    roster = p.select("player_id", "full_name", "team_name", "team_id")
    archive = RoundArchive(spark, str(tmp_path))
    versions = [archive.write(p, roster, "2025-26", 5) for _ in range(2)]
    assert archive.predictions("2025-26", 5, 5).count() == 2 and [r.version for r in archive.rounds("2025-26").collect()] == versions[1:]
    with pytest.raises(ValueError, match="roster"):
        archive.write(p.withColumn("team_name", F.lit("Other")), roster, "2025-26", 6)
    with pytest.raises(ValueError, match="season_name"):
        archive.write(p.withColumn("season_name", F.lit("2024-25")), roster, "2025-26", 5)
    with pytest.raises(ValueError, match="no round"):
        archive.predictions("2025-26", 6)
    assert archive.vacuum("2025-26") == 1 and archive.predictions("2025-26").count() == 2


@pytest.mark.parametrize("part", ["predictions", "roster"])
def test_a_failure_between_the_writes_leaves_the_old_pair(spark, tmp_path, part):
    class Faulty(RoundArchive):
        def _write(self, df, path):
            if path.endswith(part):
                raise OSError("lost")
            super()._write(df, path)

    p = predictions_frame(spark)
    roster = p.select("player_id", "full_name", "team_name", "team_id")
    good = RoundArchive(spark, str(tmp_path))
    good.write(p, roster, "2025-26", 5)
    newer = p.withColumn("team_name", F.lit("New")).withColumn("expected_points", F.lit(9.0))
    with pytest.raises(OSError):
        Faulty(spark, str(tmp_path)).write(newer, newer.select(*roster.columns), "2025-26", 5)
    assert {r.team_name for r in good.rosters("2025-26").collect()} == {"Arsenal"} and good.predictions("2025-26").agg(F.max("expected_points")).first()[0] == 5.25
    good.write(newer, newer.select(*roster.columns), "2025-26", 5)
    assert {r.team_name for r in good.rosters("2025-26").collect()} == {"New"} and {r.expected_points for r in good.predictions("2025-26").collect()} == {9.0}


def test_a_writer_that_comes_second_has_to_write_again(spark, tmp_path):
    archive = RoundArchive(spark, str(tmp_path))
    archive.publish("a", {1: "x"})
    known = archive._manifest("a")
    archive.publish("a", {2: "y"})
    late = RoundArchive(spark, str(tmp_path))
    late._manifest = lambda season: known
    with pytest.raises(RuntimeError, match="another writer"):
        late.publish("a", {3: "z"})
    assert {r.gameweek: r.version for r in archive.rounds("a").collect()} == {1: "x", 2: "y"}


def test_migration_tags_and_checks(spark, tmp_path):
    p = predictions_frame(spark)
    roster = p.select("player_id", "full_name", "team_name", "team_id")
    archive = RoundArchive(spark, str(tmp_path))
    migrate(archive, p.withColumn("season_name", F.lit(None).cast("string")), roster, "2025-26", 3)
    assert {(r.season_name, r.gameweek) for r in archive.predictions("2025-26").collect()} == {("2025-26", 3)}
    with pytest.raises(ValueError):
        migrate(archive, p.withColumn("season_name", F.lit("1999-00")), roster, "2025-26", 3)


def test_only_the_wanted_partitions_are_read(spark, tmp_path):
    p = predictions_frame(spark)
    for gw in (1, 2, 3):
        store.write_predictions(store.tag_rows(p, "2025-26", gw), str(tmp_path))
    df = store.read_predictions(spark, str(tmp_path), "2025-26", 2, 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_name" in plan and df.count() == 2
    with pytest.raises(ValueError):
        store.missing_rounds_error(spark.read.parquet(str(tmp_path)), [3, 4])


def test_conform(spark):
    rows = store.conform_predictions(predictions_frame(spark)).orderBy("player_id").collect()
    assert rows[0]["start_probability"] == 1.0 and rows[0]["expected_points_lower_80"] == 4.25 and rows[0]["confidence_score"] == 70.0
    gap = predictions_frame(spark).withColumn("start_probability", F.lit(None).cast("double"))
    assert store.conform_predictions(gap).first()["start_probability"] == 0.75
    with pytest.raises(ValueError):
        store.conform_predictions(predictions_frame(spark).drop("team_id"))
    with pytest.raises(ValueError):
        store.conform_predictions(predictions_frame(spark).withColumn("now_cost_millions", F.lit(None).cast("double")), strict=True)


def test_history_table_replaces_one_season(spark, tmp_path):
    schema = "player_id long, season_name string, round int"
    history.write_history(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema), str(tmp_path))
    history.write_history(spark.createDataFrame([(3, "b", 9)], schema), str(tmp_path))
    assert sorted(r["player_id"] for r in history.read_history(spark, str(tmp_path)).collect()) == [1, 3]


def test_artifact_statuses(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, None), (3, None, "a"), (4, 1, "b")], "gameweek int, player_id int, season string")
    got = {r["gameweek"]: (r["status"], r["reason"]) for r in quality.classify_artifacts(
        df, ["gameweek"], {"invalid_id": F.col("player_id").isNull(), "wrong_season": F.col("season") != "a", "untagged": F.col("season").isNull()}
    ).collect()}
    assert got == {1: ("ready", ""), 2: ("migratable", ""), 3: ("issue", "invalid_id"), 4: ("issue", "wrong_season")}


def test_strict_load_and_identity_of_tagged_rows(spark, tmp_path):
    p = predictions_frame(spark)
    tags = lambda season, gw: {"season_tag": F.lit(season), "stated_gameweek": F.lit(gw)}
    store.write_predictions(store.tag_rows(p, "2025-26", 5, p).withColumns(tags("2025-26", 5)), str(tmp_path))
    assert store.load_predictions(spark, str(tmp_path), "2025-26", 5, 5).count() == 2
    with pytest.raises(ValueError, match="no predictions"):
        store.load_predictions(spark, str(tmp_path), "2025-26", 6, 7)
    store.write_predictions(store.tag_rows(p, "2025-26", 6).withColumns(tags("2024-25", 6)), str(tmp_path))
    with pytest.raises(ValueError, match="do not match"):
        store.load_predictions(spark, str(tmp_path), "2025-26")
    store.write_predictions(store.tag_rows(p, "2025-26", 5), f"{tmp_path}-plain")
    with pytest.raises(ValueError):
        store.load_predictions(spark, f"{tmp_path}-plain", "2025-26")
    with pytest.raises(ValueError, match="roster"):
        store.tag_rows(p.withColumn("team_id", F.lit(9)), "2025-26", 5, p)


def test_history_is_written_where_its_rows_are(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("player_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("season_name"))
    history.write_history(rows, str(tmp_path))
    files = [f for f in tmp_path.glob("season_name=*/*.parquet")]
    assert len(files) == 12  # one for each of the four tasks and three seasons: none was dealt anew
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert sorted(r[0] for r in history.read_history(spark, str(tmp_path)).select("player_id").collect()) == list(range(400))
