"""One nested record per squad with all that an adviser needs to know about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.players import compact_record, risk_issues
from rosterlake.operators.ordered import top_rows
from rosterlake.operators.squad import best_lineup, summarise, transfer_report

SNAPSHOT = {
    "player_id": "bigint", "full_name": "string", "team_name": "string", "element_type": "int", "expected_points": "double",
    "now_cost_millions": "double", "start_probability": "double", "confidence_score": "double", "confidence_level": "string",
    "expected_points_lower_80": "double", "expected_points_upper_80": "double",
}
CAPTAINS, TARGETS = 3, 10


def _listed(fields: Sequence[Column | str], order: Column, name: str) -> Column:
    """Rows of a group as an array of records, by ``order``. A squad's groups have fifteen rows at most."""
    rows = F.collect_list(F.struct(order.alias("_o"), F.struct(*fields).alias("_r")))
    return F.transform(F.array_sort(rows), lambda x: x["_r"]).alias(name)


def snapshot(df: DataFrame) -> Column:
    """A player's record; what the table does not have is null."""
    return compact_record({c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in SNAPSHOT.items()})


def scope(forecasts: DataFrame, rounds: Sequence[int]) -> DataFrame:
    """One row: the first of the rounds asked for that is there, those that are there and those that are not."""
    asked = F.array(*[F.lit(int(r)) for r in rounds])
    there = F.array_sort(F.coalesce(F.array_intersect(F.collect_set(F.when(F.col("gameweek").isin(*rounds), F.col("gameweek").cast("int"))), asked), F.array()))
    found = forecasts.agg(there.alias("_there"))
    return found.select(F.struct(
        F.get("_there", F.lit(0)).alias("current_gameweek"), F.col("_there").alias("horizon_gameweeks"),
        F.array_sort(F.array_except(asked, F.col("_there"))).alias("missing_prediction_gameweeks"),
    ).alias("analysis_scope"))


def horizon_leaders(forecasts: DataFrame, players: DataFrame, rounds: Sequence[int], count: int = TARGETS) -> DataFrame:
    """One row: the ``count`` players with the most points over the rounds, ties to the smaller id."""
    totals = forecasts.filter(F.col("gameweek").isin(*rounds)).groupBy("player_id").agg(F.sum("expected_points").alias("horizon_points"))
    best = top_rows(totals.withColumn("_all", F.lit(0)), ["_all"], ["-horizon_points", "player_id"], count, "_no").drop("_all")
    known = [c for c in ("full_name", "team_name", "element_type", "now_cost_millions") if c in players.columns]
    named = best.join(players.select("player_id", *known), "player_id", "left")
    return named.agg(_listed(["player_id", *known, F.round("horizon_points", 2).alias("horizon_points")], F.col("_no"), "horizon_top_targets"))


def analysis_context(
    squads: DataFrame, forecasts: DataFrame, players: DataFrame, rounds: Sequence[int], pairs: DataFrame, optimum: DataFrame | None = None,
    squad: str = "squad_id", free_transfers: int = 1,
) -> DataFrame:
    """(``squad``, context): scope, the squad as its owner lines it up, line-up advice, captains, distance from the optimum,
    transfer plan, risks and the players with the best horizon.

    ``squads``: player rows with starting, bench and captain flags. ``forecasts``: player_id, gameweek, expected_points.
    ``pairs``: proposed swaps, as ``pair_by_rank`` gives them. ``optimum``: (``squad``, objective, players), as ``best_squads`` gives
    it; squads without one have no comparison. Squads that are not complete get no line-up advice.
    """
    keys = [squad]
    summary = summarise(squads, keys)
    record = snapshot(squads)
    user = squads.groupBy(squad).agg(_listed([record.alias("player")], F.col("player_id"), "_players")).join(summary, squad).select(
        squad, F.struct(
            F.round("total_cost", 2).alias("total_cost_m"), F.col("captain_id").alias("current_captain"),
            F.round("expected_points_without_captain", 2).alias("projected_points_without_captain"),
            F.round("total_expected_points_with_captain", 2).alias("projected_points_with_captain"),
            F.round("bench_expected_points", 2).alias("bench_expected_points"),
            F.transform("_players", lambda p: p["player"]).alias("players"),
        ).alias("user_squad"),
    )
    advice = best_lineup(squads.drop("formation_no", "xi_points", "starting", "bench", "bench_order"), keys)
    ids = lambda when, order, name: F.transform(
        F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("o"), F.col("player_id").alias("id"))))), lambda x: x["id"]
    ).alias(name)
    starts = F.col("starting") == 1
    lineup = advice.groupBy(squad).agg(
        F.max("formation_no").alias("formation_no"), F.round(F.max("xi_points"), 2).alias("xi_points"),
        ids(starts, F.struct("element_type", -F.col("expected_points"), "player_id"), "starting"), ids(~starts, F.col("bench_order"), "bench"),
        (F.max("xi_points") + F.max(F.when(starts, F.col("expected_points"))) + 0.25 * F.sum(F.when(~starts, F.col("expected_points")))).alias("_value"),
    )
    captains = top_rows(squads.withColumn("_record", record), keys, ["-expected_points", "player_id"], CAPTAINS, "_no").groupBy(squad).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_no", "_record"))), lambda x: x["_record"]).alias("captaincy_options")
    )
    status = F.col("status") if "status" in squads.columns else F.lit(None).cast("string")
    chance = F.col("chance_of_playing_next_round") if "chance_of_playing_next_round" in squads.columns else F.lit(None).cast("double")
    level = F.col("confidence_level") if "confidence_level" in squads.columns else F.lit(None).cast("string")
    risks = squads.withColumn("_issues", risk_issues(status, chance, level)).filter(F.size("_issues") > 0).groupBy(squad).agg(
        _listed(["player_id", F.col("_issues").alias("issues")], F.col("player_id"), "risk_flags")
    )
    plan = transfer_report(pairs, keys, free_transfers).select(squad, F.struct(
        "transfers", "free_used", "paid_transfers", "hit_cost", F.round("gross_gain", 2).alias("gross_gain"), F.round("net_gain", 2).alias("net_gain"), "worth_it",
    ).alias("transfer_plan"))
    joined = user.join(lineup, squad, "left").join(captains, squad, "left").join(risks, squad, "left").join(plan, squad, "left")
    if optimum is None:
        joined = joined.withColumn("optimal_comparison", F.lit(None).cast("struct<optimal_points:double,user_points:double,points_gap:double,rating:double,shared:int>"))
    else:
        best = optimum.filter("objective is not null").select(squad, "objective", F.col("players").alias("_best"))
        owned = F.transform("user_squad.players", lambda p: p["player_id"])
        rating = F.when(F.col("objective") <= 0, 0.0).otherwise(F.round(F.col("_value") / F.col("objective") * 100.0, 2))
        joined = joined.join(best, squad, "left").withColumn("optimal_comparison", F.when(F.col("objective").isNotNull() & F.col("_value").isNotNull(), F.struct(
            F.round("objective", 2).alias("optimal_points"), F.round("_value", 2).alias("user_points"), F.round(F.col("objective") - F.col("_value"), 2).alias("points_gap"),
            rating.alias("rating"), F.size(F.array_intersect(owned, "_best")).alias("shared"),
        )))
    once = scope(forecasts, rounds).join(horizon_leaders(forecasts, players, rounds))  # one row each
    advised = F.when(F.col("formation_no").isNotNull(), F.struct("formation_no", "xi_points", "starting", "bench")).alias("lineup_advice")
    return joined.join(F.broadcast(once)).select(squad, F.struct(
        "analysis_scope", "user_squad", advised, "captaincy_options", "optimal_comparison", "transfer_plan",
        F.coalesce("risk_flags", F.array()).alias("risk_flags"), "horizon_top_targets",
    ).alias("context"))
