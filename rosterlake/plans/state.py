"""Residuals and the bias state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import EMA_ALPHA, ROUNDS_PER_SEASON
from rosterlake.operators.aggregates import residual_means
from rosterlake.operators.ordered import numbered
from rosterlake.plans.scoring import expected_value

KINDS = {"player": "player_id", "position": "element_type"}


def residuals(
    actual: DataFrame, scored: DataFrame, elements: DataFrame, cameo: DataFrame,
    gameweek: int, season: str | None = None,
) -> DataFrame:
    """Actual minus predicted points of one round, without bias and availability.

    ``scored`` has player_id, p_start, p_appear, points_hat from features known before the
    round. A live row has no position: the roster's fills it first (V4).
    """
    rows = actual.filter(F.col("round") == gameweek)
    if season is not None:
        rows = rows.filter(F.col("season_name") == season)
    if "element_type" not in rows.columns:
        rows = rows.withColumn("element_type", F.lit(None).cast("int"))
    roster = elements.select("player_id", F.col("element_type").alias("_pos"))
    positioned = rows.join(roster, "player_id", "left").withColumn(
        "element_type", F.coalesce("element_type", "_pos")
    )
    joined = positioned.select("player_id", "element_type", "total_points").join(
        scored.select("player_id", "p_start", "p_appear", "points_hat"), "player_id", "left"
    ).na.drop("all", subset=["p_start", "p_appear", "points_hat"])
    value = expected_value(
        F.col("p_start"), F.col("p_appear"), F.col("points_hat"), F.col("cameo_points"), F.lit(1.0)
    )["expected_points_raw"]
    return joined.join(cameo, "element_type", "left").select(
        "player_id", "element_type", value.alias("predicted_points"),
        (F.col("total_points").cast("double") - value).alias("residual"), F.lit(gameweek).alias("gw"),
    )


def update_state(state: DataFrame, found: DataFrame, season: str, alpha: float = EMA_ALPHA) -> DataFrame:
    """One round's residuals folded into the state: ``(1 - a) x previous + a x mean``.
    Keys without a residual keep their value; state of another season counts as none."""
    means = residual_means(found, KINDS)
    last = found.agg(F.max("gw")).scalar()
    old = state.filter(F.col("season_name") == season).select(
        "kind", "key", F.col("bias").alias("_old"), F.col("last_gw").alias("_old_gw")
    )
    joined = old.join(means, ["kind", "key"], "full_outer")
    new = (1.0 - alpha) * F.coalesce("_old", F.lit(0.0)) + alpha * F.col("mean_residual")
    return joined.select(
        F.lit(season).alias("season_name"), "kind", "key",
        F.coalesce(new, F.col("_old")).alias("bias"),
        F.greatest(last, F.col("_old_gw")).alias("last_gw"),
    )


def replay_state(
    found: DataFrame, period: Sequence[str] = ("season_name", "gw"), within: Sequence[str] = ("season_name",),
    kinds: dict[str, str] = KINDS, alpha: float = EMA_ALPHA, hot: bool | None = None,
) -> DataFrame:
    """The state after *all* rounds at once. An exponential average is a weighted sum: the
    mean of a round that n later rounds of the key follow counts ``a (1 - a)^n``. So the fold
    is a round-wise mean, a row number from the end, and a sum: nothing is collected."""
    per_round = residual_means(found, kinds, also=list(dict.fromkeys([*within, *period])))
    order = [f"-{p}" for p in period if p not in within]
    ranked = numbered(per_round, [*within, "kind", "key"], order, "_from_end", hot=hot)
    weight = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("_from_end") - 1)
    last = [p for p in period if p not in within][-1]
    return ranked.groupBy(*within, "kind", "key").agg(
        F.sum(weight * F.col("mean_residual")).alias("bias"),
        F.max(last).alias("last_gw"), F.count(F.lit(1)).alias("rounds"),
    )


def refresh_rounds(next_round: Column, length: int, cap: int = ROUNDS_PER_SEASON) -> Column:
    """Rounds to refresh: the next ones, up to the end of the season."""
    stop = F.least(F.lit(cap), next_round + length - 1)
    return F.when(next_round <= stop, F.sequence(next_round.cast("int"), stop.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
