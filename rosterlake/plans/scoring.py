"""From model outputs to published predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import OUTSIDE_FORECAST_WEIGHT, Z80
from rosterlake.functions.numbers import clip, to_number
from rosterlake.functions.players import reliability, resolved_availability


def expected_value(
    p_start: Column, p_appear: Column, points: Column, cameo: Column, available: Column,
    bias: Column | None = None,
) -> dict[str, Column]:
    """Expected points from start and appearance chances, the conditional score, the short-
    appearance score and availability; bias counts with the chance to start (P19)."""
    appear = F.greatest(p_appear, p_start)
    raw = (p_start * points + clip(appear - p_start, 0.0, 1.0) * F.coalesce(cameo, F.lit(1.0))) * available
    corrected = raw if bias is None else raw + F.coalesce(bias, F.lit(0.0)) * p_start * available
    return {
        "p_appear": appear,
        "expected_points_raw": raw,
        "expected_points": clip(corrected, 0.0),
    }


def score_rows(
    scores: DataFrame, entities: DataFrame, biases: DataFrame, cameo: DataFrame
) -> DataFrame:
    """Long model scores (player, model, p_start, p_appear, points_hat) to expected points.

    ``biases`` is the state table (kind, key, bias); ``cameo`` has element_type, cameo_points.
    """
    player = biases.filter("kind = 'player'").select(
        F.col("key").cast("bigint").alias("player_id"), F.col("bias").alias("_player_bias")
    )
    position = biases.filter("kind = 'position'").select(
        F.col("key").cast("int").alias("element_type"), F.col("bias").alias("_position_bias")
    )
    chances = {
        c: to_number(c) if c in entities.columns else F.lit(None).cast("double")
        for c in ("availability_next_round", "availability_this_round", "status_availability")
    }
    known = entities.withColumn("_avail", resolved_availability(*chances.values()))
    joined = (
        scores.join(known, "player_id").join(player, "player_id", "left")
        .join(position, "element_type", "left").join(cameo, "element_type", "left")
    )
    bias = F.coalesce("_player_bias", F.lit(0.0)) + F.coalesce("_position_bias", F.lit(0.0))
    values = expected_value(
        F.col("p_start"), F.col("p_appear"), F.col("points_hat"), F.col("cameo_points"), F.col("_avail"), bias
    )
    matches = F.col("history_match_count") if "history_match_count" in entities.columns else None
    minutes = F.col("season_minutes") if "season_minutes" in entities.columns else None
    return joined.withColumns({**values, "reliability_weight": reliability(matches, minutes)}).drop(
        "_avail", "_player_bias", "_position_bias"
    )


def ensemble(long: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean over the models of raw and corrected points and of the start chance, and the
    spread between models. Missing values do not count; corrected points are not negative (P17)."""
    return long.groupBy(*key).agg(
        F.coalesce(F.avg("expected_points_raw"), F.lit(0.0)).alias("expected_points_raw"),
        clip(F.avg("expected_points"), 0.0).alias("_corrected"),
        clip(F.avg("p_start"), 0.0, 1.0).alias("start_probability"),
        clip(F.avg("p_appear"), 0.0, 1.0).alias("appearance_probability"),
        F.coalesce(F.stddev_pop("expected_points"), F.lit(0.0)).alias("model_std"),
        F.count("expected_points").alias("model_count"),
    ).withColumn(
        "expected_points", F.coalesce("_corrected", clip(F.col("expected_points_raw"), 0.0))
    ).drop("_corrected")


def blend_outside(df: DataFrame, weight: float = OUTSIDE_FORECAST_WEIGHT, column: str = "official_ep_next") -> DataFrame:
    """Mix in an outside forecast where there is one; keep the model's value and the weight
    applied (P18)."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("blend weight must lie between 0 and 1")
    outside = clip(to_number(column), 0.0) if column in df.columns else F.lit(None).cast("double")
    model = F.coalesce("expected_points", F.lit(0.0))
    applied = F.when(outside.isNotNull(), F.lit(float(weight))).otherwise(0.0)
    return df.withColumns(
        {
            "model_expected_points": model,
            "official_ep_blend_weight": applied,
            "expected_points": clip((1.0 - applied) * model + applied * F.coalesce(outside, model), 0.0),
        }
    )


def publish(
    scores: DataFrame, entities: DataFrame, biases: DataFrame, cameo: DataFrame, weight: float = OUTSIDE_FORECAST_WEIGHT, exact: bool = False,
) -> DataFrame:
    """From the long scores of any number of models to the published table: availability, bias and cameo points per model, mean
    and spread over the models, the outside forecast blended in, confidence and range. One row for each entity that a model
    has scored, with the entity's own columns."""
    scored = score_rows(scores, entities.select(*[c for c in entities.columns if c in _SCORED]), biases, cameo)
    means = ensemble(scored, ["player_id"])
    matches = F.col("history_match_count") if "history_match_count" in entities.columns else None
    minutes = F.col("season_minutes") if "season_minutes" in entities.columns else None
    whole = entities.withColumn("reliability_weight", reliability(matches, minutes)).join(means, "player_id")
    return add_confidence(blend_outside(whole, weight), exact)


_SCORED = (
    "player_id", "element_type", "availability_next_round", "availability_this_round", "status_availability", "history_match_count", "season_minutes",
)


def add_confidence(df: DataFrame, exact: bool = False) -> DataFrame:
    """Confidence score, level and 80 % range (P22). ``exact`` leaves the numbers unrounded.

    Needs expected_points, start_probability, model_std, model_count; reliability_weight and
    the availability columns where they exist.
    """
    def number(name: str, default: float) -> Column:
        return to_number(name) if name in df.columns else F.lit(default)

    sure = clip(F.coalesce(number("reliability_weight", 1.0), F.lit(1.0)), 0.0, 1.0)
    nexts = number("availability_next_round", 1.0)
    if "availability_next_round" in df.columns and "availability_this_round" in df.columns:
        # this round's chance stands in only when no row has one for the next round
        none_known = df.agg(F.count(number("availability_next_round", 1.0))).scalar() == 0
        nexts = F.when(none_known, number("availability_this_round", 1.0)).otherwise(nexts)
    available = clip(F.coalesce(nexts, number("status_availability", 1.0), F.lit(1.0)), 0.0, 1.0)
    start = clip(F.coalesce(to_number("start_probability"), F.lit(0.5)), 0.0, 1.0)
    spread = F.coalesce("model_std", F.lit(0.0))
    certainty = clip(F.abs(start - 0.5) * 2.0, 0.0, 1.0)
    confidence = clip(0.35 * sure + 0.25 * available + 0.25 / (1.0 + spread) + 0.15 * certainty, 0.0, 1.0)
    ep = F.coalesce("expected_points", F.lit(0.0))
    single = F.when(F.col("model_count") <= 1, 0.35).otherwise(0.0)
    sigma = F.greatest(
        F.lit(0.05), spread + (1.0 - F.col("_conf")) * (0.40 + 0.20 * clip(ep, 0.0)) + single
    )
    r = (lambda c, d: c) if exact else F.bround
    score = F.bround(F.col("_conf") * 100.0, 1)
    return df.withColumn("_conf", confidence).withColumns(
        {
            "expected_points_std": r(spread, 4),
            "confidence_score": r(F.col("_conf") * 100.0, 1),
            "confidence_level": F.when(score <= 49.9, "Low").when(score <= 74.9, "Medium").otherwise("High"),
            "expected_points_lower_80": r(clip(ep - Z80 * sigma, 0.0), 3),
            "expected_points_upper_80": r(ep + Z80 * sigma, 3),
        }
    ).drop("_conf")
