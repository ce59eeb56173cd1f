"""Form and time operators on an (entity, season, order, measures) panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import (
    MIN_PRIOR_MATCHES,
    ROLLING_WINDOW,
    SEASON_DECAY,
    SEASON_WEIGHT_FLOOR,
)
from rosterlake.functions.numbers import flag
from rosterlake.functions.seasons import season_start_year
from rosterlake.operators.ordered import first_row, is_hot, last_row, lookback, numbered, running, sort_columns, top_rows


def form(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    stats: Sequence[str],
    windows: Sequence[int] = (ROLLING_WINDOW,),
    lags: bool = True,
    hot: bool | None = None,
) -> DataFrame:
    """Leak-safe rolling means over the previous rows, and lag 1, restarting per key."""

    def columns(w):
        out = {}
        for size in windows:
            for s in stats:
                out[f"{s}_ma{size}"] = F.avg(s).over(w.rowsBetween(-size, -1))
        if lags:
            for s in stats:
                out[f"{s}_lag1"] = F.lag(s, 1).over(w)
        return out

    return lookback(df, keys, order, max([*windows, 1]), columns, hot=hot)


def prior_count(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], minimum: int = MIN_PRIOR_MATCHES,
    hot: bool | None = None,
) -> DataFrame:
    """Rows of the group before this one, and whether there are enough of them."""
    return (
        numbered(df, keys, order, "prev_matches", hot=hot)
        .withColumn("prev_matches", F.col("prev_matches") - 1)
        .withColumn("enough_prev", F.col("prev_matches") >= minimum)
    )


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], until: Column | None = None) -> DataFrame:
    """Last row per entity, optionally only of rows up to a period (the as-of case)."""
    return last_row(df if until is None else df.filter(until), keys, order)


def latest_with_fallback(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], preferred: Column
) -> DataFrame:
    """Last preferred row per entity, else its last row of any kind (J8), in one pass."""
    flipped = [s[1:] if s.startswith("-") else f"-{s}" for s in order]
    return top_rows(
        df.withColumn("_preferred", flag(preferred)), keys, ["-_preferred", *flipped], 1
    ).drop("_preferred")


def tail_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], stats: Sequence[str],
    size: int = ROLLING_WINDOW,
) -> DataFrame:
    """Mean of the last ``size`` rows per group, the latest row included."""
    flipped = [s[1:] if s.startswith("-") else f"-{s}" for s in order]
    return top_rows(df, keys, flipped, size).groupBy(*keys).agg(
        *[F.avg(s).alias(f"{s}_ma{size}") for s in stats]
    )


def change_and_expanding(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str, points: str
) -> DataFrame:
    """Rank gained since the previous row (0 at the start) and running mean of points."""
    hot = is_hot(df, keys)
    stepped = lookback(df, keys, order, 1, lambda w: {"_previous": F.lag(rank, 1).over(w)}, hot=hot)
    summed = running(
        stepped, keys, order, {"_sum": ("sum", F.col(points)), "_n": ("count", F.col(points))}, hot=hot
    )
    return (
        summed.withColumn(
            f"{rank}_delta", F.coalesce(F.col("_previous") - F.col(rank), F.lit(0)).cast("double")
        )
        .withColumn(f"{points}_average", F.col("_sum") / F.nullif(F.col("_n"), F.lit(0)))
        .drop("_previous", "_sum", "_n")
    )


def best_future(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "best_future",
    hot: bool | None = None,
) -> DataFrame:
    """Largest value strictly later in the group; 0 where there is none."""
    ahead = [s[1:] if s.startswith("-") else f"-{s}" for s in order]
    return running(
        df, keys, ahead, {name: ("max", F.col(value))}, include_current=False, hot=hot
    ).withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def rank_movement(df: DataFrame, current: str, previous: str, name: str = "movement") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(previous) - F.col(current), F.lit(0)))


def season_ranks(df: DataFrame, season: str) -> DataFrame:
    """Distinct seasons in chronological order, unknown labels last; rank from 0."""
    return (
        numbered(
            df.select(season).filter(F.col(season).isNotNull()).distinct()
            .withColumn("_year", season_start_year(season)),
            [],
            ["_year", season],
            "season_rank",
        )
        .withColumn("season_rank", F.col("season_rank") - 1)
        .drop("_year")
    )


def season_weights(
    df: DataFrame, season: str, decay: float = SEASON_DECAY, floor: float = SEASON_WEIGHT_FLOOR
) -> DataFrame:
    """Weight per season: the newest counts 1, each older one ``decay`` times the next."""
    ranks = season_ranks(df, season)
    newest = ranks.agg(F.max("season_rank")).scalar()
    return ranks.withColumn(
        "season_weight",
        F.greatest(F.lit(floor), F.pow(F.lit(decay), newest - F.col("season_rank"))),
    )


def add_season_weight(df: DataFrame, season: str) -> DataFrame:
    weights = season_weights(df, season).select(season, "season_weight")
    return df.join(weights, season, "left").withColumn(
        "season_weight", F.coalesce("season_weight", F.lit(1.0))
    )


def recent_rows(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` most recent rows. They are numbered from the newest across all partitions, so
    no task gathers them. ``order`` must be total for the result to be the same each time."""
    flipped = [s[1:] if s.startswith("-") else f"-{s}" for s in order]
    return numbered(df, [], flipped, "_recent").filter(F.col("_recent") <= rows).drop("_recent")


def distinct_periods(df: DataFrame, period: Sequence[str]) -> DataFrame:
    """Distinct periods with an index from 0, in order."""
    known = df.select(*period).na.drop().distinct()
    return numbered(known, [], period, "period_index").withColumn(
        "period_index", F.col("period_index") - 1
    )


def forward_folds(df: DataFrame, period: Sequence[str], folds: int = 3) -> DataFrame:
    """Period -> (period_index, fold): test blocks of n // (folds + 1) whole periods at the
    end; periods before the first block have fold 0 and only ever train. Fold f trains on
    every period with a smaller fold number (W17, deviation V5)."""
    periods = distinct_periods(df, period)
    count = periods.agg(F.count(F.lit(1))).scalar()
    size = F.floor(count / F.lit(folds + 1))
    first = count - size * folds
    return periods.withColumn(
        "fold",
        F.when(F.col("period_index") < first, F.lit(0))
        .otherwise(F.floor((F.col("period_index") - first) / F.greatest(size, F.lit(1))) + 1)
        .cast("int"),
    )


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep-first by key; put the source priority first in ``order``."""
    return first_row(df, keys, order)


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return last_row(df, keys, order)
