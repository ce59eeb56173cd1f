"""Aggregates, reshaping and set operations (G1-G3, G5, G10, G12, G13, G15, G19, G21, R1-R6, U1, K-boards)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.numbers import clip
from rosterlake.operators.ordered import numbered, percentiles, top_rows


def horizon(
    predictions: DataFrame, rounds: Sequence[int], entity: str = "player_id",
    value: str = "expected_points", period: str = "gameweek", meta: Sequence[str] = (),
) -> DataFrame:
    """One column per round (0 where missing), the total, and the metadata of the last round
    seen (G1, R1). The round list is given, so the pivot needs no extra job."""
    wide = predictions.filter(F.col(period).isin(list(rounds))).groupBy(entity).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(period) == r, F.col(value))), F.lit(0.0)).alias(f"{value}_gw{r}")
            for r in rounds
        ],
        *[F.max_by(F.col(m), F.col(period)).alias(m) for m in meta],
    )
    total = reduce(lambda a, b: a + b, [F.col(f"{value}_gw{r}") for r in rounds])
    return wide.withColumn(value, total)


def missing_rounds(predictions: DataFrame, rounds: Sequence[int], period: str = "gameweek") -> DataFrame:
    """Requested rounds without a prediction (U4)."""
    spark = predictions.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(int(r)) for r in rounds])).alias(period))
    return wanted.join(predictions.select(period).distinct(), period, "left_anti")


def unpivot_rounds(wide: DataFrame, ids: Sequence[str], prefix: str, period: str = "gameweek",
                   value: str = "expected_points") -> DataFrame:
    """Round columns back to rows, the number taken from the column name (R2)."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot(list(ids), columns, "_name", value).select(
        *ids, F.regexp_extract("_name", r"(\d+)$", 1).cast("int").alias(period), value
    )


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(
        list(ids), list(measures), "metric", "value"
    )


def metric_by_entity(df: DataFrame, entity: str, entities: Sequence, measures: Sequence[str]) -> DataFrame:
    """Metric x entity table: unpivot, then pivot on the given entities."""
    long = unpivot_measures(df.filter(F.col(entity).isin(list(entities))), [entity], measures)
    return long.groupBy("metric").pivot(entity, list(entities)).agg(F.max("value"))


def conditional_means(
    df: DataFrame, group: str, groups: Sequence[int], value: str, condition: Column,
    low: float = 0.0, high: float = 5.0, fallback: float = 1.0, name: str = "cameo_points",
) -> DataFrame:
    """Mean of the value where the condition holds, per group; an empty group takes the
    overall mean, an empty table the fallback; clipped (G2)."""
    chosen = df.filter(condition)
    per_group = chosen.groupBy(group).agg(F.avg(value).alias("_mean"))
    overall = chosen.agg(F.avg(value)).scalar()
    listed = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(g) for g in groups])).alias(group)
    )
    return listed.join(per_group, group, "left").select(
        group, clip(F.coalesce("_mean", clip(overall, low, high), F.lit(fallback)), low, high).alias(name)
    )


def residual_means(df: DataFrame, kinds: dict[str, str], value: str = "residual",
                   also: Sequence[str] = ()) -> DataFrame:
    """Mean residual per key of every kind, e.g. {'player': 'player_id', 'position':
    'element_type'}: one pass, each row counted once per kind (G3)."""
    tagged = df.select(
        *also, F.col(value).alias("_value"),
        F.explode(
            F.array(*[
                F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key"))
                for kind, c in kinds.items()
            ])
        ).alias("_k"),
    )
    return (
        tagged.select(*also, "_k.kind", "_k.key", "_value").filter(F.col("key").isNotNull())
        .groupBy(*also, "kind", "key")
        .agg(F.avg("_value").alias("mean_residual"), F.count(F.lit(1)).alias("n"))
    )


def history_counts(hist: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Matches per entity, 0 for those without history."""
    counts = hist.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return entities.join(counts, key, "left").withColumn(
        "history_match_count", F.coalesce("_n", F.lit(0)).cast("long")
    ).drop("_n")


def confidence_census(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """How many High / Medium / Low, zeros included, and the average levels."""
    level = F.col("confidence_level")
    return df.groupBy(*group).agg(
        *[F.count_if(level == n).alias(n.lower()) for n in ("High", "Medium", "Low")],
        F.avg("confidence_score").alias("average_confidence"),
        F.avg("start_probability").alias("average_start_probability"),
    )


def distribution(df: DataFrame, block: str, value: str, extra_mean: str | None = None) -> DataFrame:
    """Mean, median, extremes and p10/p90 per block, with the best block by mean flagged."""
    basics = df.groupBy(block).agg(
        F.avg(value).alias("mean_value"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"), F.count(value).alias("n"),
        *([F.avg(extra_mean).alias(f"mean_{extra_mean}")] if extra_mean else []),
    )
    spread = percentiles(df, [block], value, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    joined = basics.join(spread, block)
    best = basics.agg(F.max_by(block, F.struct(F.col("mean_value"), -F.col(block)))).scalar()
    return joined.withColumn("is_best", F.col(block) == best)


def histogram(df: DataFrame, value: str, low_bins: int = 5, high_bins: int = 30) -> DataFrame:
    """Equal-width bins, min(30, max(5, floor(sqrt n))) of them; the last bin is closed and
    empty bins stay (G13)."""
    stats = df.filter(F.col(value).isNotNull()).agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"), F.count(value).alias("_n")
    ).withColumn(
        "_bins", F.least(F.lit(high_bins), F.greatest(F.lit(low_bins), F.floor(F.sqrt("_n")))).cast("int")
    )
    # a single point gets a unit-wide range around it
    stats = stats.select(
        F.when(F.col("_low") == F.col("_high"), F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
        F.when(F.col("_low") == F.col("_high"), F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_high"),
        "_bins",
    )
    width = (F.col("_high") - F.col("_low")) / F.col("_bins")
    binned = (
        df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
        .join(F.broadcast(stats), F.lit(True))
        .select(F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.col("_bins") - 1).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    frame = stats.select("*", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("bin"))
    return frame.join(binned, "bin", "left").select(
        "bin", (F.col("_low") + width * (F.col("bin") + 0.5)).alias("mid_point"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def change_census(df: DataFrame, code: str, old: str, new: str) -> DataFrame:
    """How many distinct codes changed, per (old, new) pair."""
    return (
        df.filter(F.col(old) != F.col(new)).select(code, old, new).distinct()
        .groupBy(old, new).agg(F.count(F.lit(1)).alias("n"))
    )


def run_totals(decisions: DataFrame, run: str, parts: int = 1000) -> DataFrame:
    """Totals per run: points, transfers, rounds, and chips used as a map of counts."""
    return decisions.groupBy(run).agg(
        F.sum("expected_points").alias("total_points"),
        F.sum("transfers").cast("long").alias("total_transfers"),
        F.count(F.lit(1)).alias("rounds"),
        *[
            F.count_if(F.col("chip") == c).alias(f"{c}_used")
            for c in ("wildcard", "free_hit", "bench_boost", "triple_captain")
        ],
    )


def top_per_period(df: DataFrame, period: str, entity: str, value: str) -> DataFrame:
    """Best entity per period, its value, and how many were projected."""
    return df.groupBy(period).agg(
        F.max_by(entity, F.struct(F.col(value), -F.col(entity))).alias("top_entity"),
        F.max(value).alias("top_value"),
        F.count(F.lit(1)).alias("n"),
    )


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def leaderboard(df: DataFrame, score: str, tie: str, rows: int) -> DataFrame:
    return top_rows(df, [], [f"-{score}", tie], rows, "rank")


def full_ranking(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Rank of every row of the table in a multi-key order, nulls last (K2, K5)."""
    return numbered(df, [], order, name)


def standings(df: DataFrame, group: Sequence[str], points: str, entity: str) -> DataFrame:
    """Rank inside the league and gap to its leader (K6)."""
    ranked = numbered(df, group, [f"-{points}", entity], "rank")
    leaders = df.groupBy(*group).agg(F.max(points).alias("_lead"))
    return ranked.join(leaders, list(group), "left").withColumn(
        "gap_to_leader", F.col("_lead") - F.col(points)
    ).drop("_lead")


def projection_board(
    predictions: DataFrame, chosen: DataFrame, rounds: Sequence[int], entity: str = "player_id"
) -> DataFrame:
    """Chosen entities: a column per round, the total, the first round's confidence, ranked
    by total (K7)."""
    wide = horizon(predictions.join(chosen.select(entity), entity, "left_semi"), rounds, entity)
    first = predictions.filter(F.col("gameweek") == rounds[0]).groupBy(entity).agg(
        F.max("confidence_score").alias("confidence_score")
    )
    joined = chosen.select(entity).join(wide, entity, "left").join(first, entity, "left").na.fill(
        0.0, ["expected_points", *[f"expected_points_gw{r}" for r in rounds]]
    )
    return numbered(joined, [], ["-expected_points", entity], "rank")


def skill_profile(squad: DataFrame, projections: DataFrame, rounds: Sequence[int],
                  measures: Sequence[str], entity: str = "player_id") -> DataFrame:
    """Per-90 measures and the mean score per round, one row per metric."""
    wide = horizon(projections, rounds, entity).withColumn(
        "mean_per_round", F.col("expected_points") / len(rounds)
    )
    joined = squad.select(entity, *measures).join(wide.select(entity, "mean_per_round"), entity, "left")
    filled = joined.na.fill(0.0, [*measures, "mean_per_round"])
    return unpivot_measures(filled, [entity], [*measures, "mean_per_round"])
