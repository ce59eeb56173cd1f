"""The prediction store: one table partitioned by (season_name, gameweek)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators.ordered import top_rows
from rosterlake.operators.quality import conform, identity_mismatches, raise_if_any, require_columns
from rosterlake.schemas import PREDICTION_TYPES

PARTITION = ["season_name", "gameweek"]
REQUIRED = ["player_id", "full_name", "team_name", "team_id", "element_type", "now_cost_millions", "expected_points"]


def conform_predictions(df: DataFrame, strict: bool = False) -> DataFrame:
    """Required columns, types and defaults of a prediction table (P24). ``strict`` raises for
    players without a price; otherwise :func:`missing_prices` reports them."""
    require_columns(df, REQUIRED)
    ep = F.coalesce(F.col("expected_points").try_cast("double"), F.lit(0.0))
    # a column that is absent altogether defaults to a certain start; a gap in it to 0.75
    start = 0.75 if "start_probability" in df.columns else 1.0
    defaults = {
        "expected_points": 0.0, "start_probability": start, "appearance_probability": 1.0,
        "cameo_points": 1.0, "fixture_multiplier": 1.0, "confidence_score": 70.0,
    }
    if "expected_points_lower_80" not in df.columns:
        defaults["expected_points_lower_80"] = F.greatest(F.lit(0.0), ep - 1.0)
    if "expected_points_upper_80" not in df.columns:
        defaults["expected_points_upper_80"] = ep + 1.0
    extra = {c: "double" for c in ("official_ep_next", "price_change_percent") if c in df.columns}
    tags = {c: t for c, t in (("season_name", "string"), ("gameweek", "int")) if c in df.columns}
    out = conform(df, {**PREDICTION_TYPES, **extra, **tags}, defaults)
    out = out.withColumn(
        "appearance_probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("appearance_probability")))
    )
    if strict:
        raise_if_any(missing_prices(out), "missing costs for players")
    return out


def missing_prices(df: DataFrame) -> DataFrame:
    return df.filter(F.col("now_cost_millions").isNull()).select("player_id")


def write_predictions(df: DataFrame, path: str) -> None:
    """Replace the rounds present in ``df`` and leave all others (A13). Rows are dealt by round
    before the write; Spark splits a large round over as many tasks as its size asks for."""
    (
        df.hint("rebalance", *[F.col(c) for c in PARTITION])
        .sortWithinPartitions(*PARTITION, F.desc_nulls_last("expected_points"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
    )


def write_nested(df: DataFrame, path: str) -> None:
    """Nested squads as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_predictions(
    spark: SparkSession, path: str, season: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Rounds of one season; only matching partitions are listed and read."""
    df = spark.read.parquet(path).filter(F.col("season_name") == season)
    if first is not None:
        df = df.filter(F.col("gameweek") >= first)
    if last is not None:
        df = df.filter(F.col("gameweek") <= last)
    return df


def load_predictions(
    spark: SparkSession, path: str, season: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """The strict read (A7): an error when no round is found, when the table has no tags (``season_tag``,
    ``stated_gameweek``), and when tags are missing in a row or name another season or round."""
    df = read_predictions(spark, path, season, first, last)
    require_columns(df, ["season_tag", "stated_gameweek"])
    if df.isEmpty():
        raise ValueError(f"no predictions of {season} in rounds {first} to {last} under {path}")
    raise_if_any(tag_problems(df, season), f"tags of {season} do not match their rounds")
    return df


def tag_problems(df: DataFrame, season: str, stated: str = "stated_gameweek") -> DataFrame:
    """Rounds whose rows are untagged, of another or several seasons, or tagged for another
    round than the one they were stored under."""
    return df.groupBy("gameweek").agg(
        F.count_if(F.col("season_tag").isNull()).alias("untagged"),
        F.count_if(F.col("season_tag") != season).alias("wrong_season"),
        F.countDistinct("season_tag").alias("seasons"),
        F.count_if(~F.col(stated).eqNullSafe(F.col("gameweek"))).alias("wrong_round"),
    ).filter(
        (F.col("untagged") > 0) | (F.col("wrong_season") > 0) | (F.col("seasons") > 1) | (F.col("wrong_round") > 0)
    )


def horizon_rounds(df: DataFrame, start: int, length: int) -> DataFrame:
    """Requested rounds and whether each is present."""
    wanted = df.sparkSession.range(start, start + length).select(F.col("id").cast("int").alias("gameweek"))
    present = df.select("gameweek").distinct().withColumn("present", F.lit(True))
    return wanted.join(present, "gameweek", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def available_horizon(df: DataFrame, start: int, length: int) -> DataFrame:
    """The first ``length`` rounds present from ``start`` on."""
    rounds = df.filter(F.col("gameweek") >= start).select("gameweek").distinct()
    return rounds.orderBy("gameweek").limit(max(1, length))


def tag_rows(df: DataFrame, season: str, gameweek: int, roster: DataFrame | None = None) -> DataFrame:
    """Season and round on untagged rows; rows tagged otherwise stop the migration (A16), and so do
    players that are not the roster's, where one is given."""
    if roster is not None:
        raise_if_any(
            identity_mismatches(df, roster, "player_id", [c for c in ("full_name", "team_name", "team_id") if c in df.columns]),
            f"rows to tag as round {gameweek} do not match the roster",
        )
    tags = {"season_name": F.lit(season), "gameweek": F.lit(gameweek)}
    for name, value in tags.items():
        if name in df.columns:
            raise_if_any(
                df.filter(F.col(name).isNotNull() & (F.col(name).cast("string") != value.cast("string"))).select(name),
                f"conflicting {name}",
            )
    return df.withColumns(tags)


def season_catalogue(archive: DataFrame, root: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Seasons with consistently tagged rounds and a roster snapshot, newest first; the archive
    wins over the working folder (A15)."""
    both = archive.select(*PARTITION, F.lit(1).alias("priority")).unionByName(
        root.select(*PARTITION, F.lit(2).alias("priority"))
    ).distinct()
    listed = both.groupBy("season_name", "priority").agg(
        F.count(F.lit(1)).alias("rounds"), F.min("gameweek").alias("first_round"), F.max("gameweek").alias("last_round")
    ).filter(F.col("season_name").isNotNull())
    with_roster = listed.join(snapshots.select("season_name").distinct(), "season_name", "left_semi")
    return top_rows(with_roster, ["season_name"], ["priority"], 1)


def load_state(state: DataFrame, season: str) -> DataFrame:
    """Bias state of the season; state of any other season reads as empty."""
    return state.filter(F.col("season_name") == season)


def write_state(state: DataFrame, path: str) -> None:
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season_name").parquet(path)


def missing_rounds_error(df: DataFrame, rounds: Sequence[int]) -> None:
    """Strict form of the horizon check."""
    from rosterlake.operators.aggregates import missing_rounds

    raise_if_any(missing_rounds(df, rounds), "missing predictions for rounds")
