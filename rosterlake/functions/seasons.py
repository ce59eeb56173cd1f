"""Season labels and round bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.numbers import as_column


def season_start_year(label: Column | str) -> Column:
    """First four-digit run of a label, as a year."""
    digits = F.regexp_extract(as_column(label).cast("string"), r"(\d{4})", 1)
    return F.nullif(digits, F.lit("")).cast("int")


def season_code(year: Column) -> Column:
    """2025 -> '2025-26'."""
    return F.concat(
        year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    )


def previous_season(label: Column | str) -> Column:
    return season_code(season_start_year(label) - 1)


def season_for_date(day: Column | str) -> Column:
    """The season that is live on a date; seasons turn over in July."""
    d = as_column(day)
    return season_code(F.year(d) - F.when(F.month(d) < 7, 1).otherwise(0))


def prior_season_codes(label: Column | str, count: int) -> Column:
    """The season and its ``count`` predecessors, newest first."""
    year = season_start_year(label)
    return F.transform(F.sequence(F.lit(0), F.lit(count)), lambda back: season_code(year - back))


def round_bounds(events: DataFrame) -> DataFrame:
    """One row (next_round, last_final_round). A round is final once finished *and* checked,
    where the check column exists; without a flagged next round it is the last one plus 1."""
    final = F.coalesce(F.col("finished"), F.lit(False))
    if "data_checked" in events.columns:
        final = final & F.coalesce(F.col("data_checked"), F.lit(False))
    return events.agg(
        F.coalesce(F.min(F.when(F.col("is_next"), F.col("id"))), F.max("id") + 1).alias("next_round"),
        F.coalesce(F.max(F.when(final, F.col("id"))), F.lit(0)).alias("last_final_round"),
    )


def choose_round(available: DataFrame, bounds: DataFrame, column: str = "gameweek") -> DataFrame:
    """The published round to show: the next one, else the first after the last final one,
    else the latest (P26)."""
    c = F.col(column)
    return (
        available.join(F.broadcast(bounds), F.lit(True))
        .agg(
            F.coalesce(
                F.max(F.when(c == F.col("next_round"), c)),
                F.min(F.when(c > F.col("last_final_round"), c)),
                F.max(c),
            ).alias("chosen_round")
        )
    )


def infer_season(events: DataFrame, deadline: str = "deadline_time") -> DataFrame:
    """Season code of the earliest readable deadline."""
    first = F.min(F.try_to_timestamp(F.col(deadline).cast("string")))
    return events.agg(first.alias("_first")).select(
        season_code(F.year("_first")).alias("season_name")
    )
