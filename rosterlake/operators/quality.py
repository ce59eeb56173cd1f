"""Data-quality checks. Each returns the violations; :func:`raise_if_any` is the strict form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import ROUNDS_PER_SEASON
from rosterlake.functions.seasons import season_for_date
from rosterlake.operators.ordered import lookback


def raise_if_any(violations: DataFrame, message: str) -> None:
    """Fail with their number and a few examples when a check found something."""
    found = violations.limit(10).collect()
    if found:
        total = len(found) if len(found) < 10 else violations.count()
        raise ValueError(f"{message}: {total} found, such as {[r.asDict(recursive=True) for r in found]}")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df


def null_values(df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Rows with a null in a required column, with the names of the columns (Q1)."""
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.select(*ids, gaps.alias("missing")).filter(F.size("missing") > 0)


def identity_mismatches(
    df: DataFrame, roster: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Unknown ids and fields that differ from the roster, null-safe (Q2)."""
    ref = roster.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_known"))
    joined = df.select(key, *columns).join(ref, key, "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_known").isNull(), F.lit("unknown_id")),
            *[
                F.when(F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c))
                for c in columns
            ],
        )
    )
    return joined.select(key, reasons.alias("reasons")).filter(F.size("reasons") > 0)


def missing_periods(
    df: DataFrame, season: str, period: str, expected: int = ROUNDS_PER_SEASON, first: int = 1,
    seasons: Sequence | None = None,
) -> DataFrame:
    """Rounds first..expected a season has no row for (Q3, J20). Without ``seasons`` those in the data
    are meant; a season that is asked for and absent altogether lacks all of its rounds."""
    named = df.select(season).distinct() if seasons is None else df.sparkSession.createDataFrame([(s,) for s in seasons], df.select(season).schema)
    wanted = named.select(season, F.explode(F.sequence(F.lit(first), F.lit(expected))).alias(period))
    return wanted.join(df.select(season, F.col(period).cast("int").alias(period)).distinct(), [season, period], "left_anti")


def stale_season(season: DataFrame, day: Column, ids: Sequence[str] = ()) -> DataFrame:
    """Season rows that are not the season expected on the day (Q4)."""
    return season.select(*ids, "season_name", season_for_date(day).alias("expected_season")).filter(
        ~F.col("season_name").eqNullSafe(F.col("expected_season"))
    )


def rule_drift(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rules (path, position, value) that differ, are missing, or are new."""
    a = actual.select(
        F.col("path").alias("_a_path"), F.col("position").alias("_a_position"), F.col("value").alias("actual")
    )
    e = expected.select(
        F.col("path").alias("_e_path"), F.col("position").alias("_e_position"), F.col("value").alias("expected")
    )
    on = F.col("_a_path").eqNullSafe(F.col("_e_path")) & F.col("_a_position").eqNullSafe(F.col("_e_position"))
    joined = a.join(e, on, "full_outer").select(
        F.coalesce("_a_path", "_e_path").alias("path"),
        F.coalesce("_a_position", "_e_position").alias("position"),
        "actual", "expected",
    )
    return joined.filter(~F.col("actual").eqNullSafe(F.col("expected")))


def classify_artifacts(checks: DataFrame, group: Sequence[str], priority: dict[str, Column]) -> DataFrame:
    """Status per round from row-level checks: the first violated check gives the issue;
    untagged but clean rounds are migratable; the rest are ready (Q6).

    ``priority`` maps a reason to a row condition; the reason ``untagged`` means migratable.
    """
    counts = checks.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"_{n}") for n, c in priority.items()],
    )
    chain = [F.when(F.col(f"_{n}") > 0, F.lit(n)) for n in priority if n != "untagged"]
    reason = F.coalesce(*chain, F.lit(""))
    status = F.when(reason != "", F.lit("issue")).otherwise(
        F.when(F.col("_untagged") > 0, F.lit("migratable")).otherwise(F.lit("ready"))
        if "untagged" in priority else F.lit("ready")
    )
    return counts.select(*group, "rows", status.alias("status"), reason.alias("reason"))


def several_seasons(df: DataFrame, season: str, within: Sequence[str] = ()) -> DataFrame:
    """Groups that mix seasons (Q7)."""
    return df.groupBy(*within).agg(F.countDistinct(season).alias("seasons")).filter(F.col("seasons") > 1)


def ledger_gaps(
    log: DataFrame, keys: Sequence[str], season: str, period: str
) -> DataFrame:
    """Decisions that do not follow on the one before: the round is not last + 1, the season
    changed, or a new ledger does not start at 1 (Q9)."""
    stepped = lookback(
        log, keys, [season, period], 1,
        lambda w: {"_p": F.lag(period, 1).over(w), "_s": F.lag(season, 1).over(w)},
    )
    reason = (
        F.when(F.col("_p").isNull() & (F.col(period) != 1), F.lit("does_not_start_at_1"))
        .when(F.col("_s") != F.col(season), F.lit("season_changed"))
        .when(F.col(period) != F.col("_p") + 1, F.lit("not_consecutive"))
    )
    return stepped.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_p", "_s")


def conform(df: DataFrame, types: dict[str, str], defaults: dict[str, object] | None = None,
            required: Sequence[str] = ()) -> DataFrame:
    """Columns in a fixed order and type; missing optional ones and their nulls take the
    default, missing required ones raise (P24)."""
    require_columns(df, required)
    fill = defaults or {}
    def column(name: str, kind: str) -> Column:
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if name not in fill:
            return value.alias(name)
        default = fill[name] if isinstance(fill[name], Column) else F.lit(fill[name])
        return F.coalesce(value, default.cast(kind)).alias(name)
    return df.select(*[column(n, k) for n, k in types.items()])


def all_conditions(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
