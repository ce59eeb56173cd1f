"""Past rounds as scenarios of a coming one (J19R, L9R, L10R): no random draws.

Every round of the history is one scenario for every forecast. What a player did in it, against their own mean,
moves the forecast; who did not appear is absent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scenarios(forecasts: DataFrame, history: DataFrame, keys: Sequence[str], period: str, columns: Sequence[str]) -> DataFrame:
    """Every forecast once per round in the whole history, with the entity's own ``columns`` of that round, null where
    it has no row. The rounds are as many as a season has, and are attached where the forecast is."""
    k = list(keys)
    rounds = history.agg(F.array_sort(F.collect_set(period))).scalar()
    spread = forecasts.withColumn(period, F.explode(rounds))
    return spread.join(history.select(*k, period, *columns), [*k, period], "left").withColumnRenamed(period, "scenario_id")


def moved_scores(df: DataFrame, points: str, means: DataFrame, keys: Sequence[str], mean: str) -> DataFrame:
    """Forecast plus the round's deviation from the entity's mean, clipped at 0 (L9R); no row, no deviation."""
    deviation = F.coalesce(F.col(points) - F.col(mean), F.lit(0.0))
    return df.join(means, list(keys), "left").withColumn("scenario_points", F.greatest(F.lit(0.0), F.col("expected_points") + deviation))


def outcomes(df: DataFrame, points: str, started: Column) -> DataFrame:
    """starts / cameo / absent and the points that go with it (L10R)."""
    played = F.col(points).isNotNull()
    outcome = F.when(~played, "absent").when(started, "starts").otherwise("cameo")
    return df.withColumns({"played": played, "outcome": outcome, "points": F.coalesce(points, F.lit(0.0))})
