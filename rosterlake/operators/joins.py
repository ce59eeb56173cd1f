"""Joins of the panel with its dimensions.

No join carries a broadcast hint unless the side is one row or a fixed list: the size of a
dimension is for Spark to check (its size statistics, and AQE at run time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.ordered import collect_parts, first_row, numbered, top_rows
from rosterlake.session import stored


def fill_from(df: DataFrame, dim: DataFrame, on: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that keeps a value the row has and fills gaps from the dimension."""
    keys = [on] if isinstance(on, str) else list(on)
    renamed = dim.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in columns])
    joined = df.join(renamed, keys, "left")
    return joined.withColumns(
        {
            c: F.coalesce(F.col(c), F.col(f"_d_{c}")) if c in df.columns else F.col(f"_d_{c}")
            for c in columns
        }
    ).drop(*[f"_d_{c}" for c in columns])


def lookup_value(
    df: DataFrame, table: DataFrame, key: str, value: str, default: Column | None = None,
    name: str | None = None,
) -> DataFrame:
    """Value by key with a default for missing keys."""
    out = name or value
    joined = df.join(table.select(F.col(key), F.col(value).alias("_value")), key, "left")
    found = F.col("_value") if default is None else F.coalesce(F.col("_value"), default)
    return joined.withColumn(out, found).drop("_value")


def both_sides(
    df: DataFrame, dim: DataFrame, dim_key: str, own: str, opponent: str, columns: Sequence[str],
    prefixes: tuple[str, str] = ("own_", "opp_"),
) -> DataFrame:
    """A dimension joined twice, for the own and the opposing side."""
    out = df
    for key, prefix in ((own, prefixes[0]), (opponent, prefixes[1])):
        side = dim.select(
            F.col(dim_key).alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in columns]
        )
        out = out.join(side, key, "left")
    return out


def remap_by_code(archive: DataFrame, current: DataFrame) -> DataFrame:
    """Season-local ids to current ids through a stable code (J5). Rows of unknown codes drop
    out; the historic position stays, and a changed one is flagged."""
    latest = first_row(
        current.select(
            F.col("code").alias("player_code"),
            F.col("player_id").alias("_current_id"),
            F.col("element_type").alias("current_element_type"),
        ).filter(F.col("player_code").isNotNull()),
        ["player_code"],
        ["_current_id"],
    )
    joined = archive.drop("player_id").join(latest, "player_code")
    historic = F.col("element_type") if "element_type" in archive.columns else F.lit(None).cast("int")
    return joined.select(
        F.col("_current_id").alias("player_id"),
        *[c for c in joined.columns if c not in ("_current_id", "element_type")],
        F.coalesce(historic, F.col("current_element_type")).alias("element_type"),
        F.coalesce(historic != F.col("current_element_type"), F.lit(False)).alias("position_changed"),
    )


def side_value(df: DataFrame, fixtures: DataFrame, home: Column, home_value: str, away_value: str,
               name: str, key: str | list[str] = "fixture") -> DataFrame:
    """Pick the home or the away rating of a fixture (J7); a value already there wins."""
    keys = [key] if isinstance(key, str) else key
    joined = df.join(
        fixtures.select(*keys, F.col(home_value).alias("_h"), F.col(away_value).alias("_a")), keys, "left"
    )
    picked = F.when(home, F.col("_h")).otherwise(F.col("_a"))
    value = F.coalesce(F.col(name), picked) if name in df.columns else picked
    return joined.withColumn(name, value).drop("_h", "_a")


def split_members(wanted: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted ids, wanted ids without a row)."""
    return table.join(wanted.select(key), key, "left_semi"), wanted.join(table, key, "left_anti")


def pair_by_rank(
    outgoing: DataFrame, incoming: DataFrame, group: str, entity: str, score: str, limit: int | None = None,
    squad: Sequence[str] = (),
) -> DataFrame:
    """Weakest outgoing with strongest incoming, 1:1 inside a position; what is left over is paired
    over all positions; pass 1 comes first in the numbered result (J15). With ``squad`` columns
    every squad is paired on its own, and ``limit`` holds for each.

    Both sides are stored once, as narrow rows. A side's leftovers are its ranks beyond the other
    side's count in the position, and pair numbers follow from the counts, so that pairs are
    neither joined back nor numbered again."""
    k = list(squad)

    def side(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        ranked = numbered(stored(df.select(*k, group, entity, score), f"{name}-side"), [*k, group], order, "_no")
        return stored(ranked.select(*k, F.col(group).alias("_slot"), "_no", F.col(entity).alias(f"{name}_id"), F.col(score).alias(f"{name}_score")), f"{name}-ranks")

    outs, ins = side(outgoing, "out", [score, entity]), side(incoming, "in", [f"-{score}", entity])

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*k, "_slot").agg(F.max("_no").alias(name))

    slots = counts(outs, "n_out").join(counts(ins, "n_in"), [*k, "_slot"], "full").na.fill(0, ["n_out", "n_in"])
    pairs = F.least("n_out", "n_in")
    before = Window.partitionBy(*k).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumns({"_offset": F.coalesce(F.sum(pairs).over(before), F.lit(0)), "_pairs": pairs})
    totals = slots.groupBy(*k).agg(F.coalesce(F.sum("_pairs"), F.lit(0)).alias("_all"))

    first = outs.join(ins, [*k, "_slot", "_no"]).join(slots, [*k, "_slot"]).select(
        *k, F.lit(1).alias("pass"), (F.col("_offset") + F.col("_no")).alias("pair_no"), "out_id", "in_id", "out_score", "in_score"
    )
    # a row without a position has no partner in the first pass
    rest_out = outs.join(slots.select(*k, "_slot", "n_in"), [*k, "_slot"], "left").filter(F.col("_no") > F.coalesce("n_in", F.lit(0)))
    rest_in = ins.join(slots.select(*k, "_slot", "n_out"), [*k, "_slot"], "left").filter(F.col("_no") > F.coalesce("n_out", F.lit(0)))
    rest_out = numbered(stored(rest_out.select(*k, "out_id", "out_score"), "out-rest"), k, ["out_score", "out_id"], "_no")
    rest_out = rest_out.join(totals, k) if k else rest_out.withColumn("_all", totals.scalar())
    rest_in = numbered(stored(rest_in.select(*k, "in_id", "in_score"), "in-rest"), k, ["-in_score", "in_id"], "_no")
    second = rest_out.join(rest_in, [*k, "_no"]).select(
        *k, F.lit(2).alias("pass"), (F.col("_all") + F.col("_no")).alias("pair_no"), "out_id", "in_id", "out_score", "in_score"
    )
    out = first.unionByName(second).withColumn("delta", F.col("in_score") - F.col("out_score"))
    return out if limit is None else out.filter(F.col("pair_no") <= limit)


def set_delta(owned: DataFrame, optimal: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(outgoing = owned - optimal, incoming = optimal - owned)."""
    k = list(keys)
    return owned.join(optimal, k, "left_anti"), optimal.join(owned, k, "left_anti")


def apply_swaps(squad: DataFrame, swaps: DataFrame, key: str = "player_id") -> DataFrame:
    """Remove outgoing ids, add incoming ones not yet present with all flags 0."""
    kept = squad.join(swaps.select(F.col("out_id").alias(key)), key, "left_anti")
    added = (
        swaps.select(F.col("in_id").alias(key)).distinct().join(kept, key, "left_anti")
        .withColumns({c: F.lit(0) for c in squad.columns if c != key})
    )
    return kept.unionByName(added)


def shared_periods(a: DataFrame, b: DataFrame, period: str) -> DataFrame:
    """Periods both sides have."""
    return a.select(period).intersect(b.select(period))


def periods_to_show(a: DataFrame, b: DataFrame, period: str) -> DataFrame:
    """The periods both sides have, or where there is none each side's own (U3): ``period``, ``side``."""
    both = shared_periods(a, b, period).withColumn("side", F.lit("both"))
    if not both.isEmpty():
        return both
    own = a.select(period).distinct().withColumn("side", F.lit("a"))
    return own.unionByName(b.select(period).distinct().withColumn("side", F.lit("b")))


def compare_by_period(
    a: DataFrame, b: DataFrame, period: str, measures: Sequence[str]
) -> DataFrame:
    """Two entities side by side on their shared periods, with differences."""
    left = a.select(period, *[F.col(m).alias(f"{m}_a") for m in measures])
    right = b.select(period, *[F.col(m).alias(f"{m}_b") for m in measures])
    return left.join(right, period).withColumns(
        {f"{m}_gap": F.col(f"{m}_a") - F.col(f"{m}_b") for m in measures}
    )


def against_benchmark(df: DataFrame, benchmark: DataFrame, period: str, points: str) -> DataFrame:
    """Points against the period's average and best."""
    joined = df.join(benchmark.select(period, "average_score", "highest_score"), period, "left")
    return joined.withColumns(
        {
            "points_vs_average": F.col(points) - F.col("average_score"),
            "points_vs_highest": F.col(points) - F.col("highest_score"),
        }
    )


def expected_vs_actual(
    predictions: DataFrame, actual: DataFrame, chosen: DataFrame, key: str = "player_id"
) -> DataFrame:
    """Chosen entities with expected and actual points. No row when no actual is known at
    all; single gaps count 0 (J21)."""
    joined = predictions.join(chosen.select(key), key, "left_semi").join(
        actual.select(key, "actual_points"), key, "left"
    )
    known = joined.agg(F.count("actual_points")).scalar()
    return joined.filter(known > 0).withColumn(
        "actual_points", F.coalesce("actual_points", F.lit(0.0))
    )


def team_views(fixtures: DataFrame, carry: Sequence[str] = ("event",)) -> DataFrame:
    """One row per fixture and side: team, opponent, home flag, difficulty."""
    def side(home: bool) -> DataFrame:
        own, other = ("team_h", "team_a") if home else ("team_a", "team_h")
        rating = f"{own}_difficulty"
        value = F.col(rating).cast("double") if rating in fixtures.columns else F.lit(None).cast("double")
        return fixtures.select(
            F.col("id").alias("fixture"), *carry,
            F.col(own).alias("team_id"), F.col(other).alias("opponent_id"),
            F.lit(home).alias("is_home"), value.alias("difficulty"),
        )
    return side(True).unionByName(side(False))


def fixture_counts(fixtures: DataFrame) -> DataFrame:
    """Fixtures per team."""
    return team_views(fixtures, carry=()).groupBy("team_id").agg(F.count(F.lit(1)).alias("fixture_count"))


def round_multiplier(df: DataFrame, round_fixtures: DataFrame, scaled: Sequence[str] = ()) -> DataFrame:
    """Fixtures per team in the round; all 1 when the round has no fixtures."""
    counts = fixture_counts(round_fixtures)
    played = counts.agg(F.count(F.lit(1))).scalar()
    out = df.join(counts, "team_id", "left").withColumn(
        "fixture_multiplier",
        F.when(played == 0, F.lit(1.0)).otherwise(F.coalesce("fixture_count", F.lit(0)).cast("double")),
    ).drop("fixture_count")
    return out.withColumns({c: F.col(c) * F.col("fixture_multiplier") for c in scaled})


def fixture_labels(round_fixtures: DataFrame, names: DataFrame, parts: int = 1000) -> DataFrame:
    """'OPP (H) / OPP (A)' per team, in fixture order."""
    views = team_views(round_fixtures, carry=()).join(
        names.select(F.col("team_id").alias("opponent_id"), F.col("short_name").alias("_opp")),
        "opponent_id",
    )
    label = F.concat("_opp", F.when(F.col("is_home"), F.lit(" (H)")).otherwise(F.lit(" (A)")))
    return collect_parts(
        views, ["team_id"], ["fixture", "-is_home"], label, "labels", parts
    ).select("team_id", "part_no", F.array_join("labels", " / ").alias("fixture_label"))


def next_fixtures(fixtures: DataFrame, names: DataFrame, start: int, count: int = 5) -> DataFrame:
    """The next fixtures per team as columns, padded with TBC (K3)."""
    coming = team_views(fixtures.filter(F.col("event").isNotNull() & (F.col("event") >= start)))
    ranked = top_rows(coming, ["team_id"], ["event", "fixture", "-is_home"], count, "slot")
    named = ranked.join(
        names.select(F.col("team_id").alias("opponent_id"), F.col("name").alias("_opp")),
        "opponent_id", "left",
    ).withColumn(
        "label",
        F.concat(
            F.lit("GW "), F.col("event").cast("string"), F.lit(": "),
            F.coalesce("_opp", F.concat(F.lit("Team "), F.col("opponent_id").cast("string"))),
            F.when(F.col("is_home"), F.lit(" (H)")).otherwise(F.lit(" (A)")),
        ),
    )
    slots = named.groupBy("team_id").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("label"))).alias(f"fixture_{i}") for i in range(1, count + 1)],
        *[F.max(F.when(F.col("slot") == i, F.col("difficulty"))).alias(f"difficulty_{i}") for i in range(1, count + 1)],
    )
    return names.select("team_id").join(slots, "team_id", "left").withColumns(
        {f"fixture_{i}": F.coalesce(f"fixture_{i}", F.lit("TBC")) for i in range(1, count + 1)}
    )
