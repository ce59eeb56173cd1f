"""Player-level expressions: availability, duties, positions, risk, boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.constants import (
    CAPTAIN_CONFIDENCE_WEIGHT,
    CAPTAIN_MIN_START,
    CAPTAIN_START_WEIGHT,
    DUTY_COLUMNS,
    INJURY_STATUSES,
    MIN_PRIOR_MATCHES,
    POSITIONS,
    RISK_STATUSES,
    STATUS_AVAILABILITY,
)
from rosterlake.functions.numbers import as_column, clip, flag, lookup, or_zero, safe_ratio, to_number


def status_code(status: Column | str) -> Column:
    return F.lower(F.coalesce(as_column(status).cast("string"), F.lit("")))


def availability_columns(status: str, this_round: str, next_round: str) -> dict[str, Column]:
    code = status_code(status)
    this_pct = clip(to_number(this_round), 0.0, 100.0)
    next_pct = clip(to_number(next_round), 0.0, 100.0)
    doubtful = F.coalesce(this_pct < 100, F.lit(False)) | F.coalesce(next_pct < 100, F.lit(False))
    return {
        "status_availability": lookup(STATUS_AVAILABILITY, code, 0.5),
        "status_injury_flag": flag(code.isin(INJURY_STATUSES)),
        "availability_this_round": this_pct / 100.0,
        "availability_next_round": next_pct / 100.0,
        "injury_risk_flag": flag(doubtful | code.isin(RISK_STATUSES)),
    }


def duty_columns(orders: dict[str, str] = DUTY_COLUMNS) -> dict[str, Column]:
    """Per duty: has it, is first choice; and a score of one over each order."""
    out: dict[str, Column] = {}
    score = F.lit(0.0)
    for column, name in orders.items():
        order = to_number(column)
        out[f"has_{name}_duty"] = flag(order > 0)
        out[f"primary_{name}_taker"] = flag(order == 1)
        score = score + F.coalesce(F.when(order > 0, F.lit(1.0) / order), F.lit(0.0))
    out["set_piece_duty_score"] = score
    return out


def position_flags(position: Column | str) -> dict[str, Column]:
    code = as_column(position)
    return {
        f"position_{label.lower()}": flag(code == number).cast("double")
        for number, label in POSITIONS.items()
    }


def position_label(position: Column | str) -> Column:
    return lookup(POSITIONS, as_column(position).cast("int"), "N/A")


def match_measures(existing: list[str]) -> dict[str, Column]:
    """The ten derived match measures whose inputs exist."""
    goals, assists = or_zero("goals_scored"), or_zero("assists")
    made = {
        "attacking_returns": (["goals_scored", "assists"], lambda: goals + assists),
        "finishing_plus_minus": (
            ["goals_scored", "expected_goals"], lambda: goals - or_zero("expected_goals")),
        "finishing_ratio": (
            ["goals_scored", "expected_goals"], lambda: safe_ratio(goals, or_zero("expected_goals"))),
        "creation_plus_minus": (
            ["assists", "expected_assists"], lambda: assists - or_zero("expected_assists")),
        "creation_ratio": (
            ["assists", "expected_assists"], lambda: safe_ratio(assists, or_zero("expected_assists"))),
        "xgi_plus_minus": (
            ["goals_scored", "assists", "expected_goal_involvements"],
            lambda: goals + assists - or_zero("expected_goal_involvements")),
        "minutes_share": (["minutes"], lambda: or_zero("minutes") / 90.0),
        "points_per_90": (
            ["minutes", "total_points"],
            lambda: safe_ratio(or_zero("total_points") * 90.0, F.col("minutes"))),
        "tackles_plus_interceptions": (
            ["tackles", "clearances_blocks_interceptions"],
            lambda: or_zero("tackles") + or_zero("clearances_blocks_interceptions")),
        "defensive_actions": (
            ["tackles", "recoveries", "clearances_blocks_interceptions"],
            lambda: or_zero("tackles") + or_zero("recoveries")
            + or_zero("clearances_blocks_interceptions")),
    }
    return {n: build() for n, (needs, build) in made.items() if set(needs) <= set(existing)}


def reliability(history_matches: Column | None, season_minutes: Column | None = None) -> Column:
    """Share of the minimum history a player has; from minutes where matches are unknown."""
    if history_matches is not None:
        return clip(F.coalesce(history_matches, F.lit(0)) / float(MIN_PRIOR_MATCHES), 0.0, 1.0)
    if season_minutes is not None:
        return clip(F.coalesce(season_minutes, F.lit(0)) / (MIN_PRIOR_MATCHES * 90.0), 0.0, 1.0)
    return F.lit(1.0)


def resolved_availability(
    next_round: Column, this_round: Column, status: Column, multiplier: Column | None = None
) -> Column:
    """Next round, else this round, else status, else 1; zero in a blank round."""
    value = clip(F.coalesce(next_round, this_round, status, F.lit(1.0)), 0.0, 1.0)
    if multiplier is None:
        return value
    return F.when(multiplier <= 0.0, F.lit(0.0)).otherwise(value)


def captain_score(
    expected: Column, start_probability: Column, available: Column, confidence: Column
) -> Column:
    start = F.coalesce(start_probability, F.lit(0.75)) * available
    base = 1.0 - CAPTAIN_START_WEIGHT - CAPTAIN_CONFIDENCE_WEIGHT
    trust = (
        F.lit(base)
        + start * CAPTAIN_START_WEIGHT
        + F.coalesce(confidence, F.lit(70.0)) / 100.0 * CAPTAIN_CONFIDENCE_WEIGHT
    )
    return expected * F.when(start < CAPTAIN_MIN_START, trust * 0.5).otherwise(trust)


def risk_issues(status: Column, chance_next: Column, confidence_level: Column) -> Column:
    """Array of reasons to worry; empty when there is none."""
    code = F.trim(status_code(status))
    listed = F.array(
        F.when(code.isin(RISK_STATUSES), F.concat(F.lit("status="), code)),
        F.when(
            chance_next < 100.0,
            F.concat(F.lit("chance_next_round="), chance_next.cast("int").cast("string"), F.lit("%")),
        ),
        F.when(F.lower(F.trim(confidence_level)) == "low", F.lit("low_model_confidence")),
    )
    return F.filter(listed, lambda x: x.isNotNull())


def injury_risk(risk_flag: Column, this_round: Column, next_round: Column, status: Column) -> Column:
    return flag(
        (F.coalesce(risk_flag, F.lit(0)) > 0)
        | (F.coalesce(this_round, F.lit(1.0)) < 1.0)
        | (F.coalesce(next_round, F.lit(1.0)) < 1.0)
        | status_code(status).isin(RISK_STATUSES)
    )


def chance_percent(share: Column) -> Column:
    return clip(F.bround(share * 100.0, 0), 0.0, 100.0).cast("int")


def range_text(low: Column, high: Column, decimals: int = 1) -> Column:
    form = f"%.{decimals}f"
    return F.concat(F.format_string(form, low), F.lit(" - "), F.format_string(form, high))


def percent_text(share: Column) -> Column:
    return F.concat(F.format_string("%.0f", share * 100.0), F.lit("%"))


def compact_record(c: dict[str, Column]) -> Column:
    """Rounded nested record of a player, with the 80 % range as a struct."""
    return F.struct(
        c["player_id"].cast("long").alias("player_id"),
        c["full_name"].alias("full_name"),
        c["team_name"].alias("team_name"),
        c["element_type"].cast("int").alias("position"),
        F.bround(c["expected_points"], 2).alias("expected_points"),
        F.bround(c["now_cost_millions"], 2).alias("cost_m"),
        c["confidence_level"].alias("confidence_level"),
        F.bround(c["confidence_score"], 1).alias("confidence_score"),
        F.bround(c["start_probability"], 3).alias("start_probability"),
        F.struct(
            F.bround(c["expected_points_lower_80"], 2).alias("lower"),
            F.bround(c["expected_points_upper_80"], 2).alias("upper"),
        ).alias("range_80"),
    )


def role_label(multiplier: Column, captain: Column, vice: Column) -> Column:
    """'Starter x2 C', 'Bench VC', ...."""
    return F.concat_ws(
        " ",
        F.when(multiplier > 0, F.lit("Starter")).otherwise(F.lit("Bench")),
        F.when(multiplier > 1, F.concat(F.lit("x"), multiplier.cast("string"))),
        F.when(captain, F.lit("C")).when(vice, F.lit("VC")),
    )


def form_note(multiplier: Column, points: Column) -> Column:
    return (
        F.when((multiplier > 0) & (points <= 2.0), F.lit("low_impact"))
        .when((multiplier == 0) & (points >= 6.0), F.lit("bench_haul"))
        .otherwise(F.lit(""))
    )
