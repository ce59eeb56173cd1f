"""The leak-safe feature plan: history panel -> training frame and target frame."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.constants import BASE_STATS, ROLLING_WINDOW, TEAM_STATS
from rosterlake.functions.numbers import flag, number_columns, to_number
from rosterlake.functions.players import match_measures, position_flags
from rosterlake.functions.seasons import season_start_year
from rosterlake.operators.joins import fill_from, team_views
from rosterlake.operators.ordered import first_row, is_hot, last_row, lookback, top_rows
from rosterlake.operators.panel import form, prior_count, tail_mean
from rosterlake.session import stored, stored_by, with_setting

HISTORY_ORDER = ["season_sort", "round", "kickoff_sort", "fixture"]
MATCH_KEY = ["player_id", "fixture", "round", "season_name"]
PLAYER_SEASON = ["player_id", "season_name"]

# Rows in one piece of a panel laid out by player: at most about PIECE_ROWS, and no fewer than LEAST_ROWS for the sake of more tasks.
PIECE_ROWS, LEAST_ROWS = 500_000, 50_000
# The same where whole rows are sorted, twice in one task.
SORTED_ROWS = 200_000


def add_sort_keys(hist: DataFrame, seasons: DataFrame | None = None) -> DataFrame:
    """Chronological keys: season year (an unknown season comes after the last one) and the
    parsed kickoff. ``seasons`` are rows with the same seasons that are cheaper to read."""
    year = season_start_year("season_name")
    unknown = (hist if seasons is None else seasons).agg(F.max(year) + 1).scalar()
    kickoff = (
        F.try_to_timestamp(F.col("kickoff_time").cast("string"))
        if "kickoff_time" in hist.columns else F.lit(None).cast("timestamp")
    )
    return hist.withColumns(
        {"season_sort": F.coalesce(year, unknown, F.lit(0)).cast("int"), "kickoff_sort": kickoff}
    )


def is_current(hist: DataFrame, season: str | None = None) -> Column:
    """Rows of the named season, else of the latest season present."""
    if season is not None:
        return F.coalesce(F.col("season_name") == season, F.lit(False))
    year = season_start_year("season_name")
    return F.coalesce(year == hist.agg(F.max(year)).scalar(), F.lit(False))


def as_of(hist: DataFrame, last_final: int, season: str | None = None) -> DataFrame:
    """Only what was known once a round was final: earlier seasons in full, the current one up
    to that round, nothing later (P8, V1)."""
    current = is_current(hist, season)
    if season is None:
        return hist.filter(~current | (F.col("round") <= last_final))
    earlier = season_start_year("season_name") <= season_start_year(F.lit(season))
    return hist.filter(
        F.coalesce(earlier, F.lit(True)) & (~current | (F.col("round") <= last_final))
    )


def match_result(hist: DataFrame) -> DataFrame:
    """Goals for and against, clean sheet, conceded two or more, match points."""
    home = F.coalesce("was_home", F.lit(False))
    gf = F.when(home, F.col("team_h_score")).otherwise(F.col("team_a_score"))
    ga = F.when(home, F.col("team_a_score")).otherwise(F.col("team_h_score"))
    return hist.withColumns(
        {
            "team_goals_for": gf,
            "team_goals_against": ga,
            "team_goal_diff": gf - ga,
            "team_clean_sheet": flag(ga == 0),
            "team_conceded_two_plus": flag(ga >= 2),
            "team_match_points": F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0),
        }
    )


def team_matches(hist: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per (season, match, team): the panel repeats a match once per player, and the
    windows must not. The first row in ``order`` is the least one, so each map task sends one
    row per match, each value once, and nothing is sorted between tasks."""
    match = ["season_name", "fixture", "team"]
    needed = [c for c in dict.fromkeys([*order, "was_home", "team_h_score", "team_a_score"]) if c not in match]
    place = F.struct(*[x for c in needed for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))])
    first = hist.filter(F.col("team").isNotNull() & F.col("fixture").isNotNull()).groupBy(*match).agg(F.min(place).alias("_first"))
    return match_result(first.select(*match, *[F.col(f"_first.{c}") for c in needed]))


def team_form(
    hist: DataFrame, order: Sequence[str] = HISTORY_ORDER, windows: Sequence[int] = (ROLLING_WINDOW,),
    hot: bool | None = None,
) -> DataFrame:
    """Rolling team statistics before each match."""
    return form(
        team_matches(hist, order), ["team", "season_name"], order, TEAM_STATS, windows, lags=False, hot=hot
    )


def add_team_context(
    hist: DataFrame, order: Sequence[str] = HISTORY_ORDER, windows: Sequence[int] = (ROLLING_WINDOW,),
    hot: bool | None = None, pieces: int | None = None,
) -> DataFrame:
    """Own and opposing team form on every row.

    Both forms are joined to the few distinct (match, team, opponent) pairs; the panel itself
    is joined, and shuffled, once. A panel laid out by player in ``pieces`` stays where it is: who played
    which match goes to the forms of its teams and comes back with them by player.
    """
    if hot is None:
        hot = is_hot(hist, ["season_name", "team"], "fixture")
    rolled = team_form(hist, order, windows, hot)
    names = [f"{s}_ma{w}" for w in windows for s in TEAM_STATS]
    if pieces:
        return _context_by_player(hist, rolled, names, pieces)
    own = rolled.select("season_name", "fixture", "team", *names)
    opposing = rolled.select(
        "season_name", "fixture", F.col("team").alias("opponent_team"),
        *[F.col(n).alias(f"opp_{n}") for n in names],
    )
    match = ["season_name", "fixture", "team", "_rival"]
    rival = _rival()
    pairs = (
        hist.select("season_name", "fixture", "team", "opponent_team").distinct()
        .join(own, ["season_name", "fixture", "team"], "left")
        .join(opposing, ["season_name", "fixture", "opponent_team"], "left")
        .withColumn("_rival", rival).drop("opponent_team")
    )
    return hist.withColumn("_rival", rival).join(pairs, match, "left").drop("_rival")


def _rival() -> Column:
    """One plain key even where the opponent is unknown, so that the own form is still found."""
    return F.coalesce(F.col("opponent_team").cast("long"), F.lit(-(2**63)))


def _context_by_player(hist: DataFrame, rolled: DataFrame, names: Sequence[str], pieces: int) -> DataFrame:
    """Team form for a panel in ``pieces`` by player. Both forms are met where the match is, and what comes back is dealt as the
    panel is; under ``session.fewer_keys`` no join deals anything again."""
    match = ["season_name", "fixture"]
    key = ["player_id", *match, "team", "_rival"]
    played = hist.filter(F.col("team").isNotNull() & F.col("fixture").isNotNull()).select("player_id", *match, "team", "opponent_team")
    forms = rolled.select(*match, "team", *names).repartition(pieces, *match)

    def side(team: str, prefix: str) -> DataFrame:
        # both sides rename every column, so that Spark sees the same shuffle twice and runs it once
        return forms.select(*match, F.col("team").alias(team), *[F.col(n).alias(f"{prefix}{n}") for n in names])

    context = (
        played.repartition(pieces, *match).distinct().withColumn("_own", F.col("team"))
        .join(side("_own", "_own_"), [*match, "_own"], "left").join(side("opponent_team", "opp_"), [*match, "opponent_team"], "left")
        .select(*key[:-1], _rival().alias("_rival"), *[F.col(f"_own_{n}").alias(n) for n in names], *[f"opp_{n}" for n in names])
    )
    return hist.withColumn("_rival", _rival()).join(context.repartition(pieces, "player_id"), key, "left").drop("_rival")


def player_pieces(hist: DataFrame, piece_rows: int = PIECE_ROWS) -> int | None:
    """Into how many pieces by player a panel is to be laid out: their number follows the rows. None where one player has more
    rows than a task should get."""
    if is_hot(hist.filter(F.col("player_id").isNotNull()), ["player_id"]):
        return None
    rows, shuffles = hist.count(), int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(shuffles, math.ceil(rows / LEAST_ROWS)), math.ceil(rows / piece_rows))


def dealt_by_player(typed: DataFrame, numbers: DataFrame, stats: Sequence[str], pieces: int) -> DataFrame:
    """The rows dealt into pieces by player. Statistics that hold nothing but whole numbers of one byte travel as such: as doubles
    they are most of what a row weighs. One pass over ``numbers``, the rows before any join, tells which."""
    value = {c: F.col(c).cast("double") for c in stats}
    fits = {c: F.coalesce((v == F.floor(v)) & v.between(-128, 127), F.lit(True)) for c, v in value.items()}
    found = numbers.agg(*[F.bool_and(f).alias(c) for c, f in fits.items()]).first() if stats else {}
    small = [c for c in stats if found[c]]
    if not small:
        return typed.repartition(pieces, "player_id")
    packed = typed.withColumn("_small", F.array(*[F.col(c).cast("tinyint") for c in small])).drop(*small).repartition(pieces, "player_id")
    return packed.select(*[
        F.col("_small")[small.index(c)].cast(typed.schema[c].dataType).alias(c) if c in small else F.col(c) for c in typed.columns
    ])


def prepare_history(
    hist: DataFrame, elements: DataFrame, fixtures: DataFrame | None = None, pieces: int | None = None
) -> DataFrame:
    """Types, sort keys, gaps filled from the roster, derived measures, position flags.

    The club of a row is the row's own, else the fixture's side (V11), else the roster's. With ``pieces`` the rows are dealt by
    player before they meet the roster, so that they move once, and before the measures widen them.
    """
    known = hist.filter(F.col("player_id").isNotNull() & F.col("season_name").isNotNull())
    typed = numbers = known.withColumns(
        number_columns(BASE_STATS, hist)
    )
    if "team" not in typed.columns:
        typed = typed.withColumn("team", F.lit(None).cast("int"))
    if fixtures is not None and "season_name" in fixtures.columns:
        sides = fixtures.select(
            "season_name", F.col("id").alias("fixture"), F.col("team_h").alias("_h"), F.col("team_a").alias("_a")
        )
        typed = typed.join(sides, ["season_name", "fixture"], "left").withColumn(
            "team",
            F.coalesce("team", F.when(F.col("was_home"), F.col("_h")).when(~F.col("was_home"), F.col("_a"))),
        ).drop("_h", "_a")
    if pieces:
        typed = dealt_by_player(typed, numbers, [c for c in BASE_STATS if c in typed.columns], pieces)
    roster = elements.select("player_id", F.col("team_id").alias("team"), "element_type")
    filled = fill_from(typed, roster, "player_id", ["team", "element_type"])
    difficulty = [c for c in ("fixture_difficulty", "difficulty") if c in filled.columns]
    return add_sort_keys(
        filled.withColumns(
            {
                **match_measures(filled.columns),
                **position_flags("element_type"),
                "fixture_difficulty": F.coalesce(*[to_number(c) for c in difficulty], F.lit(3.0)),
            }
        ),
        known,
    )


def laid_out(prepared: DataFrame, pieces: int | None = None) -> DataFrame:
    """The prepared panel as a table in shared storage. Form, team context, counts and prices each read the few columns that
    they need from it, and none prepares the history again. A panel prepared in ``pieces`` is stored in them, so that form, counts
    and prices by player shuffle nothing. The projection is too long for one method that the JVM would compile,
    so Spark is asked to split it while the table is written."""
    with with_setting(prepared.sparkSession, "spark.sql.codegen.hugeMethodLimit", "8000"):
        return stored_by(prepared, "panel", "player_id", pieces) if pieces else stored(prepared, "panel")


def stat_names(prepared: DataFrame) -> list[str]:
    derived = [c for c in match_measures(BASE_STATS) if c in prepared.columns]
    return [s for s in BASE_STATS if s in prepared.columns] + derived


def feature_names(prepared: DataFrame, windows: Sequence[int] = (ROLLING_WINDOW,)) -> list[str]:
    stats = stat_names(prepared)
    return (
        [f"{s}_ma{w}" for w in windows for s in stats]
        + [f"{s}_lag1" for s in stats]
        + [f"{p}{s}_ma{w}" for w in windows for p in ("", "opp_") for s in TEAM_STATS]
        + ["was_home", "fixture_difficulty"]
        + ["position_gk", "position_def", "position_mid", "position_fwd"]
    )


def training_frame(
    prepared: DataFrame, last_final: int, season: str | None = None,
    windows: Sequence[int] = (ROLLING_WINDOW,), hot: bool | None = None, pieces: int | None = None,
) -> DataFrame:
    """Rows with enough history of completed rounds: features (gaps as 0), target and time keys. A panel laid out in ``pieces``
    is not shuffled where the frame is used under ``session.fewer_keys``."""
    known = as_of(prepared, last_final, season)
    if hot is None:
        hot = is_hot(known, PLAYER_SEASON)
    # the team join comes first: after the windows its shuffle would carry every feature
    placed = add_team_context(known, windows=windows, pieces=pieces)
    rolled = form(placed, PLAYER_SEASON, HISTORY_ORDER, stat_names(prepared), windows, hot=hot)
    full = prior_count(rolled, PLAYER_SEASON, HISTORY_ORDER, hot=hot).filter("enough_prev")
    names = feature_names(prepared, windows)
    return full.select(
        *MATCH_KEY, "season_sort", "kickoff_sort", "element_type", "prev_matches",
        F.col("minutes").cast("double").alias("minutes"),
        F.col("total_points").cast("double").alias("total_points"),
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names],
    )


def target_context(
    prepared: DataFrame, fixtures: DataFrame, next_round: int, last_final: int,
    season: str | None = None, windows: Sequence[int] = (ROLLING_WINDOW,),
) -> DataFrame:
    """Per team with a fixture in the target round: home share, difficulty, own form and the
    mean form of its opponents, after the last known match (G16)."""
    known = as_of(prepared, last_final, season).filter(is_current(prepared, season))
    matches = team_matches(known, HISTORY_ORDER)
    recent = None
    for w in windows:
        part = tail_mean(matches, ["team"], HISTORY_ORDER, TEAM_STATS, w)
        recent = part if recent is None else recent.join(part, "team")
    names = [f"{s}_ma{w}" for w in windows for s in TEAM_STATS]
    target = team_views(fixtures.filter(F.col("event").cast("int") == next_round), carry=())
    own = recent.select(F.col("team").alias("team_id"), *names)
    opposing = recent.select(F.col("team").alias("opponent_id"), *[F.col(n).alias(f"opp_{n}") for n in names])
    per_team = (
        target.join(opposing, "opponent_id", "left").groupBy("team_id").agg(
            F.count(F.lit(1)).alias("fixture_count"),
            F.avg(F.col("is_home").cast("double")).alias("was_home"),
            F.avg(F.coalesce("difficulty", F.lit(3.0))).alias("fixture_difficulty"),
            *[F.avg(F.coalesce(f"opp_{n}", F.lit(0.0))).alias(f"opp_{n}") for n in names],
        )
    )
    return per_team.join(own, "team_id", "left").withColumns(
        {n: F.coalesce(n, F.lit(0.0)) for n in names}
    )


def player_form(
    prepared: DataFrame, last_final: int, season: str | None = None, mode: str = "target_row",
    windows: Sequence[int] = (ROLLING_WINDOW,),
) -> DataFrame:
    """Form of each player on entering the next round.

    ``target_row`` (V2): over the last matches of the player's latest season, the newest
    included. ``latest_row``: the newest match's own lagged features. Either way the current
    season comes first and an older one is the fallback (J8).
    """
    known = as_of(prepared, last_final, season)
    current = flag(is_current(prepared, season))
    stats = stat_names(prepared)
    order = ["_current", *HISTORY_ORDER]
    if mode == "latest_row":
        rolled = form(known, PLAYER_SEASON, HISTORY_ORDER, stats, windows).withColumn("_current", current)
        return last_row(rolled, ["player_id"], order).select(
            "player_id", "was_home", "fixture_difficulty",
            *[f"{s}_ma{w}" for w in windows for s in stats], *[f"{s}_lag1" for s in stats],
        )
    newest_first = [f"-{c}" for c in order]
    rows = top_rows(
        known.withColumn("_current", current), ["player_id"], newest_first, max(windows), "_back"
    )
    # at most max(windows) rows per player are left here, the newest of all seasons; they are read once
    newest = F.col("_back") == 1
    of_player = rows.withColumn("_season", F.max(F.when(newest, F.col("season_name"))).over(Window.partitionBy("player_id")))
    same = F.col("season_name") == F.col("_season")
    return of_player.filter(F.col("player_id").isNotNull()).groupBy("player_id").agg(
        *[F.max(F.when(newest, F.col(c))).alias(c) for c in ("was_home", "fixture_difficulty")],
        *[F.max(F.when(newest, F.col(s))).alias(f"{s}_lag1") for s in stats],
        *[F.avg(F.when(same & (F.col("_back") <= w), F.col(s))).alias(f"{s}_ma{w}") for w in windows for s in stats],
    )


def entry_prices(prepared: DataFrame, next_round: int, season: str | None = None) -> DataFrame:
    """Price a player had on entering the target round."""
    rows = prepared.filter(
        is_current(prepared, season) & (F.col("round") == next_round) & F.col("value").isNotNull()
    )
    return last_row(rows, ["player_id"], HISTORY_ORDER).select(
        "player_id", (F.col("value") / 10.0).alias("_entry_price")
    )


def target_frame(
    prepared: DataFrame, elements: DataFrame, teams: DataFrame, fixtures: DataFrame,
    next_round: int, last_final: int, season: str | None = None, official_next: int | None = None,
    mode: str = "target_row", windows: Sequence[int] = (ROLLING_WINDOW,),
) -> DataFrame:
    """One row per player of the roster with the features of the next round."""
    form_now = player_form(prepared, last_final, season, mode, windows)
    context = target_context(prepared, fixtures, next_round, last_final, season, windows)
    counts = as_of(prepared, last_final, season).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("history_match_count")
    )
    roster = first_row(elements, ["player_id"], ["player_id"]).join(
        teams.select("team_id", F.col("name").alias("team_name")), "team_id", "left"
    )
    names = feature_names(prepared, windows)
    sided = ["was_home", "fixture_difficulty"]
    target = context.select(
        "team_id", "fixture_count", *[F.col(c).alias(f"_t_{c}") for c in sided],
        *[n for n in names if n.startswith(("team_", "opp_team_"))],
    )
    joined = (
        roster.withColumns(position_flags("element_type"))
        .join(target, "team_id", "left")  # by team while the rows are few columns wide
        .join(form_now.withColumn("was_home", F.col("was_home").cast("double")), "player_id", "left")
        .join(counts, "player_id", "left")
        .withColumns({c: F.coalesce(f"_t_{c}", c) for c in sided})
        .drop(*[f"_t_{c}" for c in sided])
    )
    if "value" in prepared.columns:
        joined = joined.join(entry_prices(prepared, next_round, season), "player_id", "left").withColumn(
            "now_cost_millions", F.coalesce("_entry_price", "now_cost_millions")
        ).drop("_entry_price")
    if "official_ep_next" in joined.columns:
        joined = gate_forecast(joined, next_round, official_next)
    return joined.withColumns(
        {
            "history_match_count": F.coalesce("history_match_count", F.lit(0)),
            **{n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names},
        }
    )


def gate_forecast(df: DataFrame, next_round: int, official_next: int | None) -> DataFrame:
    """The outside forecast counts only for the official next round."""
    if official_next is None or next_round == official_next:
        return df
    return df.withColumn("official_ep_next", F.lit(None).cast("double"))


def as_of_form(
    hist: DataFrame, keys: Sequence[str], order: Sequence[str], stats: Sequence[str], period: str,
    first: int, last: int, size: int = ROLLING_WINDOW, hot: bool | None = None,
) -> DataFrame:
    """Form on entering *every* period first..last in one job (M14): the mean over a row and
    its predecessors holds from the next period until the group's next row."""
    behind = lookback(
        hist, keys, order, size - 1,
        lambda w: {
            **{f"{s}_ma{size}": F.avg(s).over(w.rowsBetween(-(size - 1), 0)) for s in stats},
            **{f"{s}_lag1": F.col(s) for s in stats},
        },
        hot=hot,
    )
    ahead = [c[1:] if c.startswith("-") else f"-{c}" for c in order]
    until = lookback(behind, keys, ahead, 1, lambda w: {"_next": F.lag(period, 1).over(w)}, hot=hot)
    begin = F.greatest(F.col(period) + 1, F.lit(first))
    end = F.least(F.coalesce("_next", F.lit(last)), F.lit(last))
    return until.filter(begin <= end).select(
        *keys, F.explode(F.sequence(begin, end)).alias("target_period"),
        *[f"{s}_ma{size}" for s in stats], *[f"{s}_lag1" for s in stats],
    )
