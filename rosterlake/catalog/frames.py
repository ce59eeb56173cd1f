"""The training frame and the target frame as wholes, held against SQL by a checksum of every column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake import session
from rosterlake.catalog.base import PARTS, query
from rosterlake.catalog.relations import _FIX
from rosterlake.catalog.scoring import _FILLED, domain_tables, stored, stored_rows
from rosterlake.constants import BASE_STATS, MIN_PRIOR_MATCHES, POSITIONS, ROLLING_WINDOW, TEAM_STATS
from rosterlake.plans import features

_OTHER = [s for s in BASE_STATS if s not in _FILLED]
_STATS = {
    "minutes": "q % 91", "total_points": "q % 13", "goals_scored": "ln % 3", "assists": "ln % 2", "expected_goals": "disc", "expected_assists": "tax", "value": "q % 60 + 40",
    **{stat: f"(q * {k + 3} + ln * {k + 1}) % {k + 2}" for k, stat in enumerate(_OTHER)},
}
_DERIVED = {
    "attacking_returns": "goals_scored + assists", "finishing_plus_minus": "goals_scored - expected_goals", "finishing_ratio": "goals_scored / nullif(expected_goals, 0)",
    "creation_plus_minus": "assists - expected_assists", "creation_ratio": "assists / nullif(expected_assists, 0)",
    "xgi_plus_minus": "goals_scored + assists - expected_goal_involvements", "minutes_share": "minutes / 90.0", "points_per_90": "total_points * 90.0 / nullif(minutes, 0)",
    "tackles_plus_interceptions": "tackles + clearances_blocks_interceptions", "defensive_actions": "tackles + recoveries + clearances_blocks_interceptions",
}
_ALL = [*BASE_STATS, *_DERIVED]
_MA = ROLLING_WINDOW
_TEAM = {
    "team_goals_for": "gf", "team_goals_against": "ga", "team_goal_diff": "gf - ga", "team_clean_sheet": "(ga = 0)::int", "team_conceded_two_plus": "(ga >= 2)::int",
    "team_match_points": "case when gf > ga then 3 when gf = ga then 1 else 0 end",
}
assert list(_TEAM) == TEAM_STATS

# The prepared history of the domain tables: players = parts, clubs = suppliers, matches = orders between two clubs.
_PANEL = f"""
{PARTS.strip()},
{_FIX.strip()},
raw as (
  select l_partkey as player_id, f.id as fixture, coalesce(f.event, 6) as round, year(o_orderdate) as season, o_orderdate as kick, max((l_suppkey = team_h)::int) = 1 as was_home, any_value(team_h) as team_h, any_value(team_a) as team_a,
    any_value(team_h_difficulty) as dh, any_value(team_a_difficulty) as da, any_value(cast(round(o_totalprice) as bigint)) as cents,
    sum(l_quantity)::double as q, max(l_linenumber) as ln, max(l_discount)::double as disc, max(l_tax)::double as tax
  from lineitem join orders on l_orderkey = o_orderkey join fx f on f.id = l_orderkey group by 1, 2, 3, 4, 5
),
base as (
  select r.player_id, fixture, round, season, kick, was_home, case when was_home then team_h else team_a end as team, case when was_home then team_a else team_h end as opponent, element_type,
    coalesce(case when was_home then dh else da end, 3.0)::double as fixture_difficulty, case when was_home then cents % 4 else cents % 3 end as gf, case when was_home then cents % 3 else cents % 4 end as ga,
    {", ".join(f"({e})::double as {n}" for n, e in _STATS.items())}
  from raw r join part_scores using (player_id)
),
panel as (select *, {", ".join(f"({e})::double as {n}" for n, e in _DERIVED.items())}, (select max(season) from base) as latest from base)"""


def _known(last_final: int) -> str:
    return f"""
known as (select * from panel where season < latest or round <= {last_final}),
matches as (select distinct season, fixture, round, kick, team, {", ".join(f"{e} as {n}" for n, e in _TEAM.items())} from known)"""


def _checksums(frame: str, columns: list[str]) -> str:
    sums = ", ".join(f"sum(cast(round({c}, 6) as decimal(20, 6)))::double as {c}" for c in columns)
    return f"select name, round(total, 6) as total from (unpivot (select count(*)::double as n_rows, {sums} from {frame}) on columns(*) into name name value total)"


def _rounded_sum(c: str) -> Column:
    """The sum of a column's values rounded at 6 places. Millionths are whole numbers, so they are counted as such: only a value
    that is large, or that may lie half-way between two of them, goes through a decimal."""
    value = F.col(c).cast("double")
    millionths = value * 1e6
    plain = (F.abs(millionths) < 4e9) & (F.abs(millionths - F.floor(millionths) - 0.5) > 1e-3)
    whole = F.sum(F.when(plain, F.floor(millionths + 0.5))).cast("decimal(20,0)") * F.lit(1e-6).cast("decimal(7,6)")
    other = F.sum(F.when(~plain, F.round(value, 6).cast("decimal(20,6)")))
    return F.coalesce(whole + other, whole, other).cast("double")


def checksums(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(name, total): the rows, and the sum of every column with its values rounded at 6 places."""
    sums = [_rounded_sum(c).alias(c) for c in columns]
    totals = frame.agg(F.count(F.lit(1)).cast("double").alias("n_rows"), *sums)
    return totals.unpivot([], ["n_rows", *columns], "name", "total").withColumn("total", F.round("total", 6))


_LAGGED = [f"{s}_ma{_MA}" for s in _ALL] + [f"{s}_lag1" for s in _ALL]
_TEAMED = [f"{p}{s}_ma{_MA}" for p in ("", "opp_") for s in TEAM_STATS]
_SIDED = ["was_home", "fixture_difficulty"]
_PLACED = [f"position_{p.lower()}" for p in POSITIONS.values()]
_POSITION_SQL = ", ".join(f"(element_type = {n})::int as position_{p.lower()}" for n, p in POSITIONS.items())
_WINDOW = "(partition by player_id, season order by round, kick, fixture"

_TRAINING = f"""with {_PANEL.strip()},{_known(12)},
form as (select *, {", ".join(f"avg({n}) over (partition by team, season order by round, kick, fixture rows between {_MA} preceding and 1 preceding) as {n}_ma{_MA}" for n in TEAM_STATS)} from matches),
rolled as (
  select *, row_number() over {_WINDOW}) - 1 as prior,
    {", ".join(f"avg({n}) over {_WINDOW} rows between {_MA} preceding and 1 preceding) as {n}_ma{_MA}, lag({n}) over {_WINDOW}) as {n}_lag1" for n in _ALL)}
  from known
),
frame as (
  select prior as prev_matches, minutes, total_points, {", ".join(f"coalesce(r.{n}, 0) as {n}" for n in _LAGGED)},
    {", ".join(f"coalesce({a}.{s}_ma{_MA}, 0) as {p}{s}_ma{_MA}" for p, a in (("", "o"), ("opp_", "x")) for s in TEAM_STATS)}, was_home::int as was_home, fixture_difficulty, {_POSITION_SQL}
  from rolled r left join form o on o.season = r.season and o.fixture = r.fixture and o.team = r.team left join form x on x.season = r.season and x.fixture = r.fixture and x.team = r.opponent
  where prior >= {MIN_PRIOR_MATCHES}
)
"""
_TRAINED = ["prev_matches", "minutes", "total_points", *_LAGGED, *_TEAMED, *_SIDED, *_PLACED]


@query("feature_build", _TRAINING + _checksums("frame", _TRAINED))
def feature_build(spark, sf):
    """The whole training frame: lags, rolling means, team and opponent context, targets; the rows and a sum of each column."""
    hist, elements, _, _ = domain_tables(spark, sf)
    hist, elements = stored(spark, hist), stored_rows(spark, elements, "elements")
    pieces = features.player_pieces(hist, features.SORTED_ROWS)
    prepared = features.laid_out(features.prepare_history(hist, elements, pieces=pieces), pieces)
    with session.fewer_keys(spark):
        return session.stored(checksums(features.training_frame(prepared, 12, windows=(_MA,), pieces=pieces), _TRAINED), "sums")


_TARGET = f"""with {_PANEL.strip()},{_known(6)},
back as (select *, row_number() over (partition by player_id order by season = latest desc, season desc, round desc, kick desc, fixture desc) as back from known),
newest as (select player_id, season as last_season, was_home, fixture_difficulty, {", ".join(f"{n} as {n}_lag1" for n in _ALL)} from back where back = 1),
means as (select player_id, {", ".join(f"avg({n}) as {n}_ma{_MA}" for n in _ALL)} from back join newest using (player_id) where back <= {_MA} and season = last_season group by 1),
counts as (select player_id, count(*) as history_match_count from known group by 1),
tail as (select *, row_number() over (partition by team order by season desc, round desc, kick desc, fixture desc) as rn from matches where season = (select max(season) from panel)),
recent as (select team, {", ".join(f"avg({n}) as {n}_ma{_MA}" for n in TEAM_STATS)} from tail where rn <= {_MA} group by 1),
target as (
  select v.team_id, count(*) as fixture_count, avg(is_home::int) as was_home, avg(coalesce(difficulty, 3.0)) as fixture_difficulty,
    {", ".join(f"max(coalesce(o.{s}_ma{_MA}, 0)) as {s}_ma{_MA}, avg(coalesce(x.{s}_ma{_MA}, 0)) as opp_{s}_ma{_MA}" for s in TEAM_STATS)}
  from (select * replace (coalesce(event, 6) as event) from views) v left join recent o on o.team = v.team_id left join recent x on x.team = v.opponent_id where v.event = 7 group by 1
),
prices as (select player_id, arg_max(value, (round, kick, fixture)) / 10.0 as price from panel where season = latest and round = 7 group by 1),
frame as (
  select coalesce(history_match_count, 0) as history_match_count, fixture_count, coalesce(price, now_cost_millions) as now_cost_millions,
    {", ".join(f"coalesce({n}, 0) as {n}" for n in [*_LAGGED, *_TEAMED])}, coalesce(t.was_home, n.was_home::int, 0) as was_home, coalesce(t.fixture_difficulty, n.fixture_difficulty, 0) as fixture_difficulty, {_POSITION_SQL}
  from part_scores p left join newest n using (player_id) left join means using (player_id) left join counts using (player_id) left join target t on t.team_id = p.player_id % 100 left join prices using (player_id)
)
"""
_TARGETED = ["history_match_count", "fixture_count", "now_cost_millions", *_LAGGED, *_TEAMED, *_SIDED, *_PLACED]


@query("frame_assembly", _TARGET + _checksums("frame", _TARGETED))
def frame_assembly(spark, sf):
    """One row per player with the features of the next round; the rows and a sum of each column."""
    hist, elements, teams, fx = domain_tables(spark, sf)
    hist, elements = stored(spark, hist), stored_rows(spark, elements, "elements")
    pieces = features.player_pieces(hist)
    prepared = features.laid_out(features.prepare_history(hist, elements, pieces=pieces), pieces)
    return checksums(features.target_frame(prepared, elements, teams, fx, 7, 6), _TARGETED)
