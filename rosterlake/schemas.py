"""Explicit schemas of the landed documents. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from rosterlake.constants import BASE_STATS

_TEXT_STATS = [
    "influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists",
    "expected_goal_involvements", "expected_goals_conceded",
]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


L, I, D, S, B = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()

HISTORY_ROW = _struct(
    element=L, fixture=I, opponent_team=I, total_points=D, was_home=B, kickoff_time=S,
    team_h_score=I, team_a_score=I, round=I, season_name=S, modified=B,
    **{s: (S if s in _TEXT_STATS else D) for s in BASE_STATS if s not in ("total_points",)},
)
HISTORY_DOCUMENT = _struct(
    doc=S, history=T.ArrayType(HISTORY_ROW), _fetched_ts=L, _history_season_codes=T.ArrayType(S), _history_seasons=I,
)

ELEMENT = _struct(
    id=L, code=L, first_name=S, second_name=S, web_name=S, team=I, element_type=I, now_cost=I,
    minutes=I, status=S, news=S, ep_next=S, price_change_percent=S,
    chance_of_playing_this_round=D, chance_of_playing_next_round=D,
    corners_and_indirect_freekicks_order=D, direct_freekicks_order=D, penalties_order=D,
    expected_goals_per_90=D, expected_assists_per_90=D, clean_sheets_per_90=D,
)
TEAM = _struct(
    id=I, name=S, short_name=S, strength=I,
    strength_overall_home=I, strength_overall_away=I, strength_attack_home=I, strength_attack_away=I,
    strength_defence_home=I, strength_defence_away=I,
)
EVENT = _struct(
    id=I, name=S, deadline_time=S, finished=B, data_checked=B, is_previous=B, is_current=B, is_next=B,
    average_entry_score=I, highest_score=I,
)
ELEMENT_TYPE = _struct(id=I, singular_name_short=S, squad_select=I, squad_min_play=I, squad_max_play=I)
CHIP = _struct(name=S, number=I, start_event=I, stop_event=I)
RULES = _struct(
    squad_squadplay=I, squad_squadsize=I, squad_team_limit=I, squad_total_spend=I,
    ui_currency_multiplier=I, max_extra_free_transfers=I, transfers_cap=I,
)
BOOTSTRAP = _struct(
    elements=T.ArrayType(ELEMENT), teams=T.ArrayType(TEAM), events=T.ArrayType(EVENT),
    element_types=T.ArrayType(ELEMENT_TYPE), chips=T.ArrayType(CHIP),
    # scoring mixes numbers and maps of any keys, so it is read as it is
    game_config=_struct(rules=RULES, scoring=T.VariantType()),
)

FIXTURE = _struct(
    id=I, event=I, team_h=I, team_a=I, team_h_difficulty=I, team_a_difficulty=I,
    team_h_score=I, team_a_score=I, kickoff_time=S, finished=B,
)
PICKS = _struct(
    picks=T.ArrayType(_struct(element=L, position=I, multiplier=I, is_captain=B, is_vice_captain=B)),
)
STANDINGS = _struct(
    league=_struct(id=L, name=S),
    standings=_struct(
        has_next=B, page=I,
        results=T.ArrayType(_struct(entry=L, entry_name=S, player_name=S, rank=I, last_rank=I, total=I, event_total=I)),
    ),
)
TEAM_CSV = _struct(player_id=S, full_name=S, starting=S, bench=S, captain=S)
PREDICTION_TYPES = {
    "player_id": "bigint", "full_name": "string", "team_name": "string", "team_id": "int",
    "element_type": "int", "now_cost_millions": "double", "expected_points": "double",
    "start_probability": "double", "appearance_probability": "double", "cameo_points": "double",
    "fixture_multiplier": "double", "confidence_score": "double",
    "expected_points_lower_80": "double", "expected_points_upper_80": "double",
}
