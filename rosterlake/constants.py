"""Fixed values the results depend on. Stated as they are published, in natural order."""

# Positions: code -> label.
POSITIONS = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}

# Starting formations, in tie-break order: (GK, DEF, MID, FWD).
FORMATIONS = [
    (1, 3, 4, 3),
    (1, 3, 5, 2),
    (1, 4, 4, 2),
    (1, 4, 5, 1),
    (1, 4, 3, 3),
    (1, 5, 4, 1),
    (1, 5, 3, 2),
    (1, 5, 2, 3),
]

# Squad composition and limits.
SQUAD_QUOTA = {1: 2, 2: 5, 3: 5, 4: 3}
STARTING_RANGE = {1: (1, 1), 2: (3, 5), 3: (2, 5), 4: (1, 3)}
SQUAD_SIZE = 15
STARTING_SIZE = 11
BENCH_SIZE = 4
MAX_PER_CLUB = 3
BUDGET_MILLIONS = 100.0
BENCH_WEIGHT = 0.25

# Season rules.
ROUNDS_PER_SEASON = 38
FIRST_HALF_END = 19
MAX_FREE_TRANSFERS = 5
FREE_TRANSFERS_PER_ROUND = 1
TRANSFER_HIT_COST = 4.0
MAX_TRANSFERS_PER_ROUND = 20

# Decision thresholds.
TRANSFER_GAIN_THRESHOLD = 1.5
BENCH_BOOST_THRESHOLD = 8.0
TRIPLE_CAPTAIN_THRESHOLD = 5.0
CHIP_FUTURE_RATIO = 0.95
CAPTAIN_MIN_START = 0.65
CAPTAIN_START_WEIGHT = 0.35
CAPTAIN_CONFIDENCE_WEIGHT = 0.15

# Features and model.
ROLLING_WINDOW = 5
MIN_PRIOR_MATCHES = 3
EMA_ALPHA = 0.15
OUTSIDE_FORECAST_WEIGHT = 0.35
CORRELATION_THRESHOLD = 0.90
MIN_VARIANCE = 1e-6
SEASON_DECAY = 0.7
SEASON_WEIGHT_FLOOR = 0.25
Z80 = 1.2815515655446004

# Availability by status code; anything else counts 0.5.
STATUS_AVAILABILITY = {"a": 1.0, "d": 0.75, "i": 0.0, "s": 0.0, "u": 0.0, "n": 0.0}
RISK_STATUSES = ["d", "i", "s", "u", "n"]
INJURY_STATUSES = ["d", "i"]

# Set-piece order column -> short name.
DUTY_COLUMNS = {
    "corners_and_indirect_freekicks_order": "corners",
    "direct_freekicks_order": "direct_fk",
    "penalties_order": "penalty",
}

# Words that mark a question as needing current information.
CURRENT_INFO_WORDS = [
    "available", "availability", "doubt", "doubtful", "fit", "fitness", "injured", "injury",
    "late", "latest", "news", "press conference", "return", "rotation", "rumour", "rumor",
    "start", "status", "suspended", "suspension",
]

# Match statistics that get a lag and a rolling mean.
BASE_STATS = [
    "total_points", "minutes", "goals_scored", "assists", "clean_sheets", "influence",
    "creativity", "threat", "ict_index", "goals_conceded", "own_goals", "penalties_saved",
    "penalties_missed", "yellow_cards", "red_cards", "saves", "bonus", "bps",
    "clearances_blocks_interceptions", "recoveries", "tackles", "defensive_contribution",
    "starts", "expected_goals", "expected_assists", "expected_goal_involvements",
    "expected_goals_conceded", "value", "transfers_balance", "selected", "transfers_in",
    "transfers_out",
]
TEAM_STATS = [
    "team_goals_for", "team_goals_against", "team_goal_diff", "team_clean_sheet",
    "team_conceded_two_plus", "team_match_points",
]

# Position text -> code in season archives.
POSITION_CODES = {"GK": 1, "GKP": 1, "DEF": 2, "MID": 3, "FWD": 4}

# Statistics older archives lack, with their fill values.
ARCHIVE_DEFAULTS = {
    "clearances_blocks_interceptions": 0.0,
    "recoveries": 0.0,
    "tackles": 0.0,
    "defensive_contribution": 0.0,
    "starts": 0.0,
}

# Chip name in the rule document -> our name.
CHIP_NAMES = {
    "wildcard": "wildcard", "freehit": "free_hit", "bboost": "bench_boost", "3xc": "triple_captain",
}

# Published scoring: action -> points, or action -> {position -> points}.
EXPECTED_SCORING = {
    "long_play": 2,
    "short_play": 1,
    "goals_conceded": {"DEF": -1, "FWD": 0, "GKP": -1, "MID": 0},
    "saves": 1,
    "goals_scored": {"DEF": 6, "FWD": 4, "GKP": 10, "MID": 5},
    "assists": 3,
    "clean_sheets": {"DEF": 4, "FWD": 0, "GKP": 4, "MID": 1},
    "penalties_saved": 5,
    "penalties_missed": -2,
    "yellow_cards": -1,
    "red_cards": -3,
    "own_goals": -2,
    "bonus": 1,
    "defensive_contribution": {"DEF": 2, "FWD": 2, "GKP": 0, "MID": 2},
}
