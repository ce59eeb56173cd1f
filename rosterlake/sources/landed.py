"""Readers of landed JSON and CSV documents."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake import schemas
from rosterlake.constants import ARCHIVE_DEFAULTS, BASE_STATS, CHIP_NAMES, EXPECTED_SCORING, POSITION_CODES
from rosterlake.functions.numbers import lookup, number_columns
from rosterlake.operators.aggregates import union_by_name
from rosterlake.operators.joins import side_value
from rosterlake.operators.ordered import first_row

_PLAYER_FILE = r"[/=]player_(\d+)\.json(?:/[^/]*)?$"
_PLAYER_DOC = r"^player_(\d+)\.json$"


def player_histories(
    spark: SparkSession, path: str, roster: DataFrame | None = None, season: str | None = None, lines: bool = False
) -> DataFrame:
    """Match rows of every ``player_<id>.json`` (A1), be it a file or a folder of part files, or with ``lines`` a
    line that has the name in ``doc``: many players then share a file, which Spark can split. The id
    comes from that name; other documents and players outside the roster are left out (A2)."""
    name = F.regexp_extract("doc", _PLAYER_DOC, 1) if lines else F.regexp_extract(F.col("_metadata.file_path"), _PLAYER_FILE, 1)
    documents = (
        spark.read.schema(schemas.HISTORY_DOCUMENT).option("multiLine", not lines).json(path)
        .select(name.try_cast("bigint").alias("player_id"), "history")
        .filter(F.col("player_id").isNotNull())
    )
    if roster is not None:
        documents = documents.join(roster.select("player_id"), "player_id", "left_semi")
    rows = documents.select("player_id", F.explode("history").alias("h")).select("player_id", "h.*").drop("element")
    rows = rows.withColumns(number_columns(BASE_STATS, rows))
    return rows if season is None else tag_season(rows, season)


def tag_season(df: DataFrame, season: str) -> DataFrame:
    """Season label where a row has none."""
    if "season_name" not in df.columns:
        return df.withColumn("season_name", F.lit(season))
    return df.withColumn("season_name", F.coalesce("season_name", F.lit(season)))


def merge_histories(live: DataFrame, archive: DataFrame) -> DataFrame:
    """Live rows win over archive rows of the same match."""
    both = union_by_name(
        live.withColumn("_source", F.lit(0)), archive.withColumn("_source", F.lit(1))
    )
    tie = [c for c in ("kickoff_time", "total_points", "minutes") if c in both.columns]
    return first_row(
        both, ["player_id", "fixture", "round", "season_name"], ["_source", *tie]
    ).drop("_source")


class Bootstrap:
    """The projections of one roster document (A3)."""

    def __init__(self, spark: SparkSession, path: str):
        self.document = spark.read.schema(schemas.BOOTSTRAP).option("multiLine", True).json(path)

    def _rows(self, name: str) -> DataFrame:
        return self.document.select(F.explode(name).alias("r")).select("r.*")

    @property
    def elements(self) -> DataFrame:
        return name_elements(self._rows("elements"))

    @property
    def teams(self) -> DataFrame:
        return self._rows("teams").withColumnRenamed("id", "team_id")

    @property
    def events(self) -> DataFrame:
        return self._rows("events")

    @property
    def positions(self) -> DataFrame:
        return self._rows("element_types")

    @property
    def chips(self) -> DataFrame:
        return self._rows("chips")

    @property
    def rules(self) -> DataFrame:
        return rule_rows(self.document)


def name_elements(raw: DataFrame) -> DataFrame:
    """Roster names and units: full name (null if a part is), price in millions."""
    return raw.withColumnsRenamed({"id": "player_id", "team": "team_id"}).withColumns(
        {
            "full_name": F.concat("first_name", F.lit(" "), "second_name"),
            "now_cost_millions": F.col("now_cost") / 10.0,
        }
    )


def rule_rows(document: DataFrame) -> DataFrame:
    """The rule document as (path, position, value) (Q5)."""
    labels = {"GKP": "GK", "DEF": "DEF", "MID": "MID", "FWD": "FWD"}
    rules = document.select("game_config.rules.*")
    r = rules.select(
        F.explode(
            F.array(
                F.struct(F.lit("budget_tenths").alias("path"),
                         F.try_divide(F.col("squad_total_spend") * 10, F.col("ui_currency_multiplier")).cast("int").alias("value")),
                F.struct(F.lit("squad_size").alias("path"), F.col("squad_squadsize").alias("value")),
                F.struct(F.lit("starting_size").alias("path"), F.col("squad_squadplay").alias("value")),
                F.struct(F.lit("max_per_team").alias("path"), F.col("squad_team_limit").alias("value")),
                F.struct(F.lit("max_free_transfers").alias("path"), (F.col("max_extra_free_transfers") + 1).alias("value")),
                F.struct(F.lit("transfers_cap").alias("path"), F.col("transfers_cap").alias("value")),
            )
        ).alias("r")
    ).select("r.path", F.lit(None).cast("string").alias("position"), "r.value")
    types = document.select(F.explode("element_types").alias("t")).select(
        F.coalesce(lookup(labels, F.col("t.singular_name_short")), F.col("t.singular_name_short")).alias("position"),
        F.explode(
            F.array(
                F.struct(F.lit("squad_limit").alias("path"), F.col("t.squad_select").alias("value")),
                F.struct(F.lit("min_play").alias("path"), F.col("t.squad_min_play").alias("value")),
                F.struct(F.lit("max_play").alias("path"), F.col("t.squad_max_play").alias("value")),
            )
        ).alias("r"),
    ).select("r.path", "position", "r.value")
    windows = document.select(F.explode("chips").alias("c")).select(
        lookup(CHIP_NAMES, F.col("c.name")).alias("position"), F.coalesce("c.number", F.lit(1)).alias("n"),
        F.col("c.start_event").alias("start"), F.col("c.stop_event").alias("stop"),
    ).filter(F.col("position").isNotNull())
    first_stop = windows.agg(F.min("stop")).scalar()
    chips = windows.groupBy("position").agg(
        F.sum(F.when(F.col("stop") <= first_stop, F.col("n")).otherwise(0)).cast("int").alias("chips_first_half"),
        F.sum(F.when(F.col("start") > first_stop, F.col("n")).otherwise(0)).cast("int").alias("chips_second_half"),
        F.min("start").alias("chip_first_round"), F.min("stop").alias("chip_first_half_end"),
    ).unpivot("position", ["chips_first_half", "chips_second_half", "chip_first_round", "chip_first_half_end"], "path", "value")
    scoring = scoring_rows(document.select(F.col("game_config.scoring").alias("scoring")), "scoring")
    order = ["path", "position", "value"]
    return r.select(order).unionByName(types.select(order)).unionByName(chips.select(order)).unionByName(scoring.select(order))


def scoring_rows(documents: DataFrame, column: str, *ids: str) -> DataFrame:
    """A variant document of scoring rules as (ids, path, position, value): a rule is a whole number, or a map of them by
    position. Anything else in it is null; documents that are no object have no rows."""
    def fields(df: DataFrame, held: str, *kept: Column | str) -> DataFrame:
        """One row a field of an object."""
        each = df.sparkSession.tvf.variant_explode(F.col(held).outer()).alias("_f")
        objects = df.filter(F.schema_of_variant(held).startswith("OBJECT"))
        return objects.lateralJoin(each).select(*kept, F.col("_f.key").alias("_key"), F.col("_f.value").alias("_value"))

    rules = fields(documents.select(*ids, F.col(column).alias("_document")), "_document", *ids).withColumn("path", F.concat(F.lit("scoring."), "_key"))
    nested = F.schema_of_variant("_value").startswith("OBJECT")
    number = lambda c: F.try_variant_get(c, "$", "int")
    single = rules.filter(~nested).select(*ids, "path", F.lit(None).cast("string").alias("position"), number("_value").alias("value"))
    by_position = fields(rules.filter(nested).select(*ids, "path", F.col("_value").alias("_rule")), "_rule", *ids, "path")
    return single.unionByName(by_position.select(*ids, "path", F.col("_key").alias("position"), number("_value").alias("value")))


def expected_rules(spark: SparkSession, first_half_end: int = 19) -> DataFrame:
    """The rule table the library is built for, in the same long form."""
    rows: list[tuple[str, str | None, int]] = [
        ("budget_tenths", None, 1000), ("squad_size", None, 15), ("starting_size", None, 11),
        ("max_per_team", None, 3), ("max_free_transfers", None, 5), ("transfers_cap", None, 20),
    ]
    limits = {"GK": (2, 1, 1), "DEF": (5, 3, 5), "MID": (5, 2, 5), "FWD": (3, 1, 3)}
    for position, (select, low, high) in limits.items():
        rows += [("squad_limit", position, select), ("min_play", position, low), ("max_play", position, high)]
    for chip in CHIP_NAMES.values():
        rows += [("chips_first_half", chip, 1), ("chips_second_half", chip, 1), ("chip_first_half_end", chip, first_half_end)]
    rows += [("chip_first_round", "free_hit", 2)]
    for action, value in EXPECTED_SCORING.items():
        pairs = value.items() if isinstance(value, dict) else [(None, value)]
        rows += [(f"scoring.{action}", position, points) for position, points in pairs]
    return spark.createDataFrame(rows, "path string, position string, value int")


def live_rule_drift(bootstrap: Bootstrap) -> DataFrame:
    """Differences between the live rules and the expected ones. The first round of a chip
    matters for the free hit only; scoring actions the library does not know are ignored."""
    from rosterlake.operators.quality import rule_drift

    spark = bootstrap.document.sparkSession
    drift = rule_drift(bootstrap.rules, expected_rules(spark))
    return drift.filter(
        ~((F.col("path") == "chip_first_round") & F.col("expected").isNull())
        & ~(F.col("path").startswith("scoring.") & F.col("expected").isNull())
    )


def fixtures(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The fixture array (A4): one a file, or with ``lines`` one a line, which Spark can split."""
    return spark.read.schema(schemas.FIXTURE).option("multiLine", not lines).json(path)


def picks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Picks documents to squad rows (A10): one a file, or with ``lines`` one a line."""
    rows = spark.read.schema(schemas.PICKS).option("multiLine", not lines).json(path).select(F.explode("picks").alias("p"))
    starts = F.col("p.position") <= 11
    return rows.select(
        F.col("p.element").alias("player_id"), F.col("p.position").alias("pick_position"),
        F.coalesce("p.multiplier", F.lit(0)).alias("multiplier"),
        starts.cast("int").alias("starting"), (~starts).cast("int").alias("bench"),
        F.coalesce("p.is_captain", F.lit(False)).cast("int").alias("captain"),
        F.coalesce("p.is_vice_captain", F.lit(False)).cast("int").alias("vice_captain"),
    )


def standings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed standings pages of a league, one row per entry (A11): a document a file, or with
    ``lines`` a document a line, which Spark can split."""
    pages = spark.read.schema(schemas.STANDINGS).option("multiLine", not lines).json(path)
    return pages.select(F.col("league.id").alias("league_id"), F.explode("standings.results").alias("r")).select(
        "league_id", "r.*"
    )


def actual_points(hist: DataFrame, gameweek: int, first_only: bool = False) -> DataFrame:
    """Points per player in a round (A12): summed over its matches (V3), or the first match."""
    rows = hist.filter(F.col("round") == gameweek)
    if first_only:
        rows = first_row(rows, ["player_id"], ["kickoff_time", "fixture"])
    return rows.groupBy("player_id").agg(F.sum("total_points").alias("actual_points"))


def team_csv(spark: SparkSession, path: str) -> DataFrame:
    """A squad file: player_id required, flags default to 0."""
    # no enforced schema: CSV binds a given schema by position, and these files vary
    raw = spark.read.option("header", True).csv(path)
    if "player_id" not in raw.columns:
        raise ValueError("team file needs a player_id column")
    flags = {
        c: F.coalesce(F.col(c).try_cast("int") if c in raw.columns else F.lit(None).cast("int"), F.lit(0))
        for c in ("starting", "bench", "captain")
    }
    return raw.withColumns({"player_id": F.col("player_id").try_cast("bigint"), **flags}).filter(
        F.col("player_id").isNotNull()
    )


# --- season archives ---------------------------------------------------------------------------------

_FIELD = r'(?:^|,)("[^"\\]*(?:(?:\\.|"")[^"\\]*)*"|[^,]*)'


def _fields(line: Column) -> Column:
    """The fields of a CSV line, quotes taken off; empty ones are null."""
    plain = lambda x: F.when(
        x.startswith('"'), F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r'\\(.)|"(")', "$1$2")
    ).otherwise(x)
    return F.transform(F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), lambda x: F.nullif(plain(x), F.lit("")))


def headed_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, season, names, fields) of every line but the headers of CSV files, whatever the headers: each line meets its
    file's header in the executors. ``names`` come from the first line that is not blank; a later line equal to it is no data."""
    text = spark.read.text(list(paths)).select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at")
    ).filter(F.length(F.trim("line")) > 0)
    heads = text.filter("_at = 0").withColumn("_no", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("line", "_no").alias("_head"))
    trimmed = F.transform(_fields(F.col("_head")), F.trim)
    season = F.url_decode(F.regexp_extract("file", _SEASON_FOLDER, 1))
    return text.join(heads.withColumns({"names": trimmed, "season": season}), "file").filter(F.col("line") != F.col("_head")).select(
        "file", "season", "names", _fields(F.col("line")).alias("fields")
    )


def value_of(name: str) -> Column:
    """The field under a header's name; null where the file has no such column or the line is shorter."""
    return F.get("fields", F.nullif(F.array_position("names", name), F.lit(0)).cast("int") - 1)


_SEASON_FOLDER = r"/([^/]+)/(?:gws/)?[^/]+\.csv(?:/[^/]*)?$"


def _existing(spark: SparkSession, root: str, seasons: Sequence[str], name: str) -> dict[str, str]:
    """The seasons that have files of this name, with the path that finds them: one look at the file system a season."""
    out = {}
    for season in seasons:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{season}/{name}")
        if spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)):
            out[season] = f"{root}/{season}/{name}"
    return out


def _dimension(spark: SparkSession, root: str, seasons: Sequence[str], name: str, types: dict[str, str], key: str) -> DataFrame:
    """Columns of a season's CSV dimension, first row per season and key."""
    paths = _existing(spark, root, seasons, name)
    if set(paths) != set(seasons):
        raise ValueError(f"no {name} in seasons {sorted(set(seasons) - set(paths))} under {root}")
    typed = headed_lines(spark, list(paths.values())).select("season", *[value_of(c).try_cast(t).alias(c) for c, t in types.items()])
    return first_row(typed.filter(F.col(key).isNotNull()), ["season", key], list(types))


def season_teams(spark: SparkSession, root: str, seasons: Sequence[str]) -> DataFrame:
    return _dimension(spark, root, seasons, "teams.csv", {"name": "string", "id": "int"}, "name")


def season_codes(spark: SparkSession, root: str, seasons: Sequence[str]) -> DataFrame:
    return _dimension(spark, root, seasons, "players_raw.csv", {"id": "bigint", "code": "bigint"}, "id")


def season_fixtures(spark: SparkSession, root: str, seasons: Sequence[str]) -> DataFrame:
    types = {"id": "int", "team_h_difficulty": "double", "team_a_difficulty": "double"}
    return _dimension(spark, root, seasons, "fixtures.csv", types, "id").withColumnRenamed("id", "fixture")


def season_rounds(spark: SparkSession, root: str, seasons: Sequence[str]) -> DataFrame:
    """All ``gws/gw*.csv`` of the seasons as text columns (A5), united by name, with ``_has``: the columns that the season's
    files have between them. The distinct headers reach the driver, which needs their names for the table's columns."""
    lines = headed_lines(spark, seasons)
    headers = lines.select("season", "names").distinct().collect()
    of_season: dict[str, set[str]] = {}
    for r in headers:
        of_season.setdefault(r.season, set()).update(n for n in r.names if n)
    names = sorted(set().union(*of_season.values())) if of_season else []
    has = F.element_at(F.create_map(*[F.lit(x) for s, n in sorted(of_season.items()) for x in (s, ",".join(sorted(n)))]), F.col("season"))
    return lines.select(F.col("season").alias("season_name"), *[value_of(n).alias(n) for n in names], F.split(has, ",").alias("_has"))


def parse_flag(c: Column) -> Column:
    """true/false text; anything else stays unknown (V6)."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)


def normalise_archive(raw: DataFrame, teams: DataFrame, fixture_ratings: DataFrame | None = None) -> DataFrame:
    """Archive rows in the panel's names and types (P15): numbers coerced, position text to code, club name to id, forecast
    kept as an audit column, missing statistics filled. What a season's files lack is judged season by season (``_has``)."""
    def has(name: str) -> Column:
        return F.array_contains("_has", name)

    def lacking(name: str, other: str, filler: Column | None = None) -> dict[str, Column]:
        """``name``, and in seasons without it what ``other`` says."""
        if other not in raw.columns:
            return {}
        own = F.col(name) if name in raw.columns else F.lit(None)
        return {name: F.when(has(name), own).when(has(other), F.col(other) if filler is None else filler)}

    df = raw.withColumns({**lacking("player_id", "element"), **lacking("official_expected_points", "xP"), **lacking("fixture_difficulty", "difficulty")})
    numeric = [
        "player_id", "fixture", "opponent_team", "round", "team_h_score", "team_a_score", "xP",
        "difficulty", "fixture_difficulty", "element_type", "official_expected_points", *BASE_STATS,
    ]
    df = df.withColumns(number_columns(numeric, df))
    integers = {"player_id": "bigint", "fixture": "int", "opponent_team": "int", "team_h_score": "int", "team_a_score": "int"}
    df = df.withColumns({c: F.col(c).cast(t) for c, t in integers.items() if c in df.columns})
    if "round" in df.columns:
        df = df.withColumn("round", F.when(has("round"), F.coalesce("round", F.lit(0))).cast("int"))
    df = df.withColumns({c: parse_flag(F.col(c)) for c in ("was_home", "modified") if c in df.columns})
    if "position" in df.columns:
        code = lookup(POSITION_CODES, F.upper("position"))
        own = F.col("element_type") if "element_type" in df.columns else F.lit(None)
        df = df.withColumn("element_type", F.when(has("element_type"), own.cast("int")).when(has("position"), code))
    if fixture_ratings is not None and {"fixture", "was_home"} <= set(df.columns):
        rated = side_value(
            df, fixture_ratings.withColumnRenamed("season", "season_name"), F.col("was_home"), "team_h_difficulty", "team_a_difficulty", "_rating",
            key=["season_name", "fixture"],
        )
        both = has("fixture") & has("was_home")
        own = F.col("fixture_difficulty") if "fixture_difficulty" in df.columns else F.lit(None).cast("double")
        df = rated.withColumn("fixture_difficulty", F.when(both, F.coalesce(own, F.col("_rating"))).otherwise(own)).drop("_rating")
    if "team" in df.columns:
        ids = teams.select(F.col("season").alias("season_name"), F.col("name").alias("team"), F.col("id").alias("_team_id"))
        df = df.join(ids, ["season_name", "team"], "left").drop("team").withColumnRenamed("_team_id", "team")
    return df.withColumns({
        c: F.when(has(c), F.col(c)).otherwise(F.lit(v)) if c in df.columns else F.lit(v) for c, v in ARCHIVE_DEFAULTS.items()
    }).drop("_has")


def archive_histories(spark: SparkSession, root: str, seasons: Sequence[str], strict: bool = False) -> DataFrame:
    """Seasons of the archive with stable player codes, ready for the code remap (A5, J6), in one plan for all of them. A season
    without round files is passed over with a warning, unless ``strict``; none at all is an error."""
    found = _existing(spark, root, seasons, "gws/gw*.csv")
    missing = [s for s in seasons if s not in found]
    if not found or (missing and strict):
        raise ValueError(f"no round files of seasons {missing} under {root}")
    if missing:
        warnings.warn(f"seasons {missing} have no round files", stacklevel=2)
    known = list(found)
    rounds = season_rounds(spark, root, list(found.values()))
    rows = normalise_archive(rounds, season_teams(spark, root, known), season_fixtures(spark, root, known))
    codes = season_codes(spark, root, known).select(
        F.col("season").alias("season_name"), F.col("id").alias("player_id"), F.col("code").alias("player_code")
    )
    return rows.join(codes, ["season_name", "player_id"])
