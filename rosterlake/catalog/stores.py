"""The prediction store: written to shared storage and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.catalog.base import PARTS, ROUNDS, orders_panel, part_rounds, part_scores, query, r6, rounded, table
from rosterlake.functions.seasons import season_code
from rosterlake.operators.ordered import numbered
from rosterlake.sources import predictions as store
from rosterlake.sources.archive import RoundArchive, migrate
from rosterlake.sources.landed import standings
from rosterlake.streaming.sinks import scratch

_MONTHS = "select o_custkey as player_id, o_orderkey, o_totalprice as expected_points, year(o_orderdate) as season, month(o_orderdate) as gameweek from orders"
_CODE = "cast(season as varchar) || '-' || lpad(cast((season + 1) % 100 as varchar), 2, '0')"


def monthly(spark, sf):
    o = orders_panel(spark, sf)
    return o.select(
        F.col("o_custkey").alias("player_id"), "o_orderkey", F.col("o_totalprice").alias("expected_points"),
        season_code(F.col("season")).alias("season_name"), F.month("o_orderdate").alias("gameweek"),
    )


@query("partition_round_trip", f"""with m as ({_MONTHS})
select {_CODE} as season_name, gameweek, count(*) as n, max(expected_points) as best from m where season = 1998 and gameweek between 3 and 7 group by 1, 2""")
def partition_round_trip(spark, sf):
    path = scratch(spark, "store")
    rows = monthly(spark, sf)
    store.write_predictions(rows, path)
    # writing one round again replaces that round and nothing else
    store.write_predictions(rows.filter("season_name = '1998-99' and gameweek = 4"), path)
    back = store.read_predictions(spark, path, "1998-99", 3, 7)
    return back.groupBy("season_name", "gameweek").agg(F.count(F.lit(1)).alias("n"), F.max("expected_points").alias("best"))


@query("prediction_order", f"""with m as ({_MONTHS})
select {_CODE} as season_name, gameweek, o_orderkey, row_number() over (partition by season, gameweek order by expected_points desc, o_orderkey) as rank from m""")
def prediction_order(spark, sf):
    """Rank inside a round of the stored table: the sort is by value, whatever the file layout."""
    path = scratch(spark, "store")
    store.write_predictions(monthly(spark, sf), path)
    return numbered(spark.read.parquet(path), ["season_name", "gameweek"], ["-expected_points", "o_orderkey"], "rank").select(
        "season_name", "gameweek", "o_orderkey", "rank"
    )


@query("horizon_missing", f"""with m as ({_MONTHS}), p as (select distinct gameweek from m)
select cast(g.r as integer) as gameweek, cast(g.r in (select gameweek from p) as integer) as present from generate_series(8, 15) g(r)""")
def horizon_missing(spark, sf):
    """Rounds 8 to 15 of months: the last three are missing."""
    return store.horizon_rounds(monthly(spark, sf), 8, 8).withColumn("present", F.col("present").cast("int"))


@query("available_horizon", f"""with m as ({_MONTHS}) select distinct gameweek from m where gameweek >= 10 order by 1 limit 4""")
def available_horizon(spark, sf):
    return store.available_horizon(monthly(spark, sf), 10, 4)


@query("season_catalogue", f"""with m as ({_MONTHS}),
l as (select season, 1 as priority, count(distinct gameweek) as rounds, min(gameweek) as first_round, max(gameweek) as last_round from m where season <= 1998 group by 1
  union all select season, 2, count(distinct gameweek), min(gameweek), max(gameweek) from m where season >= 1997 and gameweek <= 9 group by 1)
select {_CODE} as season_name, priority, rounds, first_round, last_round from l where season % 3 <> 0
qualify row_number() over (partition by season order by priority) = 1""")
def season_catalogue(spark, sf):
    m = monthly(spark, sf)
    archive, root, rosters = scratch(spark, "archive"), scratch(spark, "root"), scratch(spark, "roster")
    store.write_predictions(m.filter("season_name < '1999'"), archive)
    store.write_predictions(m.filter("season_name >= '1997' and gameweek <= 9"), root)
    store.write_predictions(m.filter("cast(substring(season_name, 1, 4) as int) % 3 <> 0"), rosters)
    snapshots = spark.read.parquet(rosters)
    out = store.season_catalogue(spark.read.parquet(archive), spark.read.parquet(root), snapshots)
    return out.select("season_name", "priority", "rounds", "first_round", "last_round")


@query("tag_rows", """
select p_partkey as player_id, p_name as full_name, '2025-26' as season_name, 7 as gameweek from part""")
def tag_rows(spark, sf):
    legacy = table(spark, sf, "part").select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("full_name"))
    path = scratch(spark, "tagged")
    store.write_predictions(store.tag_rows(legacy.withColumn("expected_points", F.lit(0.0)), "2025-26", 7), path)
    return store.read_predictions(spark, path, "2025-26").select("player_id", "full_name", "season_name", "gameweek")


@query("tag_problems", """
with m as (select month(o_orderdate) as gameweek, case when o_orderkey % 9000 = 1 then null when month(o_orderdate) = 5 then 'b' else 'a' end as season_tag,
  case when month(o_orderdate) = 8 and o_orderkey % 2 = 0 then 9 else month(o_orderdate) end as stated from orders)
select gameweek, count(*) filter (where season_tag is null) as untagged, count(*) filter (where season_tag <> 'a') as wrong_season, count(distinct season_tag) as seasons,
  count(*) filter (where stated is distinct from gameweek) as wrong_round from m group by 1
having count(*) filter (where season_tag is null) > 0 or count(*) filter (where season_tag <> 'a') > 0 or count(distinct season_tag) > 1
  or count(*) filter (where stated is distinct from gameweek) > 0""")
def tag_problems(spark, sf):
    month = F.month("o_orderdate")
    m = table(spark, sf, "orders").select(
        month.alias("gameweek"),
        F.when(F.col("o_orderkey") % 9000 == 1, F.lit(None)).when(month == 5, "b").otherwise("a").alias("season_tag"),
        F.when((month == 8) & (F.col("o_orderkey") % 2 == 0), 9).otherwise(month).alias("stated_gameweek"),
    )
    return store.tag_problems(m, "a")


@query("state_reset", f"""with m as ({_MONTHS})
select 'player' as kind, cast(player_id as varchar) as key, round(max(expected_points), 2) as bias from m where season = 1999 group by 2""")
def state_reset(spark, sf):
    m = monthly(spark, sf)
    path = scratch(spark, "state")
    state = m.groupBy("season_name", F.lit("player").alias("kind"), F.col("player_id").cast("string").alias("key")).agg(
        F.round(F.max("expected_points"), 2).alias("bias")
    )
    store.write_state(state, path)
    return store.load_state(spark.read.parquet(path), "1999-00").select("kind", "key", "bias")


@query("archived_round", f"""with {PARTS}, {ROUNDS}
select p.player_id, p.full_name, r.expected_points, '2025-26' as season_name, 2 as gameweek from part_scores p join part_rounds r on r.player_id = p.player_id and r.gameweek = 2""")
def archived_round(spark, sf):
    p = part_scores(spark, sf)
    roster = p.select("player_id", "full_name", "team_name", "team_id")
    rows = p.drop("expected_points").join(
        part_rounds(spark, sf).filter("gameweek = 2").select("player_id", "expected_points"), "player_id"
    )
    archive = RoundArchive(spark, scratch(spark, "archive"))
    for _ in range(2):  # repeating the archive leaves one published copy
        archive.write(rows, roster, "2025-26", 2)
    back = archive.predictions("2025-26", 2, 2).join(archive.rosters("2025-26", 2, 2).select("player_id", "gameweek"), ["player_id", "gameweek"])
    return back.select("player_id", "full_name", "expected_points", "season_name", "gameweek")


@query("migrated_round", f"""with {PARTS}, {ROUNDS}
select gameweek, count(*) as players, max(r.expected_points) as best, cast(sum(case when t.team_name is not null then 1 else 0 end) as bigint) as on_roster
from (select r.player_id, r.gameweek, r.expected_points from part_rounds r where r.gameweek in (1, 3)) r join part_scores t using (player_id) group by 1""")
def migrated_round(spark, sf):
    """Untagged rows of two rounds, brought into the archive with the roster that they match."""
    p = part_scores(spark, sf)
    roster = p.select("player_id", "full_name", "team_name", "team_id")
    archive = RoundArchive(spark, scratch(spark, "migrated"))
    for gameweek in (1, 3):
        legacy = p.drop("expected_points").join(part_rounds(spark, sf).filter(F.col("gameweek") == gameweek).select("player_id", "expected_points"), "player_id")
        migrate(archive, legacy, roster, "2025-26", gameweek)
    back = archive.predictions("2025-26").join(archive.rosters("2025-26").select("player_id", "gameweek", F.lit(1).alias("_on")), ["player_id", "gameweek"], "left")
    return back.groupBy("gameweek").agg(
        F.count(F.lit(1)).alias("players"), F.max("expected_points").alias("best"), F.coalesce(F.sum("_on"), F.lit(0)).cast("long").alias("on_roster")
    )


@query("strict_load", f"""with m as ({_MONTHS})
select gameweek, count(*) as n, max(expected_points) as best from m where season = 1997 group by 1""")
def strict_load(spark, sf):
    """All rounds of a season, whose rows carry the tags that the strict read asks for."""
    path = scratch(spark, "strict")
    tagged = monthly(spark, sf).withColumns({"season_tag": F.col("season_name"), "stated_gameweek": F.col("gameweek")})
    store.write_predictions(tagged, path)
    return store.load_predictions(spark, path, "1997-98").groupBy("gameweek").agg(F.count(F.lit(1)).alias("n"), F.max("expected_points").alias("best"))


@query("season_pages", """
select league_id, entry, total from (select c_nationkey as league_id, c_custkey as entry, cast(floor(c_acctbal) as bigint) as total from customer)""")
def season_pages(spark, sf):
    """League pages landed as JSON and united."""
    path = scratch(spark, "pages")
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("long").alias("league_id"), F.col("c_custkey").alias("entry"), F.floor("c_acctbal").cast("int").alias("total")
    )
    paged = numbered(c, ["league_id"], ["-total", "entry"], "rank").withColumn("page", F.floor((F.col("rank") - 1) / 50))
    pages = paged.groupBy("league_id", "page").agg(
        F.struct(F.collect_list(F.struct("entry", "total", "rank")).alias("results")).alias("standings")
    ).select(F.struct(F.col("league_id").alias("id")).alias("league"), "standings")
    # one document a line, as a downloader that appends would land them
    pages.select(F.to_json(F.struct("league", "standings")).alias("value")).write.mode("overwrite").text(path)
    return standings(spark, path, lines=True).select("league_id", "entry", "total")
