"""Joins, fixtures, quality checks and text on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.catalog.base import PARTS, ROUNDS, day, orders_panel, part_rounds, part_scores, query, r6, table
from rosterlake.functions import text as tx
from rosterlake.functions.numbers import flag
from rosterlake.operators import joins, quality
from rosterlake.operators.mentions import mentions
from rosterlake.constants import CURRENT_INFO_WORDS
from rosterlake.session import spread

# Fixtures: order = match, round = order month in its year; sides = smallest / largest supplier.
_FIX = """
fx as (
  select o_orderkey as id, case when o_orderkey % 11 = 0 then null else month(o_orderdate) end as event,
    team_h, team_a, team_h % 5 + 1 as team_h_difficulty,
    case when o_orderkey % 13 = 0 then null else team_a % 5 + 1 end as team_a_difficulty
  from orders join (select l_orderkey, min(l_suppkey) as team_h, max(l_suppkey) as team_a from lineitem
    group by 1 having count(distinct l_suppkey) > 1) on l_orderkey = o_orderkey
),
views as (
  select id as fixture, event, team_h as team_id, team_a as opponent_id, true as is_home, cast(team_h_difficulty as double) as difficulty from fx
  union all
  select id, event, team_a, team_h, false, cast(team_a_difficulty as double) from fx
)"""


def fixtures(spark, sf):
    sides = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("team_h"), F.max("l_suppkey").alias("team_a"),
    ).filter(F.col("team_h") != F.col("team_a"))
    o = table(spark, sf, "orders")
    return o.join(sides, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.month("o_orderdate")).alias("event"),
        "team_h", "team_a", (F.col("team_h") % 5 + 1).alias("team_h_difficulty"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("team_a") % 5 + 1).alias("team_a_difficulty"),
    )


def supplier_names(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("short_name"), "s_nationkey",
    )


@query("home_away_view", f"with {_FIX} select fixture, event, team_id, opponent_id, cast(is_home as integer) as is_home, difficulty from views")
def home_away_view(spark, sf):
    return joins.team_views(fixtures(spark, sf)).withColumn("is_home", F.col("is_home").cast("int"))


@query("side_counts", f"with {_FIX} select team_id, count(*) as fixture_count from views group by 1")
def side_counts(spark, sf):
    return joins.fixture_counts(fixtures(spark, sf))


@query("round_multiplier", f"""with {_FIX},
c as (select team_id, count(*) as n from views where event = 3 group by 1)
select s_suppkey as team_id, coalesce(cast(n as double), 0.0::double) as fixture_multiplier,
  round(s_acctbal * coalesce(cast(n as double), 0.0::double), 6) as points
from supplier left join c on team_id = s_suppkey""")
def round_multiplier(spark, sf):
    teams = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("team_id"), F.col("s_acctbal").alias("points"))
    out = joins.round_multiplier(teams, fixtures(spark, sf).filter("event = 3"), ["points"])
    return out.select("team_id", "fixture_multiplier", r6("points").alias("points"))


@query("label_list", f"""with {_FIX},
n as (select *, row_number() over (partition by team_id order by fixture, is_home desc) as no from views
      join supplier on opponent_id = s_suppkey where event = 3)
select team_id, cast((no - 1) // 1000 as integer) as part_no,
  string_agg('S' || cast(opponent_id as varchar) || case when is_home then ' (H)' else ' (A)' end, ' / ' order by no) as fixture_label
from n group by 1, 2""")
def label_list(spark, sf):
    return joins.fixture_labels(fixtures(spark, sf).filter("event = 3"), supplier_names(spark, sf))


_SLOTS = ", ".join(
    f"coalesce(max(case when slot = {i} then label end), 'TBC') as fixture_{i}, max(case when slot = {i} then difficulty end) as difficulty_{i}"
    for i in range(1, 6)
)


@query("next_five", f"""with {_FIX},
r as (select v.*, row_number() over (partition by team_id order by event, fixture, is_home desc) as slot from views v where event >= 6),
l as (select team_id, slot, difficulty, 'GW ' || cast(event as varchar) || ': ' || coalesce(s_name, 'Team ' || cast(opponent_id as varchar))
        || case when is_home then ' (H)' else ' (A)' end as label
      from r left join supplier on opponent_id = s_suppkey where slot <= 5)
select s_suppkey as team_id, {_SLOTS} from supplier left join l on team_id = s_suppkey group by 1""")
def next_five(spark, sf):
    return joins.next_fixtures(fixtures(spark, sf), supplier_names(spark, sf), 6)


_T = "order by o_orderdate desc, round desc, fixture desc"


@query("target_context", f"""with {_FIX},
hist as (
  select o.o_orderkey as fixture, o.o_orderdate, month(o.o_orderdate) as round, team_h as team, true as was_home,
    cast(round(o.o_totalprice) as bigint) % 4 as h_score, cast(round(o.o_totalprice) as bigint) % 3 as a_score
  from orders o join fx on id = o_orderkey where year(o_orderdate) = 2000 and month(o_orderdate) <= 6
  union all
  select o.o_orderkey, o.o_orderdate, month(o.o_orderdate), team_a, false,
    cast(round(o.o_totalprice) as bigint) % 4, cast(round(o.o_totalprice) as bigint) % 3
  from orders o join fx on id = o_orderkey where year(o_orderdate) = 2000 and month(o_orderdate) <= 6
),
tail as (select *, row_number() over (partition by team {_T}) as rn,
    case when was_home then h_score else a_score end as gf, case when was_home then a_score else h_score end as ga from hist),
recent as (select team, avg(gf) as gf5, avg(case when gf > ga then 3 when gf = ga then 1 else 0 end) as mp5 from tail where rn <= 5 group by 1)
select v.team_id, count(*) as fixture_count, round(avg(case when is_home then 1.0 else 0.0 end), 6) as was_home,
  round(avg(coalesce(difficulty, 3.0)), 6) as fixture_difficulty,
  round(coalesce(max(own.gf5), 0.0), 6) as team_goals_for_ma5,
  round(coalesce(max(own.mp5), 0.0), 6) as team_match_points_ma5,
  round(avg(coalesce(opp.gf5, 0.0)), 6) as opp_team_goals_for_ma5
from views v left join recent own on own.team = v.team_id left join recent opp on opp.team = v.opponent_id
where v.event = 7 group by 1""")
def target_context(spark, sf):
    from rosterlake.plans.features import add_sort_keys, target_context as context

    fx = fixtures(spark, sf)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    hist = joins.team_views(fx, carry=()).join(o, F.col("fixture") == F.col("o_orderkey")).select(
        "fixture", F.col("team_id").alias("team"), F.col("is_home").alias("was_home"),
        (F.round("o_totalprice").cast("long") % 4).alias("team_h_score"),
        (F.round("o_totalprice").cast("long") % 3).alias("team_a_score"),
        F.date_format("o_orderdate", "yyyy").alias("season_name"),
        F.month("o_orderdate").alias("round"), F.col("o_orderdate").cast("string").alias("kickoff_time"),
    )
    out = context(add_sort_keys(hist), fx, 7, 6, "2000")
    cols = ["was_home", "fixture_difficulty", "team_goals_for_ma5", "team_match_points_ma5", "opp_team_goals_for_ma5"]
    return out.select("team_id", "fixture_count", *[r6(c).alias(c) for c in cols])


# --- dimension joins ---------------------------------------------------------------------------

@query("dim_enrich", """
select s_suppkey, s_name, n_name as team_name, coalesce(case when s_suppkey % 3 = 0 then null else s_nationkey end, n_nationkey) as nation
from supplier left join nation on s_nationkey = n_nationkey""")
def dim_enrich(spark, sf):
    s = table(spark, sf, "supplier").withColumn("nation", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")))
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_nationkey").alias("nation"), F.col("n_name").alias("team_name")
    )
    return joins.fill_from(s, n, "s_nationkey", ["nation", "team_name"]).select("s_suppkey", "s_name", "team_name", "nation")


@query("dim_twice", f"""with {_FIX}
select fixture, team_id, cast(is_home as integer) as is_home, a.s_acctbal as own_s_acctbal, b.s_acctbal as opp_s_acctbal, b.s_name as opp_s_name
from views left join supplier a on a.s_suppkey = team_id left join supplier b on b.s_suppkey = opponent_id""")
def dim_twice(spark, sf):
    out = joins.both_sides(
        joins.team_views(fixtures(spark, sf)), table(spark, sf, "supplier"), "s_suppkey", "team_id", "opponent_id",
        ["s_acctbal", "s_name"],
    )
    return out.select("fixture", "team_id", F.col("is_home").cast("int").alias("is_home"), "own_s_acctbal", "opp_s_acctbal", "opp_s_name")


@query("code_remap", """
with cur as (select code, min(c_custkey) as player_id, min_by(1 + c_nationkey % 4, c_custkey) as pos
  from (select *, c_custkey // 2 * 7 as code from customer where c_custkey % 5 <> 0) group by code)
select o_orderkey, cur.player_id, coalesce(case when o_orderkey % 6 = 0 then null else 1 + o_orderkey % 4 end, cur.pos) as element_type,
  cur.pos as current_element_type,
  coalesce(cast((case when o_orderkey % 6 = 0 then null else 1 + o_orderkey % 4 end) <> cur.pos as integer), 0) as position_changed
from orders join cur on cur.code = o_custkey // 2 * 7""")
def code_remap(spark, sf):
    current = table(spark, sf, "customer").filter(F.col("c_custkey") % 5 != 0).select(
        F.col("c_custkey").alias("player_id"), (F.floor(F.col("c_custkey") / 2) * 7).alias("code"),
        (F.col("c_nationkey") % 4 + 1).alias("element_type"),
    )
    archive = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("player_id"), (F.floor(F.col("o_custkey") / 2) * 7).alias("player_code"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey") % 4 + 1).alias("element_type"),
    )
    return joins.remap_by_code(archive, current).select(
        "o_orderkey", "player_id", "element_type", "current_element_type", flag(F.col("position_changed")).alias("position_changed")
    )


@query("code_filter", """
select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')""")
def code_filter(spark, sf):
    known = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    kept, _ = joins.split_members(known, table(spark, sf, "orders"), "o_custkey")
    return kept.select("o_orderkey", "o_custkey")


@query("side_value", f"""with {_FIX}
select l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') as ship_day,
  coalesce(case when l_returnflag = 'R' then l_tax * 100 end, cast(case when l_linenumber % 2 = 0 then team_h_difficulty else team_a_difficulty end as double)) as fixture_difficulty
from lineitem left join fx on id = l_orderkey""")
def side_value(spark, sf):
    l = table(spark, sf, "lineitem").withColumns(
        {"fixture": F.col("l_orderkey"), "fixture_difficulty": F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 100)}
    )
    fx = fixtures(spark, sf).withColumnRenamed("id", "fixture")
    out = joins.side_value(l, fx, F.col("l_linenumber") % 2 == 0, "team_h_difficulty", "team_a_difficulty", "fixture_difficulty")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("ship_day"),
        F.col("fixture_difficulty").cast("double").alias("fixture_difficulty"),
    )


@query("lookup_default", """
select p_partkey, coalesce(b.v, -1.0::double) as value from part left join (
  select l_partkey, max(l_extendedprice) as v from lineitem where l_returnflag = 'R' and l_tax > 0.06 group by 1) b on l_partkey = p_partkey""")
def lookup_default(spark, sf):
    values = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_tax > 0.06").groupBy(
        F.col("l_partkey").alias("p_partkey")
    ).agg(F.max("l_extendedprice").alias("v"))
    return joins.lookup_value(table(spark, sf, "part").select("p_partkey"), values, "p_partkey", "v", F.lit(-1.0), "value")


@query("coalesce_chain", """
select p_partkey, coalesce(case when p_partkey % 3 = 0 then null else p_size end, case when p_partkey % 2 = 0 then null else p_size + 100 end, 3) as difficulty from part""")
def coalesce_chain(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.coalesce(
            F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")), F.when(F.col("p_partkey") % 2 != 0, F.col("p_size") + 100), F.lit(3)
        ).alias("difficulty"),
    )


@query("projection_meta", f"""with {PARTS}, {ROUNDS}
select p.player_id, p.full_name, p.now_cost_millions, round(sum(r.expected_points), 6) as expected_points
from part_scores p join part_rounds r on p.player_id = r.player_id
where r.gameweek between 2 and 4 and p.player_id in (select player_id from part_rounds where gameweek = 2) group by 1, 2, 3""")
def projection_meta(spark, sf):
    from rosterlake.operators.aggregates import horizon

    rounds = part_rounds(spark, sf)
    meta = part_scores(spark, sf).select("player_id", "full_name", "now_cost_millions").join(
        rounds.filter("gameweek = 2").select("player_id"), "player_id", "left_semi"
    )
    return meta.join(horizon(rounds, [2, 3, 4]).select("player_id", r6("expected_points").alias("expected_points")), "player_id")


@query("squad_enrich", f"""with {PARTS}
select o_orderkey, p.player_id, coalesce(case when o_orderkey % 2 = 0 then null else o_totalprice / 100000.0 end, p.now_cost_millions) as now_cost_millions,
  p.full_name, round(p.expected_points, 6) as expected_points
from orders left join part_scores p on p.player_id = o_custkey""")
def squad_enrich(spark, sf):
    squad = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("player_id"),
        F.when(F.col("o_orderkey") % 2 != 0, F.col("o_totalprice") / 100000.0).alias("now_cost_millions"),
    )
    dims = part_scores(spark, sf)
    out = joins.fill_from(squad, dims, "player_id", ["now_cost_millions", "full_name", "expected_points"])
    known = joins.lookup_value(out, dims, "player_id", "team_id", name="_known")
    return known.select(
        "o_orderkey", F.when(F.col("_known").isNotNull(), F.col("player_id")).alias("player_id"),
        "now_cost_millions", "full_name", r6("expected_points").alias("expected_points"),
    )


@query("membership_missing", """
with o as (select o_custkey as c_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' and year(o_orderdate) >= 1999 group by 1)
select c_custkey, coalesce(n, 0) as n, case when n is null then 1 else 0 end as missing from customer left join o using (c_custkey)""")
def membership_missing(spark, sf):
    """The urgent orders of the last years of each customer, and the customers without any."""
    wanted = table(spark, sf, "customer").select("c_custkey")
    urgent = table(spark, sf, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") >= 1999))
    found, missing = joins.split_members(wanted, urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    counted = found.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("missing", F.lit(0))
    return counted.unionByName(missing.withColumns({"n": F.lit(0).cast("long"), "missing": F.lit(1)}))


_PTS = "select o_custkey, year(o_orderdate) as season, sum(cast(o_totalprice as decimal(18,2))) as d from orders group by 1, 2"


def yearly_points(spark, sf):
    return orders_panel(spark, sf).groupBy("o_custkey", "season").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("points"), F.count(F.lit(1)).alias("n")
    )


@query("rival_by_period", f"""
with y as ({_PTS}), p as (select o_custkey, season, cast(d as double) as points from y)
select a.o_custkey, b.o_custkey as rival, a.season, a.points as points_a, b.points as points_b, round(a.points - b.points, 6) as points_gap
from p a join p b on b.o_custkey = a.o_custkey + 1 and a.season = b.season""")
def rival_by_period(spark, sf):
    y = yearly_points(spark, sf)
    a = y.withColumn("period", F.struct("o_custkey", "season"))
    b = y.withColumn("period", F.struct((F.col("o_custkey") - 1).alias("o_custkey"), "season"))
    return joins.compare_by_period(a, b, "period", ["points"]).select(
        "period.o_custkey", (F.col("period.o_custkey") + 1).alias("rival"), "period.season",
        "points_a", "points_b", r6("points_gap").alias("points_gap"),
    )


@query("shared_periods", """
select distinct year(o_orderdate) as season from orders where o_orderstatus = 'F' and o_totalprice > 400000
intersect select distinct year(o_orderdate) from orders where o_orderstatus = 'O' and o_totalprice < 100000""")
def shared_periods(spark, sf):
    o = orders_panel(spark, sf)
    return joins.shared_periods(
        o.filter("o_orderstatus = 'F' and o_totalprice > 400000"), o.filter("o_orderstatus = 'O' and o_totalprice < 100000"), "season"
    )


@query("benchmark_join", f"""
with y as ({_PTS}), p as (select o_custkey, season, cast(d as double) as points, d from y),
b as (select season, cast(sum(d) as double) / count(*) as average_score, max(points) as highest_score from p group by 1)
select o_custkey, season, points, round(points - average_score, 6) as points_vs_average, round(points - highest_score, 6) as points_vs_highest
from p join b using (season)""")
def benchmark_join(spark, sf):
    y = yearly_points(spark, sf)
    bench = y.groupBy("season").agg(
        (F.sum(F.col("points").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1))).alias("average_score"),
        F.max("points").alias("highest_score"),
    )
    out = joins.against_benchmark(y, bench, "season", "points")
    return out.select("o_custkey", "season", "points", r6("points_vs_average").alias("points_vs_average"),
                      r6("points_vs_highest").alias("points_vs_highest"))


@query("expected_vs_actual", f"""with {PARTS}, {ROUNDS}
select p.player_id, round(p.expected_points, 6) as expected_points, round(coalesce(r.expected_points, 0.0), 6) as actual_points
from part_scores p left join part_rounds r on r.player_id = p.player_id and r.gameweek = 3 where p.start_probability >= 0.6""")
def expected_vs_actual(spark, sf):
    p = part_scores(spark, sf)
    actual = part_rounds(spark, sf).filter("gameweek = 3").select("player_id", F.col("expected_points").alias("actual_points"))
    out = joins.expected_vs_actual(p, actual, p.filter("start_probability >= 0.6"))
    return out.select("player_id", r6("expected_points").alias("expected_points"), r6("actual_points").alias("actual_points"))


@query("rank_pairing", f"""with {PARTS},
o as (select *, row_number() over (partition by element_type order by expected_points, player_id) as rn from part_scores where confidence_score < 60),
i as (select *, row_number() over (partition by element_type order by expected_points desc, player_id) as rn from part_scores where confidence_score >= 60),
f as (select 1 as pass, o.element_type as slot, o.rn as no, o.player_id as out_id, i.player_id as in_id, o.expected_points as oe, i.expected_points as ie
      from o join i on o.element_type = i.element_type and o.rn = i.rn),
ro as (select *, row_number() over (order by expected_points, player_id) as no from o where player_id not in (select out_id from f)),
ri as (select *, row_number() over (order by expected_points desc, player_id) as no from i where player_id not in (select in_id from f)),
s as (select 2 as pass, 0 as slot, ro.no, ro.player_id as out_id, ri.player_id as in_id, ro.expected_points as oe, ri.expected_points as ie
      from ro join ri on ro.no = ri.no)
select row_number() over (order by pass, slot, no) as pair_no, pass, out_id, in_id, round(ie - oe, 6) as delta
from (select * from f union all select * from s)""")
def rank_pairing(spark, sf):
    p = part_scores(spark, sf)
    out = joins.pair_by_rank(p.filter("confidence_score < 60"), p.filter("confidence_score >= 60"), "element_type", "player_id", "expected_points")
    return out.select("pair_no", "pass", "out_id", "in_id", r6("delta").alias("delta"))


@query("set_delta", f"""with {PARTS}
select 'out' as side, player_id from part_scores where confidence_score < 70 and not (confidence_score >= 55)
union all select 'in', player_id from part_scores where confidence_score >= 55 and not (confidence_score < 70)""")
def set_delta(spark, sf):
    p = part_scores(spark, sf)
    owned, best = p.filter("confidence_score < 70").select("player_id"), p.filter("confidence_score >= 55").select("player_id")
    out, new = joins.set_delta(owned, best, ["player_id"])
    return out.select(F.lit("out").alias("side"), "player_id").unionByName(new.select(F.lit("in").alias("side"), "player_id"))


@query("apply_swaps", """
select p_partkey as player_id, p_size % 2 as starting from part where p_size <= 25 and p_partkey % 5 <> 0
union all select p_partkey, 0 from part where p_partkey % 7 = 0 and not (p_size <= 25 and p_partkey % 5 <> 0)""")
def apply_swaps(spark, sf):
    p = table(spark, sf, "part")
    squad = p.filter("p_size <= 25").select(F.col("p_partkey").alias("player_id"), (F.col("p_size") % 2).alias("starting"))
    swaps = p.select(
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey")).alias("out_id"),
        F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey")).alias("in_id"),
    )
    return joins.apply_swaps(squad, swaps.filter("out_id is not null or in_id is not null")).filter("player_id is not null")


# --- quality checks ------------------------------------------------------------------------------

@query("period_coverage", """
with o as (select o_custkey % 40 as league, week(o_orderdate) as round from orders)
select league, cast(g.round as integer) as round from (select distinct league from o), generate_series(1, 38) g(round)
where (league, g.round) not in (select (league, round) from o)""")
def period_coverage(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("league"), F.weekofyear("o_orderdate").alias("round"))
    return quality.missing_periods(o, "league", "round")


@query("season_absent", """
with o as (select year(o_orderdate) as season, month(o_orderdate) as round from orders)
select cast(s.y as integer) as season, cast(g.r as integer) as round from generate_series(1994, 2002) s(y), generate_series(1, 12) g(r)
where (s.y, g.r) not in (select (season, round) from o)""")
def season_absent(spark, sf):
    """Months without an order in nine years asked for by name, of which two are not there at all."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("round"))
    return quality.missing_periods(o, "season", "round", expected=12, seasons=list(range(1994, 2003)))


@query("periods_to_show", """
select month(o_orderdate) as round, 'a' as side from orders where month(o_orderdate) <= 5 group by 1
union all select month(o_orderdate), 'b' from orders where month(o_orderdate) >= 8 group by 1""")
def periods_to_show(spark, sf):
    """Two sides without a common month show their own."""
    o = table(spark, sf, "orders").select(F.month("o_orderdate").alias("round"))
    return joins.periods_to_show(o.filter("round <= 5"), o.filter("round >= 8"), "round")


@query("identity_mismatch", """
with d as (select c_custkey + case when c_custkey % 97 = 0 then 10000000 else 0 end as id,
    case when c_custkey % 5 = 0 then upper(c_name) when c_custkey % 31 = 0 then null else c_name end as c_name,
    case when c_custkey % 7 = 0 then c_nationkey + 1 else c_nationkey end as c_nationkey from customer),
j as (select d.id, concat_ws(',', case when r.c_custkey is null then 'unknown_id' end,
    case when r.c_custkey is not null and d.c_name is distinct from r.c_name then 'c_name' end,
    case when r.c_custkey is not null and d.c_nationkey is distinct from r.c_nationkey then 'c_nationkey' end) as reasons
  from d left join customer r on d.id = r.c_custkey)
select id as c_custkey, reasons from j where reasons <> ''""")
def identity_mismatch(spark, sf):
    c = table(spark, sf, "customer")
    dirty = c.select(
        (F.col("c_custkey") + F.when(F.col("c_custkey") % 97 == 0, 10000000).otherwise(0)).alias("c_custkey"),
        F.when(F.col("c_custkey") % 5 == 0, F.upper("c_name")).when(F.col("c_custkey") % 31 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
        (F.col("c_nationkey") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)).alias("c_nationkey"),
    )
    return quality.identity_mismatches(dirty, c, "c_custkey", ["c_name", "c_nationkey"]).select(
        "c_custkey", F.array_join("reasons", ",").alias("reasons")
    )


@query("rule_drift", """
with a as (select p_type as path, p_brand as position, cast(count(*) as bigint) as value from part group by 1, 2),
e as (select p_type as path, p_brand as position, cast(count(*) filter (where p_partkey % 3 <> 0) as bigint) + 6 as value
      from part where p_size > 3 group by 1, 2)
select coalesce(a.path, e.path) as path, coalesce(a.position, e.position) as position, a.value as actual, e.value as expected
from a full join e on a.path = e.path and a.position = e.position where a.value is distinct from e.value""")
def rule_drift(spark, sf):
    p = table(spark, sf, "part").withColumnsRenamed({"p_type": "path", "p_brand": "position"})
    actual = p.groupBy("path", "position").agg(F.count(F.lit(1)).alias("value"))
    expected = p.filter("p_size > 3").groupBy("path", "position").agg((F.count_if(F.col("p_partkey") % 3 != 0) + 6).alias("value"))
    return quality.rule_drift(actual, expected)


@query("map_drift", """
with e as (select event_type, user_id, event_id, cast(json_extract_string(props, '$.k') as integer) as k from events),
a as (select event_type as path, user_id as position, max(k) as value from e group by 1, 2),
x as (select event_type as path, user_id as position, max(k) as value from e where event_id % 4 <> 0 group by 1, 2)
select coalesce(a.path, x.path) as path, cast(coalesce(a.position, x.position) as varchar) as position, a.value as actual, x.value as expected
from a full join x on a.path = x.path and a.position = x.position where a.value is distinct from x.value""")
def map_drift(spark, sf):
    """The largest value by event type and user, against what three in four events say: some differ, some are missing."""
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("path"), F.col("user_id").cast("string").alias("position"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id",
    )
    largest = lambda d: d.groupBy("path", "position").agg(F.max("k").alias("value"))
    return quality.rule_drift(largest(e), largest(e.filter("event_id % 4 <> 0")))


@query("ledger_continuity", """
with l as (select distinct o_custkey, year(o_orderdate) as season, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) as round from orders),
s as (select *, lag(round) over w as p, lag(season) over w as ps from l window w as (partition by o_custkey order by season, round))
select o_custkey, season, round, case when p is null and round <> 1 then 'does_not_start_at_1' when ps <> season then 'season_changed'
  when round <> p + 1 then 'not_consecutive' end as reason from s
where (p is null and round <> 1) or ps <> season or round <> p + 1""")
def ledger_continuity(spark, sf):
    log = orders_panel(spark, sf).select(
        "o_custkey", "season", ((F.col("season") - 1995) * 12 + F.month("o_orderdate")).alias("round")
    ).distinct()
    return quality.ledger_gaps(log, ["o_custkey"], "season", "round")


@query("required_values", """
with d as (select p_partkey, case when p_size = 5 then null else p_size end as p_size, case when p_brand = 'Brand#3' then null else p_brand end as p_brand from part)
select p_partkey, concat_ws(',', case when p_size is null then 'p_size' end, case when p_brand is null then 'p_brand' end) as missing
from d where p_size is null or p_brand is null""")
def required_values(spark, sf):
    d = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") != 5, F.col("p_size")).alias("p_size"),
        F.when(F.col("p_brand") != "Brand#3", F.col("p_brand")).alias("p_brand"),
    )
    return quality.null_values(d, ["p_size", "p_brand"], ["p_partkey"]).select("p_partkey", F.array_join("missing", ",").alias("missing"))


@query("stale_season", """
with s as (select c_nationkey as league, min(o_orderdate) as first_day, max(o_orderdate) as last_day from orders join customer on o_custkey = c_custkey group by 1),
k as (select league, cast(year(first_day) as varchar) || '-' || lpad(cast((year(first_day) + 1) % 100 as varchar), 2, '0') as season_name,
  year(last_day) - case when month(last_day) < 7 then 1 else 0 end as ey from s)
select league, season_name, cast(ey as varchar) || '-' || lpad(cast((ey + 1) % 100 as varchar), 2, '0') as expected_season from k
where season_name <> cast(ey as varchar) || '-' || lpad(cast((ey + 1) % 100 as varchar), 2, '0')""")
def stale_season(spark, sf):
    from rosterlake.functions.seasons import season_code

    s = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("league")
    ).agg(F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))
    named = s.withColumn("season_name", season_code(F.year("first_day")))
    return quality.stale_season(named, F.col("last_day"), ["league"])


@query("artifact_class", """
with d as (select (year(o_orderdate) - 1995) * 12 + month(o_orderdate) as gameweek, o_orderkey,
    case when o_orderkey % 4001 = 0 then null else o_custkey end as player_id,
    case when month(o_orderdate) = 3 then null when month(o_orderdate) = 4 and o_orderkey % 2 = 0 then 1900 else year(o_orderdate) end as tag,
    year(o_orderdate) as season from orders)
select gameweek, count(*) as rows, case when count(*) filter (where player_id is null) > 0 or count(*) filter (where tag is not null and tag <> season) > 0 then 'issue'
    when count(*) filter (where tag is null) > 0 then 'migratable' else 'ready' end as status,
  case when count(*) filter (where player_id is null) > 0 then 'invalid_id' when count(*) filter (where tag is not null and tag <> season) > 0 then 'wrong_season' else '' end as reason
from d group by 1""")
def artifact_class(spark, sf):
    o = orders_panel(spark, sf)
    month = F.month("o_orderdate")
    checked = o.select(
        ((F.col("season") - 1995) * 12 + month).alias("gameweek"), "season",
        F.when(F.col("o_orderkey") % 4001 != 0, F.col("o_custkey")).alias("player_id"),
        F.when(month == 3, F.lit(None)).when((month == 4) & (F.col("o_orderkey") % 2 == 0), 1900).otherwise(F.col("season")).alias("tag"),
    )
    return quality.classify_artifacts(
        checked, ["gameweek"],
        {"invalid_id": F.col("player_id").isNull(), "wrong_season": F.col("tag") != F.col("season"), "untagged": F.col("tag").isNull()},
    )


@query("single_season", """
select o_custkey, count(distinct year(o_orderdate)) as seasons from orders group by 1 having count(distinct year(o_orderdate)) > 1""")
def single_season(spark, sf):
    return quality.several_seasons(orders_panel(spark, sf), "season", ["o_custkey"])


# --- text and semi-structured -----------------------------------------------------------------------

_SINGLE = "|".join(w for w in CURRENT_INFO_WORDS if " " not in w)


@query("keyword_intent", f"""
select doc_id, cast(regexp_matches(lower(text), '\\b({_SINGLE})\\b') or contains(lower(text), 'press conference') as integer) as needs_current
from documents""")
def keyword_intent(spark, sf):
    return table(spark, sf, "documents").select("doc_id", flag(tx.keyword_flag("text")).alias("needs_current"))


@query("keyword_turns", """
select conv_id, turn, cast(regexp_matches(lower(text), '\\b(the|whether)\\b') or contains(lower(text), ' and ') as integer) as hit from conversations""")
def keyword_turns(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", flag(tx.keyword_flag("text", ["the", "whether", " and "])).alias("hit")
    )


_CLEAN = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, "
    "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), "
    "'[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), "
    "'[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
)


@query("text_clean", f"""select doc_id, c as cleaned, length(c) as n_chars, md5(c) as whole_text
from (select doc_id, {_CLEAN} as c from documents)""")
def text_clean(spark, sf):
    whole = tx.collapse_text("text")
    return spread(table(spark, sf, "documents")).select(
        "doc_id", tx.clean_text("text").alias("cleaned"), F.length(whole).alias("n_chars"), F.md5(whole).alias("whole_text")
    )


@query("mention_join", """
select doc_id, name from documents, (select distinct regexp_extract(text, '^\\S+ \\S+') as name from benchmark)
where name <> '' and contains(lower(text), lower(name))""")
def mention_join(spark, sf):
    names = table(spark, sf, "benchmark").select(F.regexp_extract("text", r"^\S+ \S+", 0).alias("name"))
    return mentions(table(spark, sf, "documents"), names, "doc_id", "text", "name")


@query("mention_join_many", """
select doc_id, name from documents, (select distinct regexp_extract(text, '^\\S+ \\S+') as name from conversations)
where name <> '' and contains(lower(text), lower(name))""")
def mention_join_many(spark, sf):
    names = table(spark, sf, "conversations").select(F.regexp_extract("text", r"^\S+ \S+", 0).alias("name"))
    return mentions(table(spark, sf, "documents"), names, "doc_id", "text", "name")


@query("json_explode", """
select event_id, cast(json_extract_string(props, '$.k') as integer) as k, k.key as prop from events, unnest(json_keys(props)) as k(key)""")
def json_explode(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "map<string,int>"))
    return e.select("event_id", F.explode("p").alias("prop", "k"))


@query("props_map", """
with t as (select event_id, case when event_id % 9 = 0 then 'GW16 gets five' else cast(event_id % 38 + 1 as varchar) || ':' || cast(event_id % 5 as varchar)
    || ', ' || cast((event_id + 7) % 38 + 1 as varchar) || ' : 3' end as topups from events)
select event_id, case when event_id % 9 = 0 then null else event_id % 5 end as first_count,
  case when event_id % 9 = 0 then null else 2 end as entries from t""")
def props_map(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 9 == 0, F.lit("GW16 gets five")).otherwise(
        F.concat(
            (F.col("event_id") % 38 + 1).cast("string"), F.lit(":"), (F.col("event_id") % 5).cast("string"), F.lit(", "),
            ((F.col("event_id") + 7) % 38 + 1).cast("string"), F.lit(" : 3"),
        )
    )
    parsed = e.select("event_id", tx.parse_round_counts(text).alias("m"))
    return parsed.select(
        "event_id", F.try_element_at("m", (F.col("event_id") % 38 + 1).cast("int")).alias("first_count"),
        F.when(F.col("m").isNotNull(), F.size("m")).alias("entries"),
    )


@query("record_json", f"""with {PARTS}
select player_id, '{{"player_id":' || player_id || ',"full_name":"' || full_name || '","position":' || element_type
  || ',"lines":{{"cost_tenths":' || price_tenths || ',"club":"' || team_name || '"}}}}' as record from part_scores""")
def record_json(spark, sf):
    return part_scores(spark, sf).select(
        "player_id",
        F.to_json(
            F.struct(
                "player_id", "full_name", F.col("element_type").alias("position"),
                F.struct(F.col("price_tenths").alias("cost_tenths"), F.col("team_name").alias("club")).alias("lines"),
            )
        ).alias("record"),
    )


@query("season_tag", """
select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then null else cast(year(o_orderdate) as varchar) end, '2026-27') as season_name from orders""")
def season_tag(spark, sf):
    from rosterlake.sources.landed import tag_season

    o = orders_panel(spark, sf).withColumn("season_name", F.when(F.col("o_orderkey") % 3 != 0, F.col("season").cast("string")))
    return tag_season(o, "2026-27").select("o_orderkey", "season_name")


@query("conform_defaults", """
select p_partkey as player_id, p_size as team_id, coalesce(case when p_size % 3 = 0 then null else p_retailprice end, 0.0::double) as expected_points,
  1.0::double as appearance_probability, coalesce(case when p_size % 5 = 0 then null else p_size / 50.0::double end, 0.75::double) as start_probability from part""")
def conform_defaults(spark, sf):
    from rosterlake.sources.predictions import conform_predictions

    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("player_id"), F.col("p_name").alias("full_name"), F.col("p_brand").alias("team_name"),
        F.col("p_size").alias("team_id"), F.lit(1).alias("element_type"), F.lit(5.0).alias("now_cost_millions"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("expected_points"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0).alias("start_probability"),
    )
    return conform_predictions(p).select("player_id", "team_id", "expected_points", "appearance_probability", "start_probability")
