"""Aggregates, reshaping and boards on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.catalog.base import PARTS, ROUNDS, orders_panel, part_rounds, part_scores, query, r6, rounded, table
from rosterlake.functions import players as pl
from rosterlake.operators import aggregates as ag
from rosterlake.operators.ordered import collect_parts, numbered, top_rows


@query("conditional_mean_fallback", """
with e as (select *, user_id % 4 + 1 as pos, extract('hour' from ts) * 5 as minutes from events),
c as (select pos, value from e where minutes > 0 and minutes < 60 and not (pos = 4)),
o as (select greatest(0.0, least(5.0, cast(sum(cast(value as decimal(18,2))) as double) / count(*))) as m from c),
g as (select pos, cast(sum(cast(value as decimal(18,2))) as double) / count(*) as m from c group by 1)
select p as pos, round(greatest(0.0, least(5.0, coalesce(g.m, (select m from o), 1.0))), 6) as cameo_points
from generate_series(1, 4) t(p) left join g on g.pos = p""")
def conditional_mean_fallback(spark, sf):
    e = table(spark, sf, "events").withColumns(
        {"pos": (F.col("user_id") % 4 + 1).cast("int"), "minutes": F.hour("ts") * 5}
    )
    out = ag.conditional_means(e, "pos", [1, 2, 3, 4], "value", (F.col("minutes") > 0) & (F.col("minutes") < 60) & (F.col("pos") != 4))
    return rounded(out, "cameo_points")


@query("residual_means", """
with r as (select l_partkey, l_linenumber, l_discount * 100 - 5 as residual from lineitem)
select case when grouping(l_partkey) = 0 then 'player' else 'position' end as kind,
  cast(coalesce(l_partkey, l_linenumber) as varchar) as key, round(avg(residual), 6) as mean_residual, count(*) as n
from r group by grouping sets ((l_partkey), (l_linenumber))""")
def residual_means(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("residual", F.col("l_discount") * 100 - 5)
    return rounded(ag.residual_means(l, {"player": "l_partkey", "position": "l_linenumber"}), "mean_residual")


@query("history_counts", """
select c_custkey, coalesce(n, 0) as history_match_count from customer
left join (select o_custkey, count(*) as n from orders where o_totalprice > 200000 group by 1) on o_custkey = c_custkey""")
def history_counts(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return ag.history_counts(o, table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("confidence_census", f"""with {PARTS}
select team_id, count(*) filter (where confidence_score >= 75) as high, count(*) filter (where confidence_score >= 50 and confidence_score < 75) as medium,
  count(*) filter (where confidence_score < 50) as low, round(avg(confidence_score), 6) as average_confidence,
  round(avg(start_probability), 6) as average_start_probability from part_scores group by 1""")
def confidence_census(spark, sf):
    level = F.when(F.col("confidence_score") >= 75, "High").when(F.col("confidence_score") >= 50, "Medium").otherwise("Low")
    out = ag.confidence_census(part_scores(spark, sf).withColumn("confidence_level", level), ["team_id"])
    return rounded(out, "average_confidence", "average_start_probability")


@query("histogram", """
with s as (select min(value) as lo, max(value) as hi, cast(least(30, greatest(5, floor(sqrt(count(*))))) as integer) as bins from events),
b as (select cast(least(floor((value - lo) / ((hi - lo) / bins)), bins - 1) as integer) as bin, count(*) as n from events, s group by 1)
select cast(g.bin as integer) as bin, round(lo + (hi - lo) / bins * (g.bin + 0.5), 6) as mid_point, coalesce(n, 0) as n
from s, generate_series(0, 29) g(bin) left join b on b.bin = g.bin where g.bin < bins""")
def histogram(spark, sf):
    return rounded(ag.histogram(table(spark, sf, "events"), "value"), "mid_point")


@query("distribution_summary", """
with d as (select event_type, user_id % 7 as block, value, cast(json_extract_string(props, '$.k') as double) as transfers from events),
g as (select block, avg(value) as mean_value, min(value) as min_value, max(value) as max_value, count(*) as n, avg(transfers) as mt,
  quantile_cont(value, 0.5) as median, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.9) as p90 from d group by 1)
select block, round(mean_value, 6) as mean_value, min_value, max_value, n, round(mt, 6) as mean_transfers, round(median, 6) as median,
  round(p10, 6) as p10, round(p90, 6) as p90, cast(block = (select block from g order by mean_value desc, block limit 1) as integer) as is_best from g""")
def distribution_summary(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 7).alias("block"), "value", F.get_json_object("props", "$.k").cast("double").alias("transfers")
    )
    out = ag.distribution(e, "block", "value", "transfers")
    return rounded(out, "mean_value", "mean_transfers", "median", "p10", "p90").withColumn("is_best", F.col("is_best").cast("int"))


_WIDE = ", ".join(f"coalesce(sum(case when gameweek = {r} then expected_points end), 0.0) as expected_points_gw{r}" for r in range(1, 6))


@query("horizon_pivot", f"""with {ROUNDS},
w as (select player_id, {_WIDE}, max_by(confidence_score, gameweek) as confidence_score from part_rounds where gameweek <= 5 group by 1)
select *, round(expected_points_gw1 + expected_points_gw2 + expected_points_gw3 + expected_points_gw4 + expected_points_gw5, 6) as expected_points from w""")
def horizon_pivot(spark, sf):
    out = ag.horizon(part_rounds(spark, sf), [1, 2, 3, 4, 5], meta=["confidence_score"])
    return rounded(out, "expected_points")


@query("horizon_unpivot", f"""with {ROUNDS}
select p.player_id, cast(g.r as integer) as gameweek, coalesce(max(case when gameweek = g.r then expected_points end), 0.0) as expected_points
from part_rounds p, generate_series(1, 5) g(r) where p.gameweek <= 5 group by 1, 2""")
def horizon_unpivot(spark, sf):
    wide = ag.horizon(part_rounds(spark, sf), [1, 2, 3, 4, 5]).drop("expected_points")
    return ag.unpivot_rounds(wide, ["player_id"], "expected_points_gw")


@query("metric_matrix", """
with m as (select o_orderstatus, count(*)::double as orders, max(o_totalprice) as best, min(o_totalprice) as worst from orders group by 1),
u as (unpivot m on orders, best, worst into name metric value value)
select metric, max(case when o_orderstatus = 'F' then value end) as "F", max(case when o_orderstatus = 'O' then value end) as "O",
  max(case when o_orderstatus = 'P' then value end) as "P" from u group by 1""")
def metric_matrix(spark, sf):
    m = table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("best"), F.min("o_totalprice").alias("worst")
    )
    return ag.metric_by_entity(m, "o_orderstatus", ["F", "O", "P"], ["orders", "best", "worst"])


@query("change_census", """
select old_pos, new_pos, count(*) as n from (select distinct l_partkey, l_linenumber % 4 + 1 as old_pos, p_size % 4 + 1 as new_pos
  from lineitem join part on l_partkey = p_partkey) where old_pos <> new_pos group by 1, 2""")
def change_census(spark, sf):
    j = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_linenumber") % 4 + 1).alias("old_pos")).join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 4 + 1).alias("new_pos")), "l_partkey"
    )
    return ag.change_census(j, "l_partkey", "old_pos", "new_pos")


_CHIP = "case o_orderkey % 40 when 0 then 'wildcard' when 1 then 'free_hit' when 2 then 'bench_boost' when 3 then 'triple_captain' end"


def chip_column():
    k = F.col("o_orderkey") % 40
    return F.when(k == 0, "wildcard").when(k == 1, "free_hit").when(k == 2, "bench_boost").when(k == 3, "triple_captain")


@query("run_totals", f"""
with d as (select o_custkey, o_totalprice as ep, o_orderkey % 3 as transfers, {_CHIP} as chip from orders)
select o_custkey, round(cast(sum(cast(ep as decimal(18,2))) as double), 2) as total_points, cast(sum(transfers) as bigint) as total_transfers, count(*) as rounds,
  count(*) filter (where chip = 'wildcard') as wildcard_used, count(*) filter (where chip = 'free_hit') as free_hit_used,
  count(*) filter (where chip = 'bench_boost') as bench_boost_used, count(*) filter (where chip = 'triple_captain') as triple_captain_used
from d group by 1""")
def run_totals(spark, sf):
    d = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_totalprice").alias("expected_points"), (F.col("o_orderkey") % 3).alias("transfers"), chip_column().alias("chip")
    )
    return ag.run_totals(d, "o_custkey").withColumn("total_points", F.round("total_points", 2))


@query("top_per_period", f"""with {ROUNDS}
select gameweek, arg_max(player_id, (expected_points, -player_id)) as top_entity, max(expected_points) as top_value, count(*) as n from part_rounds group by 1""")
def top_per_period(spark, sf):
    return ag.top_per_period(part_rounds(spark, sf), "gameweek", "player_id", "expected_points")


# --- boards: the rank column stands for the order ------------------------------------------------------

@query("leaderboard", f"""with {PARTS}
select row_number() over (order by expected_points desc, player_id) as rank, player_id, full_name, expected_points from part_scores qualify rank <= 15""")
def leaderboard(spark, sf):
    return ag.leaderboard(part_scores(spark, sf), "expected_points", "player_id", 15).select(
        "rank", "player_id", "full_name", "expected_points"
    )


@query("multi_key_rank", f"""with {PARTS}
select player_id, row_number() over (order by case when player_id % 6 = 0 then null else team_id end asc nulls last, expected_points desc, player_id) as rank from part_scores""")
def multi_key_rank(spark, sf):
    p = part_scores(spark, sf).withColumn("club", F.when(F.col("player_id") % 6 != 0, F.col("team_id")))
    return ag.full_ranking(p, ["club", "-expected_points", "player_id"]).select("player_id", "rank")


@query("position_rank", f"""with {PARTS}
select player_id, element_type, row_number() over (order by element_type, expected_points desc, player_id) as rank from part_scores""")
def position_rank(spark, sf):
    return ag.full_ranking(part_scores(spark, sf), ["element_type", "-expected_points", "player_id"]).select(
        "player_id", "element_type", "rank"
    )


@query("quota_topk", f"""with {PARTS}
select team_id, element_type, player_id, row_number() over (partition by team_id, element_type order by expected_points desc, player_id) as slot
from part_scores qualify slot <= case element_type when 1 then 1 when 2 then 4 when 3 then 4 else 2 end""")
def quota_topk(spark, sf):
    quota = F.element_at(F.array(*[F.lit(q) for q in (1, 4, 4, 2)]), F.col("element_type"))
    out = top_rows(part_scores(spark, sf), ["team_id", "element_type"], ["-expected_points", "player_id"], 4, "slot")
    return out.filter(F.col("slot") <= quota).select("team_id", "element_type", "player_id", "slot")


@query("standings", """
with p as (select c_nationkey as league, c_custkey as entry, c_acctbal as total from customer)
select league, entry, total, row_number() over (partition by league order by total desc, entry) as rank,
  round(max(total) over (partition by league) - total, 6) as gap_to_leader from p""")
def standings(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("league"), F.col("c_custkey").alias("entry"), F.col("c_acctbal").alias("total")
    )
    return rounded(ag.standings(c, ["league"], "total", "entry"), "gap_to_leader")


@query("projection_board", f"""with {PARTS}, {ROUNDS},
w as (select p.player_id, {_WIDE.replace('expected_points end', 'r.expected_points end').replace('gameweek', 'r.gameweek')},
    max(case when r.gameweek = 1 then r.confidence_score end) as confidence_score
  from part_scores p left join part_rounds r on r.player_id = p.player_id and r.gameweek <= 5 where p.team_id <= 12 group by 1),
t as (select *, expected_points_gw1 + expected_points_gw2 + expected_points_gw3 + expected_points_gw4 + expected_points_gw5 as ep from w)
select * exclude (ep), round(ep, 6) as expected_points, row_number() over (order by round(ep, 6) desc, player_id) as rank from t""")
def projection_board(spark, sf):
    chosen = part_scores(spark, sf).filter("team_id <= 12").select("player_id")
    board = ag.projection_board(part_rounds(spark, sf), chosen, [1, 2, 3, 4, 5]).drop("rank")
    return numbered(rounded(board, "expected_points"), [], ["-expected_points", "player_id"], "rank")


@query("nest_unnest", """
select o_orderkey, 0 as part_no, n as items, first_part, last_part from (
  select l_orderkey as o_orderkey, count(*) as n, min_by(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) as first_part,
    max_by(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) as last_part from lineitem group by 1)""")
def nest_unnest(spark, sf):
    nested = collect_parts(
        table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
        F.struct("l_partkey", "l_quantity"), "items",
    )
    return nested.select(
        F.col("l_orderkey").alias("o_orderkey"), "part_no", F.size("items").alias("n"),
        F.element_at("items", 1)["l_partkey"].alias("first_part"), F.element_at("items", -1)["l_partkey"].alias("last_part"),
    ).withColumnRenamed("n", "items")


@query("flatten_log", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as seat,
  case when row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) <= 3 then 'Starter'
    else 'Bench ' || (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) - 3) end as role
from lineitem""")
def flatten_log(spark, sf):
    nested = collect_parts(
        table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "items",
    )
    rows = nested.select("l_orderkey", "part_no", F.posexplode("items").alias("at", "i"))
    seat = F.col("part_no") * 1000 + F.col("at") + 1
    return rows.select("l_orderkey", "i.*", seat.alias("seat")).withColumn(
        "role", F.when(F.col("seat") <= 3, F.lit("Starter")).otherwise(F.concat(F.lit("Bench "), (F.col("seat") - 3).cast("string")))
    )


@query("skill_profile", f"""with {PARTS}, {ROUNDS},
w as (select player_id, sum(expected_points) / 5 as mean_per_round from part_rounds where gameweek <= 5 group by 1),
j as (select p.player_id, p.start_probability, p.confidence_score, coalesce(mean_per_round, 0.0) as mean_per_round from part_scores p left join w using (player_id))
select player_id, metric, round(value, 6) as value from (unpivot j on start_probability, confidence_score, mean_per_round into name metric value value)""")
def skill_profile(spark, sf):
    out = ag.skill_profile(part_scores(spark, sf), part_rounds(spark, sf), [1, 2, 3, 4, 5], ["start_probability", "confidence_score"])
    return rounded(out, "value")


# --- player expressions ----------------------------------------------------------------------------------

_STATUS = "case c_custkey % 8 when 0 then 'a' when 1 then 'd' when 2 then 'i' when 3 then 'S' when 4 then 'u' when 5 then 'n' when 6 then 'x' end"


def statuses(spark, sf):
    k = F.col("c_custkey") % 8
    s = F.when(k == 0, "a").when(k == 1, "d").when(k == 2, "i").when(k == 3, "S").when(k == 4, "u").when(k == 5, "n").when(k == 6, "x")
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", s.alias("status"),
        F.when(F.col("c_custkey") % 3 != 0, F.floor("c_acctbal") % 160 - 20).alias("this_round"),
        F.when(F.col("c_custkey") % 5 != 0, F.floor("c_acctbal") % 130).alias("next_round"),
    )


_ST = f"""st as (select c_custkey, c_name, {_STATUS} as status,
  case when c_custkey % 3 <> 0 then cast(floor(c_acctbal) as bigint) % 160 - 20 end as this_round,
  case when c_custkey % 5 <> 0 then cast(floor(c_acctbal) as bigint) % 130 end as next_round from customer)"""
_AV = f"""{_ST}, av as (select *, case lower(coalesce(status, '')) when 'a' then 1.0 when 'd' then 0.75 when 'i' then 0.0 when 's' then 0.0 when 'u' then 0.0 when 'n' then 0.0 else 0.5 end::double as status_availability,
  case when lower(coalesce(status, '')) in ('d', 'i') then 1 else 0 end as status_injury_flag,
  greatest(least(this_round, 100), 0) / 100.0::double as availability_this_round,
  greatest(least(next_round, 100), 0) / 100.0::double as availability_next_round,
  case when coalesce(greatest(least(this_round, 100), 0) < 100, false) or coalesce(greatest(least(next_round, 100), 0) < 100, false)
    or lower(coalesce(status, '')) in ('d', 'i', 's', 'u', 'n') then 1 else 0 end as injury_risk_flag from st)"""
_AVC = "c_custkey, status_availability, status_injury_flag, case when this_round is null then null else availability_this_round end as availability_this_round, case when next_round is null then null else availability_next_round end as availability_next_round, injury_risk_flag"


@query("availability_features", f"with {_AV} select {_AVC} from av")
def availability_features(spark, sf):
    s = statuses(spark, sf)
    made = pl.availability_columns("status", "this_round", "next_round")
    return s.select("c_custkey", *[c.alias(n) for n, c in made.items()])


@query("availability_resolution", f"""with {_AV}, x as (select {_AVC}, c_custkey % 9 as mult from av)
select c_custkey, case when mult <= 0 then 0.0 else greatest(0.0, least(1.0, coalesce(availability_next_round, availability_this_round, status_availability, 1.0))) end as availability from x""")
def availability_resolution(spark, sf):
    a = availability_features(spark, sf)
    return a.select(
        "c_custkey",
        pl.resolved_availability(
            F.col("availability_next_round"), F.col("availability_this_round"), F.col("status_availability"), F.col("c_custkey") % 9
        ).alias("availability"),
    )


@query("injury_flag", f"""with {_AV}, x as (select {_AVC}, status from av)
select c_custkey, case when injury_risk_flag > 0 or coalesce(availability_this_round, 1.0) < 1.0 or coalesce(availability_next_round, 1.0) < 1.0
   or lower(coalesce(status, '')) in ('d','i','s','u','n') then 1 else 0 end as injury_risk,
  cast(round_even(availability_this_round * 100, 0) as integer) as chance_pct from x""")
def injury_flag(spark, sf):
    s = statuses(spark, sf)
    a = s.withColumns(pl.availability_columns("status", "this_round", "next_round"))
    return a.select(
        "c_custkey",
        pl.injury_risk(F.col("injury_risk_flag"), F.col("availability_this_round"), F.col("availability_next_round"), F.col("status")).alias("injury_risk"),
        pl.chance_percent(F.col("availability_this_round")).alias("chance_pct"),
    )


@query("risk_issues", f"""with {_ST}
select * from (select c_custkey, concat_ws(',', case when lower(coalesce(status, '')) in ('d','i','s','u','n') then 'status=' || lower(status) end,
  case when next_round < 100 then 'chance_next_round=' || next_round || '%' end,
  case when c_custkey % 4 = 1 then 'low_model_confidence' end) as issues from st) where issues <> ''""")
def risk_issues(spark, sf):
    s = statuses(spark, sf).withColumn("level", F.when(F.col("c_custkey") % 4 == 1, "Low").otherwise("High"))
    return s.select("c_custkey", pl.risk_issues(F.col("status"), F.col("next_round").cast("double"), F.col("level")).alias("i")).filter(
        F.size("i") > 0
    ).select("c_custkey", F.array_join("i", ",").alias("issues"))


@query("duty_score", """
with d as (select p_partkey, case when p_size % 6 = 5 then null else p_size % 6 end as a, case when p_size % 4 = 3 then null else p_size % 4 end as b,
  case when p_size % 3 = 2 then 'none' else cast(p_size % 3 as varchar) end as c from part)
select p_partkey, case when coalesce(a, 0) > 0 then 1 else 0 end as has_corners_duty, case when a = 1 then 1 else 0 end as primary_corners_taker,
  case when coalesce(try_cast(c as integer), 0) > 0 then 1 else 0 end as has_penalty_duty,
  round(coalesce(case when a > 0 then 1.0 / a end, 0.0) + coalesce(case when b > 0 then 1.0 / b end, 0.0) + coalesce(case when try_cast(c as integer) > 0 then 1.0 / try_cast(c as integer) end, 0.0), 6) as set_piece_duty_score from d""")
def duty_score(spark, sf):
    size = F.col("p_size")
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(size % 6 != 5, size % 6).alias("corners_and_indirect_freekicks_order"),
        F.when(size % 4 != 3, size % 4).alias("direct_freekicks_order"),
        F.when(size % 3 == 2, F.lit("none")).otherwise((size % 3).cast("string")).alias("penalties_order"),
    )
    out = p.withColumns(pl.duty_columns())
    return rounded(out, "set_piece_duty_score").select(
        "p_partkey", "has_corners_duty", "primary_corners_taker", "has_penalty_duty", "set_piece_duty_score"
    )


@query("one_hot", """
select p_partkey, case when p_size % 5 = 1 then 1.0 else 0.0 end as position_gk, case when p_size % 5 = 2 then 1.0 else 0.0 end as position_def,
  case when p_size % 5 = 3 then 1.0 else 0.0 end as position_mid, case when p_size % 5 = 4 then 1.0 else 0.0 end as position_fwd from part""")
def one_hot(spark, sf):
    p = table(spark, sf, "part").withColumn("pos", F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 5))
    return p.select("p_partkey", *[c.alias(n) for n, c in pl.position_flags("pos").items()])


@query("derived_measures", """
with m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as g, case when l_returnflag = 'R' then null else l_linenumber end as a,
  l_discount * 100 as xg, case when l_linestatus = 'O' then 0 else l_quantity * 2 end as mins, l_tax * 100 as pts from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, g + coalesce(a, 0) as attacking_returns, round(g - xg, 6) as finishing_plus_minus,
  round(g / nullif(xg, 0), 6) as finishing_ratio, round(mins / 90.0, 6) as minutes_share, round(pts * 90 / nullif(mins, 0), 6) as points_per_90 from m""")
def derived_measures(spark, sf):
    m = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("goals_scored"),
        F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("assists"), (F.col("l_discount") * 100).alias("expected_goals"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(F.col("l_quantity") * 2).alias("minutes"), (F.col("l_tax") * 100).alias("total_points"),
    )
    made = pl.match_measures(m.columns)
    names = ["attacking_returns", "finishing_plus_minus", "finishing_ratio", "minutes_share", "points_per_90"]
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[r6(made[n]).alias(n) for n in names])


@query("dim_names", """
select p_partkey, case when p_size % 10 = 0 then null else split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) end as full_name,
  round(p_size / 10.0, 6) as now_cost_millions from part""")
def dim_names(spark, sf):
    from rosterlake.sources.landed import name_elements

    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("team"), F.col("p_size").alias("now_cost"),
        F.when(F.col("p_size") % 10 != 0, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("first_name"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second_name"),
    )
    return rounded(name_elements(raw), "now_cost_millions").select(
        F.col("player_id").alias("p_partkey"), "full_name", "now_cost_millions"
    )


@query("reliability", """
select c_custkey, round(greatest(0.0, least(1.0, coalesce(n, 0) / 3.0)), 6) as from_matches, round(greatest(0.0, least(1.0, coalesce(m, 0) / 270.0)), 6) as from_minutes
from customer left join (select o_custkey, count(*) as n, cast(sum(o_orderkey % 30) as double) as m from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey""")
def reliability(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey") % 30).alias("m")
    )
    j = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return j.select("c_custkey", r6(pl.reliability(F.col("n"))).alias("from_matches"), r6(pl.reliability(None, F.col("m"))).alias("from_minutes"))


@query("captain_score", f"""with {PARTS},
s as (select player_id, expected_points, floor(start_probability * (player_id % 5) * 25) / 100.0::double as st, confidence_score from part_scores)
select player_id, round(expected_points * case when st < 0.65 then 0.5 else 1.0 end * (0.5 + 0.35 * st + 0.15 * confidence_score / 100.0), 10) as captain_score from s""")
def captain_score(spark, sf):
    return part_scores(spark, sf).select(
        "player_id",
        F.round(
            pl.captain_score(F.col("expected_points"), F.floor(F.col("start_probability") * (F.col("player_id") % 5) * 25) / 100.0, F.lit(1.0), F.col("confidence_score")), 10
        ).alias("captain_score"),
    )


@query("board_text", f"""with {PARTS}
select player_id, case element_type when 1 then 'GK' when 2 then 'DEF' when 3 then 'MID' else 'FWD' end as position,
  format('{{:.1f}}', now_cost_millions) || ' - ' || format('{{:.1f}}', now_cost_millions + 1.5) as band, confidence_score::bigint || '%' as confidence from part_scores""")
def board_text(spark, sf):
    return part_scores(spark, sf).select(
        "player_id", pl.position_label("element_type").alias("position"),
        pl.range_text(F.col("now_cost_millions"), F.col("now_cost_millions") + 1.5).alias("band"),
        pl.percent_text(F.col("confidence_score") / 100.0).alias("confidence"),
    )


@query("role_notes", """
with l as (select *, l_linenumber % 4 as m from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(' ', case when m > 0 then 'Starter' else 'Bench' end, case when m > 1 then 'x' || m end,
  case when l_returnflag = 'R' then 'C' when l_returnflag = 'A' then 'VC' end) as role,
  case when m > 0 and l_quantity <= 2 then 'low_impact' when m = 0 and l_quantity >= 6 then 'bench_haul' else '' end as note from l""")
def role_notes(spark, sf):
    m = F.col("l_linenumber") % 4
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        pl.role_label(m, F.col("l_returnflag") == "R", F.col("l_returnflag") == "A").alias("role"), pl.form_note(m, F.col("l_quantity")).alias("note"),
    )
