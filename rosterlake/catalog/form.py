"""Windows, dedup, set operations and season arithmetic on the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rosterlake.catalog.base import ENTITY, ORDERS, TIME, day, orders_panel, query, r6, rounded, table
from rosterlake.functions import seasons as s
from rosterlake.functions.numbers import safe_ratio, to_number
from rosterlake.operators import panel
from rosterlake.operators.aggregates import union_by_name
from rosterlake.operators.joins import team_views

_OVER = "partition by o_custkey, season order by o_orderdate, o_orderkey"


@query("rolling_form", f"""
with o as ({ORDERS})
select o_orderkey, o_custkey,
  round(avg(o_totalprice) over ({_OVER} rows between 3 preceding and 1 preceding), 6) as o_totalprice_ma3,
  round(avg(o_totalprice) over ({_OVER} rows between 5 preceding and 1 preceding), 6) as o_totalprice_ma5
from o""")
def rolling_form(spark, sf):
    out = panel.form(orders_panel(spark, sf), ENTITY, TIME, ["o_totalprice"], (3, 5), lags=False)
    return rounded(out, "o_totalprice_ma3", "o_totalprice_ma5").select(
        "o_orderkey", "o_custkey", "o_totalprice_ma3", "o_totalprice_ma5"
    )


@query("lag_features", f"""
with o as ({ORDERS})
select o_orderkey, lag(o_totalprice) over ({_OVER}) as o_totalprice_lag1,
  lag(priority) over ({_OVER}) as priority_lag1
from (select *, cast(substr(o_orderpriority, 1, 1) as double) as priority from o)""")
def lag_features(spark, sf):
    o = orders_panel(spark, sf).withColumn("priority", F.substring("o_orderpriority", 1, 1).cast("double"))
    out = panel.form(o, ENTITY, TIME, ["o_totalprice", "priority"], (), lags=True)
    return out.select("o_orderkey", "o_totalprice_lag1", "priority_lag1")


@query("prior_count", f"""
with o as ({ORDERS})
select o_orderkey, row_number() over ({_OVER}) - 1 as prev_matches,
  case when row_number() over ({_OVER}) - 1 >= 3 then 1 else 0 end as enough_prev from o""")
def prior_count(spark, sf):
    return panel.prior_count(orders_panel(spark, sf), ENTITY, TIME).select(
        "o_orderkey", "prev_matches", F.col("enough_prev").cast("int").alias("enough_prev")
    )


@query("rolling_form_with_nulls", f"""
with o as (select *, case when o_orderkey % 4 = 0 then null else o_totalprice end as price from ({ORDERS}))
select o_orderkey, round(avg(price) over ({_OVER} rows between 5 preceding and 1 preceding), 6) as price_ma5,
  lag(price) over ({_OVER}) as price_lag1 from o""")
def rolling_form_with_nulls(spark, sf):
    o = orders_panel(spark, sf).withColumn(
        "price", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice"))
    )
    return panel.form(o, ENTITY, TIME, ["price"]).select(
        "o_orderkey", r6("price_ma5").alias("price_ma5"), "price_lag1"
    )


@query("safe_ratio", """
select o_orderkey, round(o_totalprice / nullif(cast(o_orderkey % 5 as double), 0), 6) as ratio from orders""")
def safe_ratio_query(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", r6(safe_ratio("o_totalprice", (F.col("o_orderkey") % 5).cast("double"))).alias("ratio")
    )


@query("try_cast_measures", """
select event_id, try_cast(raw as double) as measure from (
  select event_id, case when event_id % 3 = 0 then event_type when event_id % 7 = 0 then ''
    else cast(json_extract_string(props, '$.k') as varchar) end as raw from events)""")
def try_cast_measures(spark, sf):
    e = table(spark, sf, "events")
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 7 == 0, F.lit(""))
        .otherwise(F.get_json_object("props", "$.k"))
    )
    return e.select("event_id", to_number(raw).alias("measure"))


# A match = an order; its two sides = the smallest and the largest supplier of its lines.
_MATCH = """
lines as (
  select l_orderkey as fixture, l_suppkey as team, year(o_orderdate) as season, o_orderdate,
    cast(sum(l_quantity) as bigint) % 5 as goals
  from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3, 4
),
sides as (
  select fixture, season, o_orderdate, min(team) as home, max(team) as away,
    min_by(goals, team) as h_score, max_by(goals, team) as a_score
  from lines group by 1, 2, 3 having count(*) > 1
),
match_rows as (
  select fixture, season, o_orderdate, home as team, away as opponent, h_score as gf, a_score as ga from sides
  union all
  select fixture, season, o_orderdate, away, home, a_score, h_score from sides
)"""


LINES_A_TASK = 500_000


def dealt(spark, sf, df, key):
    """By ``key`` into tasks that hold about as many lines at any size of the tables, however many tasks a shuffle has by default."""
    tasks = math.ceil(table(spark, sf, "lineitem").count() / LINES_A_TASK)  # a count from the file footers
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks), key)


def match_sides(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = dealt(spark, sf, table(spark, sf, "lineitem"), "l_orderkey").join(
        dealt(spark, sf, orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).groupBy(
        F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("team"),
        F.year("o_orderdate").alias("season_name"), "o_orderdate",
    ).agg((F.sum("l_quantity").cast("long") % 5).alias("goals"))
    return lines.groupBy("id", "season_name", "o_orderdate").agg(
        F.min("team").alias("team_h"), F.max("team").alias("team_a"),
        F.min_by("goals", "team").alias("h_score"), F.max_by("goals", "team").alias("a_score"),
        F.count(F.lit(1)).alias("_n"),
    ).filter(F.col("_n") > 1).drop("_n")


def match_rows(spark, sf):
    """One row per (match, side, line of the side's team): players of a team repeat its match."""
    views = team_views(match_sides(spark, sf), ["season_name", "o_orderdate", "h_score", "a_score"])
    return views.select(
        "fixture", "season_name", "o_orderdate", F.col("team_id").alias("team"),
        F.col("opponent_id").alias("opponent_team"), F.col("is_home").alias("was_home"),
        F.col("h_score").alias("team_h_score"), F.col("a_score").alias("team_a_score"),
    )


_TEAM_OVER = "partition by season, team order by o_orderdate, fixture rows between 5 preceding and 1 preceding"
_FORM = _MATCH + f""",
form as (
  select season, fixture, team, opponent,
    round(avg(gf) over ({_TEAM_OVER}), 6) as team_goals_for_ma5,
    round(avg(ga) over ({_TEAM_OVER}), 6) as team_goals_against_ma5,
    round(avg(case when gf > ga then 3 when gf = ga then 1 else 0 end) over ({_TEAM_OVER}), 6) as team_match_points_ma5
  from match_rows
)"""


@query("team_form_dedup", f"with {_FORM} select season as season_name, fixture, team, "
       "team_goals_for_ma5, team_goals_against_ma5, team_match_points_ma5 from form")
def team_form_dedup(spark, sf):
    from rosterlake.plans.features import team_form

    # every match is there once per line of the order, as it would be once per player
    rows = match_rows(spark, sf)
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fixture"), "l_linenumber")
    repeated = dealt(spark, sf, rows, "fixture").join(dealt(spark, sf, lines, "fixture"), "fixture")
    out = team_form(repeated, ["o_orderdate", "fixture"])
    cols = ["team_goals_for_ma5", "team_goals_against_ma5", "team_match_points_ma5"]
    return rounded(out, *cols).select("season_name", "fixture", "team", *cols)


@query("opponent_form", f"""with {_FORM}
select a.season as season_name, a.fixture, a.team, a.team_goals_for_ma5,
  b.team_goals_for_ma5 as opp_team_goals_for_ma5, b.team_match_points_ma5 as opp_team_match_points_ma5
from form a left join form b on a.season = b.season and a.fixture = b.fixture and a.opponent = b.team""")
def opponent_form(spark, sf):
    from rosterlake.plans.features import add_team_context

    out = add_team_context(match_rows(spark, sf), ["o_orderdate", "fixture"])
    cols = ["team_goals_for_ma5", "opp_team_goals_for_ma5", "opp_team_match_points_ma5"]
    return rounded(out, *cols).select("season_name", "fixture", "team", *cols)


@query("latest_row", """
select o_custkey, o_orderkey, o_totalprice from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn
  from orders where o_orderdate < timestamp '2000-01-01') where rn = 1""")
def latest_row(spark, sf):
    out = panel.latest_row(
        orders_panel(spark, sf), ["o_custkey"], TIME, F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    )
    return out.select("o_custkey", "o_orderkey", "o_totalprice")


@query("latest_with_fallback", f"""
with o as ({ORDERS})
select c_custkey, o_orderkey, season, o_totalprice from customer left join (
  select *, row_number() over (partition by o_custkey order by (case when season = 2000 then 1 else 0 end) desc,
    o_orderdate desc, o_orderkey desc) as rn from o where season <= 2000) on c_custkey = o_custkey and rn = 1""")
def latest_with_fallback(spark, sf):
    o = orders_panel(spark, sf).filter(F.col("season") <= 2000)
    last = panel.latest_with_fallback(o, ["o_custkey"], TIME, F.col("season") == 2000)
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "o_orderkey", "season", "o_totalprice"
    )


@query("tail_mean", """
select o_custkey, round(avg(o_totalprice), 6) as o_totalprice_ma5 from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
where rn <= 5 group by o_custkey""")
def tail_mean(spark, sf):
    return rounded(
        panel.tail_mean(orders_panel(spark, sf), ["o_custkey"], TIME, ["o_totalprice"]), "o_totalprice_ma5"
    )


@query("expanding_mean_delta", """
select o_orderkey, cast(coalesce(lag(rk) over w - rk, 0) as double) as rk_delta,
  round(avg(o_totalprice) over (w rows between unbounded preceding and current row), 6) as o_totalprice_average
from (select *, cast(substr(o_orderpriority, 1, 1) as integer) as rk from orders)
window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def expanding_mean_delta(spark, sf):
    o = orders_panel(spark, sf).withColumn("rk", F.substring("o_orderpriority", 1, 1).cast("int"))
    out = panel.change_and_expanding(o, ["o_custkey"], TIME, "rk", "o_totalprice")
    return rounded(out, "o_totalprice_average").select("o_orderkey", "rk_delta", "o_totalprice_average")


@query("best_future_in_half", """
select o_orderkey, coalesce(max(o_totalprice) over (partition by o_custkey, year(o_orderdate),
    case when month(o_orderdate) <= 6 then 1 else 2 end
  order by o_orderdate, o_orderkey rows between 1 following and unbounded following), 0.0::double) as best_future
from orders""")
def best_future_in_half(spark, sf):
    o = orders_panel(spark, sf).withColumn("half", F.when(F.month("o_orderdate") <= 6, 1).otherwise(2))
    return panel.best_future(o, [*ENTITY, "half"], TIME, "o_totalprice").select("o_orderkey", "best_future")


@query("rank_movement", f"""
with o as ({ORDERS}),
sp as (select season, o_custkey, sum(cast(o_totalprice as decimal(18,2))) as pts from o group by 1, 2),
rk as (select *, row_number() over (partition by season order by pts desc, o_custkey) as rk from sp)
select a.season, a.o_custkey, a.rk, coalesce(b.rk - a.rk, 0) as movement
from rk a left join rk b on a.o_custkey = b.o_custkey and a.season = b.season + 1""")
def rank_movement(spark, sf):
    from rosterlake.operators.ordered import numbered

    pts = orders_panel(spark, sf).groupBy("season", "o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("pts")
    )
    ranked = numbered(pts, ["season"], ["-pts", "o_custkey"], "rk")
    before = ranked.select((F.col("season") + 1).alias("season"), "o_custkey", F.col("rk").alias("last_rk"))
    return panel.rank_movement(ranked.join(before, ["season", "o_custkey"], "left"), "rk", "last_rk").select(
        "season", "o_custkey", "rk", "movement"
    )


_LABEL = "case when o_orderkey % 10 = 9 then null else cast(year(o_orderdate) as varchar) || '-' || lpad(cast((year(o_orderdate) + 1) % 100 as varchar), 2, '0') end"


def labelled(spark, sf):
    o = orders_panel(spark, sf)
    return o.withColumn("season_name", F.when(F.col("o_orderkey") % 10 != 9, s.season_code(F.col("season"))))


@query("season_weights", f"""
with o as (select {_LABEL} as season_name from orders),
d as (select season_name, row_number() over (order by season_name) - 1 as season_rank
      from (select distinct season_name from o where season_name is not null)),
w as (select season_name, greatest(0.25, pow(0.7, (select max(season_rank) from d) - season_rank)) as wt from d)
select o.season_name, count(*) as n, round(max(coalesce(wt, 1.0)), 6) as season_weight
from o left join w on o.season_name = w.season_name group by o.season_name""")
def season_weights(spark, sf):
    out = panel.add_season_weight(labelled(spark, sf), "season_name")
    return out.groupBy("season_name").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max("season_weight")).alias("season_weight")
    )


@query("recent_n", "select o_orderkey, o_totalprice from orders order by o_orderdate desc, o_orderkey desc limit 1000")
def recent_n(spark, sf):
    """The thousand most recent orders: the number is the feature."""
    return panel.recent_rows(orders_panel(spark, sf), TIME, 1000).select("o_orderkey", "o_totalprice")


@query("forward_folds", """
with o as (select *, year(o_orderdate) as season, month(o_orderdate) as round from orders),
p as (select season, round, row_number() over (order by season, round) - 1 as period_index
      from (select distinct season, round from o)),
k as (select count(*) as n, count(*) // 4 as size from p),
f as (select p.*, case when period_index < n - size * 3 then 0
        else (period_index - (n - size * 3)) // greatest(size, 1) + 1 end as fold from p, k)
select season, round, period_index, fold, count(*) as n from o join f using (season, round) group by all""")
def forward_folds(spark, sf):
    o = orders_panel(spark, sf).withColumn("round", F.month("o_orderdate"))
    folds = panel.forward_folds(o, ["season", "round"], 3)
    return o.join(folds, ["season", "round"]).groupBy("season", "round", "period_index", "fold").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("distinct_periods", """
select season, round, row_number() over (order by season, round) - 1 as period_index
from (select distinct year(o_orderdate) as season, month(o_orderdate) as round from orders)""")
def distinct_periods(spark, sf):
    o = orders_panel(spark, sf).withColumn("round", F.month("o_orderdate"))
    return panel.distinct_periods(o, ["season", "round"])


_LINE_TIE = "l_partkey, l_suppkey, l_shipdate"


@query("dedup_first", f"""
select l_orderkey, l_linenumber, l_partkey, l_quantity, source_no from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by source_no, {_LINE_TIE}) as rn
  from (select *, case when l_returnflag = 'R' then 1 else 2 end as source_no from lineitem)) where rn = 1""")
def dedup_first(spark, sf):
    l = table(spark, sf, "lineitem").withColumn(
        "source_no", F.when(F.col("l_returnflag") == "R", 1).otherwise(2)
    )
    out = panel.dedup_first(
        l, ["l_orderkey", "l_linenumber"], ["source_no", "l_partkey", "l_suppkey", "l_shipdate"]
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "source_no")


@query("dedup_last", """
select user_id, event_type, event_id, value from (
  select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events)
where rn = 1""")
def dedup_last(spark, sf):
    return panel.dedup_last(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value"
    )


@query("union_missing_cols", """
select cast(o_orderkey as bigint) as id, o_totalprice as amount, null::varchar as kind, o_orderstatus as status from orders
union all by name
select event_id as id, value as amount, event_type as kind, null::varchar as status from events""")
def union_missing_cols(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status")
    )
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("kind")
    )
    return union_by_name(o, e)


# --- season labels and round bounds -----------------------------------------------------------

@query("season_label_year", f"""
with o as (select o_orderkey, case when o_orderkey % 7 = 0 then 'season ' || cast(year(o_orderdate) as varchar)
    when o_orderkey % 7 = 1 then 'n/a' else {_LABEL} end as label from orders)
select o_orderkey, cast(nullif(regexp_extract(label, '(\\d{{4}})', 1), '') as integer) as start_year from o""")
def season_label_year(spark, sf):
    o = labelled(spark, sf)
    label = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("season "), F.col("season").cast("string")))
        .when(F.col("o_orderkey") % 7 == 1, F.lit("n/a")).otherwise(F.col("season_name"))
    )
    return o.select("o_orderkey", s.season_start_year(label).alias("start_year"))


@query("season_code", """
with o as (select o_orderkey, year(o_orderdate) - case when month(o_orderdate) < 7 then 1 else 0 end as y from orders)
select o_orderkey, cast(y as varchar) || '-' || lpad(cast((y + 1) % 100 as varchar), 2, '0') as season_name,
  cast(y - 1 as varchar) || '-' || lpad(cast(y % 100 as varchar), 2, '0') as previous_season,
  cast(y as varchar) || '-' || lpad(cast((y + 1) % 100 as varchar), 2, '0') || ',' ||
  cast(y - 1 as varchar) || '-' || lpad(cast(y % 100 as varchar), 2, '0') || ',' ||
  cast(y - 2 as varchar) || '-' || lpad(cast((y - 1) % 100 as varchar), 2, '0') as codes
from o""")
def season_code(spark, sf):
    code = s.season_for_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", code.alias("season_name")).select(
        "o_orderkey", "season_name", s.previous_season("season_name").alias("previous_season"),
        F.array_join(s.prior_season_codes("season_name", 2), ",").alias("codes"),
    )


# Rounds = months of the order table, numbered from its first year.
_EVENTS = """
ev as (
  select (year(o_orderdate) - 1995) * 12 + month(o_orderdate) as id,
    bool_and(o_orderdate < timestamp '1999-04-01') as finished,
    bool_and(o_orderdate < timestamp '1999-02-01') as data_checked,
    (year(o_orderdate) - 1995) * 12 + month(o_orderdate) = 53 as is_next,
    min(o_orderdate) as deadline
  from orders group by 1, 4
)"""


def month_events(spark, sf):
    o = table(spark, sf, "orders")
    before = lambda d: F.bool_and(F.col("o_orderdate") < F.lit(d).cast("timestamp_ntz"))
    return o.groupBy(((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("id")).agg(
        before("1999-04-01").alias("finished"), before("1999-02-01").alias("data_checked"),
        F.min("o_orderdate").cast("string").alias("deadline_time"),
    ).withColumn("is_next", F.col("id") == 53)


@query("period_bounds", f"""with {_EVENTS}
select coalesce(min(case when is_next then id end), max(id) + 1) as next_round,
  coalesce(max(case when finished and data_checked then id end), 0) as last_final_round from ev""")
def period_bounds(spark, sf):
    return s.round_bounds(month_events(spark, sf))


@query("period_choice", f"""with {_EVENTS},
b as (select coalesce(min(case when is_next then id end), max(id) + 1) as nr,
  coalesce(max(case when finished and data_checked then id end), 0) as lf from ev),
a as (select id from ev where id <> 53)
select coalesce(max(case when id = nr then id end), min(case when id > lf then id end), max(id)) as chosen_round
from a, b""")
def period_choice(spark, sf):
    events = month_events(spark, sf)
    published = events.filter(F.col("id") != 53).select(F.col("id").alias("gameweek"))
    return s.choose_round(published, s.round_bounds(events))


@query("season_inferred", f"""with {_EVENTS}
select cast(year(min(deadline)) as varchar) || '-' || lpad(cast((year(min(deadline)) + 1) % 100 as varchar), 2, '0')
  as season_name from ev""")
def season_inferred(spark, sf):
    return s.infer_season(month_events(spark, sf))


@query("sort_keys", f"""
with o as (select o_orderkey, o_custkey, {_LABEL} as season_name, o_orderdate from orders),
k as (select *, cast(nullif(regexp_extract(season_name, '(\\d{{4}})', 1), '') as integer) as y from o)
select o_orderkey, coalesce(y, (select max(y) + 1 from k)) as season_sort,
  row_number() over (partition by o_custkey order by coalesce(y, (select max(y) + 1 from k)), o_orderdate, o_orderkey) as seq
from k""")
def sort_keys(spark, sf):
    from rosterlake.operators.ordered import numbered
    from rosterlake.plans.features import add_sort_keys

    o = labelled(spark, sf).withColumn("kickoff_time", F.col("o_orderdate").cast("string"))
    keyed = add_sort_keys(o)
    return numbered(keyed, ["o_custkey"], ["season_sort", "kickoff_sort", "o_orderkey"], "seq").select(
        "o_orderkey", "season_sort", "seq"
    )


@query("completed_rows", """
with o as (select *, year(o_orderdate) as y, month(o_orderdate) as round from orders)
select y as season, round, count(*) as n from o
where y < (select max(y) from o) or (y = (select max(y) from o) and round <= 4) group by 1, 2""")
def completed_rows(spark, sf):
    from rosterlake.plans.features import add_sort_keys, as_of

    o = orders_panel(spark, sf).withColumns(
        {"season_name": s.season_code(F.col("season")), "round": F.month("o_orderdate")}
    )
    return as_of(add_sort_keys(o), last_final=4).groupBy("season", "round").agg(F.count(F.lit(1)).alias("n"))


@query("temporal_targets", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') as ship_day,
  case when coalesce(minutes, 0) >= 60 then 1 else 0 end as starts,
  case when coalesce(minutes, 0) > 0 then 1 else 0 end as appears
from (select *, case when l_returnflag = 'N' then null else l_quantity * 2 - 10 end as minutes from lineitem)""")
def temporal_targets(spark, sf):
    from rosterlake.plans.ml import target_columns

    l = table(spark, sf, "lineitem").withColumn(
        "minutes", F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * 2 - 10)
    )
    return l.withColumns(target_columns("minutes")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day("l_shipdate").alias("ship_day"), "starts", "appears"
    )
