"""Squads, line-ups, transfers, chips and ledgers on the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rosterlake.catalog.base import (
    FORMATION_ROWS, LINEUP, PARTS, ROUNDS, SQUADS, orders_panel, part_rounds, part_scores, query, r6, rounded, squads, table,
)
from rosterlake.catalog.summaries import chip_column
from rosterlake.constants import SQUAD_SIZE
from rosterlake.functions.numbers import flag
from rosterlake.functions.players import captain_score
from rosterlake.operators import ledger, squad as sq
from rosterlake.operators.joins import pair_by_rank
from rosterlake.operators.ordered import numbered
from rosterlake.operators.programme import best_squads
from rosterlake.operators.swaps import useful
from rosterlake.plans.analysis import analysis_context
from rosterlake.session import stored

SQUAD = ["squad_id"]

# Flags of a user's own choice: starters, bench and captain by id; squads 0 mod 5 carry none.
_FLAG_ROWS = """
seat as (select *, row_number() over (partition by squad_id order by element_type, player_id) as seat from squads),
flagged as (select *, case when squad_id % 5 = 0 then 0 when seat <= 11 then 1 else 0 end as starting,
  case when squad_id % 3 = 0 or squad_id % 5 = 0 then 0 when seat > 11 then 1 else 0 end as bench,
  case when squad_id % 4 <> 0 and seat = 5 then 1 when squad_id % 7 = 0 and seat = 12 then 1 else 0 end as captain from seat)"""
_FLAGS = SQUADS + "," + _FLAG_ROWS


def flagged_squads(spark, sf):
    s = numbered(squads(spark, sf), SQUAD, ["element_type", "player_id"], "seat")
    sid, seat = F.col("squad_id"), F.col("seat")
    return s.withColumns(
        {
            "starting": F.when(sid % 5 == 0, 0).when(seat <= 11, 1).otherwise(0),
            "bench": F.when((sid % 3 == 0) | (sid % 5 == 0), 0).when(seat > 11, 1).otherwise(0),
            "captain": F.when((sid % 4 != 0) & (seat == 5), 1).when((sid % 7 == 0) & (seat == 12), 1).otherwise(0),
        }
    )


_SUMMARY = """
agg as (select squad_id, sum(starting) as ns, sum(bench) as nb, sum(expected_points) as ep, sum(now_cost_millions) as total_cost,
    sum(case when starting = 1 then expected_points end) as eps, sum(case when starting = 1 then now_cost_millions end) as cs,
    sum(case when starting <> 1 then expected_points end) as epn, sum(case when starting <> 1 then now_cost_millions end) as cn,
    sum(case when bench = 1 then expected_points end) as epb, sum(case when bench = 1 then now_cost_millions end) as cb,
    min(case when captain = 1 then player_id end) as captain_id from flagged group by 1),
summary as (select a.squad_id, coalesce(case when ns = 0 then ep else eps end, 0.0) as expected_points_without_captain,
    coalesce(case when nb > 0 then epb when ns = 0 then 0.0 else epn end, 0.0) as bench_expected_points,
    coalesce(case when ns = 0 then total_cost else cs end, 0.0) as starting_cost, total_cost, captain_id,
    coalesce(ns = 0 or f.starting = 1, true) as captain_ok, case when ns = 0 or f.starting = 1 then coalesce(f.expected_points, 0.0) else 0.0 end as cap
  from agg a left join flagged f on f.squad_id = a.squad_id and f.player_id = a.captain_id)"""


@query("squad_summary", f"""with {_FLAGS}, {_SUMMARY}
select squad_id, round(expected_points_without_captain, 6) as expected_points_without_captain,
  round(expected_points_without_captain + cap, 6) as total_expected_points_with_captain, round(bench_expected_points, 6) as bench_expected_points,
  round(starting_cost, 6) as starting_cost, round(total_cost, 6) as total_cost, captain_id, cast(captain_ok as integer) as captain_ok from summary""")
def squad_summary(spark, sf):
    out = sq.summarise(flagged_squads(spark, sf), SQUAD)
    cols = ["expected_points_without_captain", "total_expected_points_with_captain", "bench_expected_points", "starting_cost", "total_cost"]
    return rounded(out, *cols).select("squad_id", *cols, "captain_id", flag(F.col("captain_ok")).alias("captain_ok"))


_LEGAL = """
c as (select squad_id, team_id, count(*) as n from squads group by 1, 2),
l as (select s.squad_id, count(*) as n, count(distinct player_id) as nd, sum(now_cost_millions) as cost,
    bool_and(true) and count(*) filter (where element_type = 1) = 2 and count(*) filter (where element_type = 2) = 5
      and count(*) filter (where element_type = 3) = 5 and count(*) filter (where element_type = 4) = 3 as q from squads s group by 1)"""


@query("squad_legality", f"""with {SQUADS}, {_LEGAL}
select squad_id, n, max_club, round(cost, 6) as total_cost, cast(q as integer) as quota_ok, cast(max_club <= 3 as integer) as club_ok,
  cast(cost <= 130.000001 as integer) as budget_ok, cast(n = 15 and nd = 15 and q and max_club <= 3 and cost <= 130.000001 as integer) as legal
from l join (select squad_id, max(n) as max_club from c group by 1) using (squad_id)""")
def squad_legality(spark, sf):
    out = sq.legality(squads(spark, sf), SQUAD, 130.0)
    return out.select(
        "squad_id", "n", "max_club", r6("total_cost").alias("total_cost"), *[flag(F.col(c)).alias(c) for c in ("quota_ok", "club_ok", "budget_ok", "legal")]
    )


@query("squad_shape", f"""with {_FLAGS}
select squad_id, count(*) as n, sum(starting) as starters, sum(bench) as benched, cast(count(*) = 15 and sum(starting) = 11 and
  coalesce(max(case when captain = 1 then starting end), 0) = 1 as integer) as shape_ok from flagged group by 1""")
def squad_shape(spark, sf):
    f = flagged_squads(spark, sf)
    return f.groupBy("squad_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("starting").alias("starters"), F.sum("bench").alias("benched"),
        flag(
            (F.count(F.lit(1)) == 15) & (F.sum("starting") == 11) & (F.max(F.when(F.col("captain") == 1, F.col("starting"))) == 1)
        ).alias("shape_ok"),
    )


@query("sale_value", f"""with {SQUADS},
p as (select squad_id, price_tenths as now, case when player_id % 6 = 0 then null else 40 + player_id * 7 % 100 end as bought from squads)
select squad_id, cast(sum(case when now <= coalesce(bought, now) then now else bought + (now - bought) // 2 end) as bigint) as sale_value_tenths from p group by 1""")
def sale_value_query(spark, sf):
    s = squads(spark, sf).withColumns(
        {
            "current_tenths": F.col("price_tenths"),
            "purchase_tenths": F.when(F.col("player_id") % 6 != 0, F.col("player_id") * 7 % 100 + 40),
        }
    )
    return sq.squad_sale_value(s, SQUAD)


_BEST_TOTAL = """
optimal as (select squad_id, sum(case when starting = 1 then expected_points end) + max(case when starting = 1 then expected_points end) as optimal_points
  from lineup group by 1)"""


def optimal_totals(spark, sf):
    starts = F.col("starting") == 1
    return sq.best_lineup(squads(spark, sf), SQUAD).groupBy("squad_id").agg(
        (F.sum(F.when(starts, F.col("expected_points"))) + F.max(F.when(starts, F.col("expected_points")))).alias(
            "total_expected_points_with_captain"
        )
    )


_GAP = LINEUP + "," + _BEST_TOTAL + "," + _FLAG_ROWS + "," + _SUMMARY


@query("gap_rating", f"""with {_GAP}
select squad_id, round(expected_points_without_captain + cap, 6) as user_points, round(optimal_points, 6) as optimal_points,
  round(optimal_points - expected_points_without_captain - cap, 6) as points_gap,
  round(case when optimal_points <= 0 then 0.0 else (expected_points_without_captain + cap) / optimal_points * 100 end, 6) as rating
from summary join optimal using (squad_id)""")
def gap_rating(spark, sf):
    user = sq.summarise(flagged_squads(spark, sf), SQUAD)
    out = sq.gap_and_rating(user, optimal_totals(spark, sf), SQUAD)
    return rounded(out, "user_points", "optimal_points", "points_gap", "rating")


@query("owned_lineup", f"""with {LINEUP}
select squad_id, player_id, formation_no, round(xi_points, 6) as xi_points, starting from lineup""")
def owned_lineup(spark, sf):
    out = sq.best_lineup(squads(spark, sf), SQUAD)
    return rounded(out, "xi_points").select("squad_id", "player_id", "formation_no", "xi_points", "starting")


@query("bench_order", f"with {LINEUP} select squad_id, player_id, bench_order from lineup_ordered where starting = 0")
def bench_order(spark, sf):
    return sq.best_lineup(squads(spark, sf), SQUAD).filter("starting = 0").select("squad_id", "player_id", "bench_order")


_CAP = LINEUP + """,
scored as (select *, expected_points * case when start_probability < 0.65 then 0.5 else 1.0 end * (0.5 + 0.35 * start_probability + 0.15 * confidence_score / 100.0) as cs from lineup_ordered),
cranked as (select *, case when starting = 1 then row_number() over (partition by squad_id, starting order by round(cs, 9) desc, expected_points desc, player_id) end as crank from scored)"""


def captained(spark, sf):
    lineup = sq.best_lineup(squads(spark, sf), SQUAD)
    scored = lineup.withColumn(
        "captain_score",
        F.round(captain_score(F.col("expected_points"), F.col("start_probability"), F.lit(1.0), F.col("confidence_score")), 9),
    )
    return sq.with_captains(scored, SQUAD)


@query("captain_vice", f"with {_CAP} select squad_id, max(case when crank = 1 then player_id end) as captain_id, max(case when crank = 2 then player_id end) as vice_captain_id from cranked group by 1")
def captain_vice(spark, sf):
    return captained(spark, sf).select("squad_id", "captain_id", "vice_captain_id").distinct()


@query("captain_flags", f"""with {_CAP}
select squad_id, round(sum(case when starting = 1 then expected_points end), 6) as base_points,
  round(sum(case when starting = 1 then expected_points end) + max(case when crank = 1 then expected_points end), 6) as total_points, count(*) filter (where crank <= 2) as flags
from cranked group by 1""")
def captain_flags(spark, sf):
    starts = F.col("starting") == 1
    return captained(spark, sf).groupBy("squad_id").agg(
        r6(F.sum(F.when(starts, F.col("expected_points")))).alias("base_points"),
        r6(F.sum(F.when(starts, F.col("expected_points"))) + F.max("captain_points")).alias("total_points"),
        F.sum(F.col("captain") + F.col("vice_captain")).alias("flags"),
    )


@query("nested_squads", f"""with {LINEUP}
select squad_id, 11 as starters, 4 as benched, max(case when starting = 0 and bench_order = 1 then player_id end) as first_reserve,
  arg_min(player_id, (element_type, -expected_points, player_id)) filter (where starting = 1) as keeper, round(sum(now_cost_millions), 6) as total_cost
from lineup_ordered group by 1""")
def nested_squads(spark, sf):
    lineup = sq.best_lineup(squads(spark, sf), SQUAD)
    nested = sq.nested_squads(lineup, SQUAD, ["player_id", "element_type", "expected_points"])
    return nested.select(
        "squad_id", F.size("squad").alias("starters"), F.size("bench").alias("benched"),
        F.element_at("bench", 1)["player_id"].alias("first_reserve"), F.element_at("squad", 1)["player_id"].alias("keeper"),
        r6("total_cost").alias("total_cost"),
    )


@query("nested_flattened", f"""with {LINEUP}
select squad_id, player_id, case when starting = 1 then 'Starter' else 'Bench ' || bench_order end as role from lineup_ordered""")
def nested_flattened(spark, sf):
    lineup = sq.best_lineup(squads(spark, sf), SQUAD)
    nested = sq.nested_squads(lineup, SQUAD, ["player_id", "element_type", "expected_points"])
    return sq.flatten_squads(nested, SQUAD).select("squad_id", "player_id", "role")


# Outcomes: who played follows from the id and the scenario.
_OUT = _CAP + """,
rows as (select c.*, g.sc as scenario_id, (player_id * 7 + g.sc * 3) % 10 < 7 as played,
    cast((player_id * 13 + g.sc * 5) % 15 as double) as points,
    case squad_id % 4 when 0 then 'bench_boost' when 1 then 'triple_captain' end as chip, squad_id % 2 * 4.0 as hit
  from cranked c, generate_series(0, 3) g(sc)),
base as (select squad_id, scenario_id, chip, max(hit) as hit, 11 - count(*) filter (where starting = 1 and played) as missing,
    count(*) filter (where starting = 1 and played and element_type = 1) as n1, count(*) filter (where starting = 1 and played and element_type = 2) as n2,
    count(*) filter (where starting = 1 and played and element_type = 3) as n3, count(*) filter (where starting = 1 and played and element_type = 4) as n4,
    coalesce(sum(case when starting = 1 and played then points end), 0.0) as onp, coalesce(sum(case when played then points end), 0.0) as allp,
    min(case when starting = 0 and played and element_type = 1 then bench_order end) as gk_no,
    max(case when crank = 1 and played then points end) as capp, max(case when crank = 2 and played then points end) as vicep
  from rows group by 1, 2, 3),
gk as (select b.*, case when n1 = 0 and gk_no is not null then 1 else 0 end as gk_in,
    case when n1 = 0 and gk_no is not null then r.points else 0.0 end as gk_pts
  from base b left join rows r on r.squad_id = b.squad_id and r.scenario_id = b.scenario_id and r.starting = 0 and r.bench_order = b.gk_no),
subs as (select squad_id, scenario_id, element_type, points, row_number() over (partition by squad_id, scenario_id order by bench_order) - 1 as i
  from rows where starting = 0 and played and element_type <> 1),
masks(m, size, pri, a, b, c) as (values (7,3,1,1,1,1),(3,2,2,1,1,0),(5,2,3,1,0,1),(6,2,4,0,1,1),(1,1,5,1,0,0),(2,1,6,0,1,0),(4,1,7,0,0,1)),
cand as (select s.squad_id, s.scenario_id, m, any_value(pri) as pri, any_value(size) as size, count(*) as n, sum(points) as pts,
    count(*) filter (where element_type = 2) as s2, count(*) filter (where element_type = 3) as s3, count(*) filter (where element_type = 4) as s4
  from subs s join masks on (m >> i) & 1 = 1 group by 1, 2, 3),
pick as (select c.squad_id, c.scenario_id, c.size, c.pts, row_number() over (partition by c.squad_id, c.scenario_id order by pri) as rn
  from cand c join gk g using (squad_id, scenario_id)
  where n = c.size and c.size <= missing - gk_in and n1 + gk_in = 1 and n2 + s2 >= 3 and n3 + s3 >= 2 and n4 + s4 >= 1
    and n1 + gk_in + n2 + n3 + n4 + c.size <= 11)"""


def outcome_rows(spark, sf):
    rows = captained(spark, sf).withColumn("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    pid, sc = F.col("player_id"), F.col("scenario_id")
    return rows.withColumns(
        {
            "played": (pid * 7 + sc * 3) % 10 < 7,
            "points": ((pid * 13 + sc * 5) % 15).cast("double"),
            "chip": F.when(F.col("squad_id") % 4 == 0, "bench_boost").when(F.col("squad_id") % 4 == 1, "triple_captain"),
            "hit_cost": F.col("squad_id") % 2 * 4.0,
        }
    )


@query("lineup_outcome_score", f"""with {_OUT}
select g.squad_id, g.scenario_id, case when chip = 'bench_boost' then 0 else coalesce(size, 0) + gk_in end as substitutions,
  case when chip = 'bench_boost' then allp else onp + gk_pts + coalesce(pts, 0.0) end
    + coalesce(capp, vicep, 0.0) * case when chip = 'triple_captain' then 2 else 1 end - hit as total_points
from gk g left join pick p on p.squad_id = g.squad_id and p.scenario_id = g.scenario_id and rn = 1""")
def lineup_outcome_score(spark, sf):
    return sq.score_outcomes(outcome_rows(spark, sf), ["squad_id", "scenario_id"])


@query("tracker", f"""with {_CAP}, {ROUNDS}
select c.squad_id, r.g as gameweek, round(sum(case when starting = 1 then c.expected_points end) + max(case when crank = 1 then c.expected_points end), 6) as predicted,
  round(sum(case when starting = 1 then coalesce(p.expected_points, 0) end) + max(case when crank = 1 then coalesce(p.expected_points, 0) end), 6) as actual
from cranked c cross join generate_series(1, 3) r(g) left join part_rounds p on p.player_id = c.player_id and p.gameweek = r.g group by 1, 2""")
def tracker(spark, sf):
    from rosterlake.operators.squad import summarise

    lineup = captained(spark, sf).withColumn("gameweek", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    actual = part_rounds(spark, sf).select("player_id", "gameweek", F.col("expected_points").alias("_a"))
    both = lineup.join(actual, ["player_id", "gameweek"], "left")
    keys = [*SQUAD, "gameweek"]
    total = "total_expected_points_with_captain"
    predicted = summarise(lineup, keys).select(*keys, r6(total).alias("predicted"))
    real = summarise(both.withColumn("expected_points", F.coalesce("_a", F.lit(0.0))), keys).select(*keys, r6(total).alias("actual"))
    return predicted.join(real, keys)


# --- transfers, chips, ledgers -----------------------------------------------------------------------------

_PAIRS = SQUADS + """,
o as (select *, row_number() over (partition by squad_id, element_type order by expected_points, player_id) as rn from owned),
n as (select *, squad_id - 1 as buyer from owned),
i as (select *, row_number() over (partition by buyer, element_type order by expected_points desc, player_id) as rn from n),
pairs as (select o.squad_id, o.element_type, o.rn, o.player_id as out_id, i.player_id as in_id, i.expected_points - o.expected_points as delta,
    o.price_tenths - 1 as out_sale_tenths, i.price_tenths as in_price_tenths
  from o join i on o.squad_id = i.buyer and o.element_type = i.element_type and o.rn = i.rn where i.expected_points > o.expected_points)"""


def squad_pairs(spark, sf):
    """Every squad against the next one: weakest out, strongest in, per position."""
    owned = sq.complete_squads(squads(spark, sf), SQUAD)
    keys = [*SQUAD, "element_type"]
    outs = numbered(owned, keys, ["expected_points", "player_id"], "rn", hot=False)
    ins = numbered(
        owned.withColumn("squad_id", F.col("squad_id") - 1), keys, ["-expected_points", "player_id"], "rn", hot=False
    )
    return outs.select(
        *keys, "rn", F.col("player_id").alias("out_id"), F.col("expected_points").alias("_o"), (F.col("price_tenths") - 1).alias("out_sale_tenths")
    ).join(
        ins.select(*keys, "rn", F.col("player_id").alias("in_id"), F.col("expected_points").alias("_i"), F.col("price_tenths").alias("in_price_tenths")),
        [*keys, "rn"],
    ).filter("_i > _o").withColumn("delta", F.col("_i") - F.col("_o"))


@query("rank_pairing_squads", f"""with {SQUADS},
o as (select squad_id, element_type, player_id, expected_points as e, row_number() over (partition by squad_id, element_type order by expected_points, player_id) as rn from owned where confidence_score < 60),
i as (select squad_id - 1 as squad_id, element_type, player_id, expected_points as e, row_number() over (partition by squad_id, element_type order by expected_points desc, player_id) as rn from owned where confidence_score >= 60),
f as (select 1 as pass, o.squad_id, o.element_type as slot, o.rn as no, o.player_id as out_id, i.player_id as in_id, i.e - o.e as delta from o join i using (squad_id, element_type, rn)),
ro as (select *, row_number() over (partition by squad_id order by e, player_id) as no from o where not exists (select 1 from f where f.squad_id = o.squad_id and f.out_id = o.player_id)),
ri as (select *, row_number() over (partition by squad_id order by e desc, player_id) as no from i where not exists (select 1 from f where f.squad_id = i.squad_id and f.in_id = i.player_id)),
a as (select * from f union all select 2, ro.squad_id, 0, ro.no, ro.player_id, ri.player_id, ri.e - ro.e from ro join ri using (squad_id, no))
select squad_id, row_number() over (partition by squad_id order by pass, slot, no) as pair_no, pass, out_id, in_id, round(delta, 6) as delta from a qualify pair_no <= 5""")
def rank_pairing_squads(spark, sf):
    """Every squad's uncertain players against the certain ones of the next squad: both passes, five pairs at most."""
    owned = sq.complete_squads(squads(spark, sf), SQUAD)
    outs, ins = owned.filter("confidence_score < 60"), owned.filter("confidence_score >= 60").withColumn("squad_id", F.col("squad_id") - 1)
    out = pair_by_rank(outs, ins, "element_type", "player_id", "expected_points", limit=5, squad=SQUAD)
    return rounded(out, "delta").select("squad_id", "pair_no", "pass", "out_id", "in_id", "delta")


@query("transfer_report", f"""with {_PAIRS},
s as (select squad_id, count(*) as transfers, sum(delta) as gross, cast(sum(out_sale_tenths) as bigint) as sale_tenths, cast(sum(in_price_tenths) as bigint) as price_tenths from pairs group by 1)
select squad_id, transfers, sale_tenths, price_tenths, round(gross, 6) as gross_gain, least(transfers, 2) as free_used, greatest(0, transfers - 2) as paid_transfers,
  greatest(0, transfers - 2) * 4.0 as hit_cost, round(gross - greatest(0, transfers - 2) * 4.0, 6) as net_gain,
  cast(round(gross - greatest(0, transfers - 2) * 4.0, 6) >= 1.5 as integer) as worth_it from s""")
def transfer_report(spark, sf):
    out = rounded(sq.transfer_report(squad_pairs(spark, sf), SQUAD, free_transfers=2), "gross_gain", "net_gain")
    return out.withColumn("worth_it", flag(F.col("net_gain") >= 1.5))


_WEEK = LINEUP + "," + ROUNDS + """,
weekly as (select l.squad_id, g.w * 8 - 7 as gameweek,
    round(coalesce(sum(case when starting = 0 then r.expected_points end), 0.0), 6) as bench_points,
    round(coalesce(max(case when starting = 1 then r.expected_points end), 0.0), 6) as captain_points
  from lineup l cross join generate_series(1, 5) g(w) left join part_rounds r on r.player_id = l.player_id and r.gameweek = g.w group by 1, 2),
fut as (select *, coalesce(max(bench_points) over w, 0.0) as future_bench, coalesce(max(captain_points) over w, 0.0) as future_captain from weekly
  window w as (partition by squad_id, case when gameweek <= 19 then 1 else 2 end order by gameweek rows between 1 following and unbounded following))"""


def weekly_points(spark, sf):
    lineup = sq.best_lineup(squads(spark, sf), SQUAD)
    weeks = F.sequence(F.lit(1), F.lit(5))
    rounds = part_rounds(spark, sf).select("player_id", F.col("gameweek").alias("w"), F.col("expected_points").alias("_p"))
    rows = lineup.withColumn("w", F.explode(weeks)).join(rounds, ["player_id", "w"], "left")
    return rows.groupBy("squad_id", (F.col("w") * 8 - 7).alias("gameweek")).agg(
        r6(F.coalesce(F.sum(F.when(F.col("starting") == 0, F.col("_p"))), F.lit(0.0))).alias("bench_points"),
        r6(F.coalesce(F.max(F.when(F.col("starting") == 1, F.col("_p"))), F.lit(0.0))).alias("captain_points"),
    )


@query("chip_gains", f"""with {_WEEK}
select squad_id, gameweek, bench_points, captain_points, future_bench, future_captain,
  cast(bench_points >= 8 and bench_points >= 0.95 * future_bench as integer) as bench_boost_ok,
  cast(captain_points >= 5 and captain_points >= 0.95 * future_captain as integer) as triple_captain_ok from fut""")
def chip_gains(spark, sf):
    out = sq.chip_gains(weekly_points(spark, sf), SQUAD)
    return out.select(
        "squad_id", "gameweek", "bench_points", "captain_points", "future_bench", "future_captain",
        flag(F.col("bench_boost_ok")).alias("bench_boost_ok"), flag(F.col("triple_captain_ok")).alias("triple_captain_ok"),
    )


_DEC = """
dec as (select o_custkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) as gameweek, count(*) % 4 as transfers,
    max(case o_orderkey % 40 when 0 then 'wildcard' when 1 then 'free_hit' when 2 then 'bench_boost' when 3 then 'triple_captain' end) as chip,
    cast(sum(o_orderkey % 50) as bigint) as sale_tenths, cast(sum(o_orderkey % 47) as bigint) as price_tenths
  from orders group by 1, 2),
seq as (select *, row_number() over (partition by o_custkey order by gameweek) as no from dec)"""


def decisions(spark, sf):
    o = orders_panel(spark, sf).withColumn("chip", chip_column())
    return o.groupBy("o_custkey", ((F.col("season") - 1995) * 12 + F.month("o_orderdate")).alias("gameweek")).agg(
        (F.count(F.lit(1)) % 4).alias("transfers"), F.max("chip").alias("chip"),
        F.sum(F.col("o_orderkey") % 50).alias("sale_tenths"), F.sum(F.col("o_orderkey") % 47).alias("price_tenths"),
    )


@query("free_hit_allowed", f"""with {_DEC}
select o_custkey, gameweek, cast(gameweek <> 1 and not coalesce(lag(chip) over (partition by o_custkey order by gameweek) = 'free_hit', false) as integer) as free_hit_ok from dec""")
def free_hit_allowed(spark, sf):
    return sq.free_hit_allowed(decisions(spark, sf), ["o_custkey"]).select("o_custkey", "gameweek", flag(F.col("free_hit_ok")).alias("free_hit_ok"))


@query("ledger_fold", f"""with recursive {_DEC},
fold as (
  select o_custkey, no, gameweek, cast(1 as bigint) as ft_before, chip, transfers from seq where no = 1
  union all
  select s.o_custkey, s.no, s.gameweek, least(5, greatest(
      case when f.chip in ('wildcard', 'free_hit') then f.ft_before else least(5, greatest(0, f.ft_before - f.transfers) + 1) end,
      case when f.gameweek + 1 in (16, 40, 64) then 4 else 0 end)), s.chip, s.transfers
  from fold f join seq s on s.o_custkey = f.o_custkey and s.no = f.no + 1)
select o_custkey, gameweek, ft_before as free_transfers_before, least(5, greatest(
    case when chip in ('wildcard', 'free_hit') then ft_before else least(5, greatest(0, ft_before - transfers) + 1) end,
    case when gameweek + 1 in (16, 40, 64) then 4 else 0 end)) as free_transfers_after from fold""")
def ledger_fold(spark, sf):
    out = ledger.free_transfers(decisions(spark, sf), ["o_custkey"], topups={16: 4, 40: 4, 64: 4})
    return out.select("o_custkey", "gameweek", "free_transfers_before", "free_transfers_after")


@query("ledger_bank", f"""with {_DEC}
select o_custkey, gameweek, cast(30 + sum(sale_tenths - price_tenths) over (partition by o_custkey order by gameweek) as bigint) as bank_tenths from dec""")
def ledger_bank(spark, sf):
    return ledger.bank_after(decisions(spark, sf), ["o_custkey"], ["gameweek"], 30).select("o_custkey", "gameweek", "bank_tenths")


@query("chips_used", f"""with {_DEC}
select o_custkey, case when gameweek <= 19 then 'first' else 'second' end as half, chip, count(*) as used, cast(count(*) > 1 as integer) as overused
from dec where chip is not null group by 1, 2, 3""")
def chips_used(spark, sf):
    return ledger.chips_used(decisions(spark, sf), ["o_custkey"]).withColumn("overused", flag(F.col("overused")))


@query("purchase_prices", """
with e as (select user_id, ts, event_id, event_id % 60 as player_id, cast(floor(value) as bigint) as price, case when event_id % 3 = 0 then 0 else 1 end as bought from events)
select user_id, player_id, price as purchase_tenths from (select *, row_number() over (partition by user_id, player_id order by event_id desc) as rn from e) where rn = 1 and bought = 1""")
def purchase_prices(spark, sf):
    e = table(spark, sf, "events").withColumns(
        {"player": F.col("event_id") % 60, "bought": F.col("event_id") % 3 != 0, "price": F.floor("value").cast("long")}
    )
    swaps = e.select(
        "user_id", "event_id", F.when(F.col("bought"), F.col("player")).alias("in_id"), F.when(~F.col("bought"), F.col("player")).alias("out_id"),
        F.col("price").alias("in_price_tenths"),
    )
    return ledger.purchase_prices(swaps, ["user_id"], ["event_id"]).filter("player_id is not null")


@query("swap_order", f"""with recursive {_PAIRS},
np as (select squad_id, row_number() over (partition by squad_id order by element_type, rn) as pair_no, in_id, out_sale_tenths - in_price_tenths as net from pairs),
st as (
  select squad_id, 0 as step, cast(5 as bigint) as bank, cast([] as bigint[]) as done, cast(null as bigint) as pick from (select distinct squad_id from np)
  union all
  select squad_id, step + 1, bank + net, list_append(done, pair_no), pair_no from (
    select s.squad_id, s.step, s.bank, s.done, n.net, n.pair_no, row_number() over (partition by s.squad_id order by n.pair_no) as rk
    from st s join np n on n.squad_id = s.squad_id and not list_contains(s.done, n.pair_no) and s.bank + n.net >= 0) where rk = 1)
select np.squad_id, np.pair_no, np.in_id, st.step from np left join st on st.squad_id = np.squad_id and st.pick = np.pair_no""")
def swap_order(spark, sf):
    pairs = numbered(squad_pairs(spark, sf), SQUAD, ["element_type", "rn"], "pair_no", hot=False).withColumnsRenamed(
        {"out_sale_tenths": "sale_tenths", "in_price_tenths": "price_tenths"}
    )
    banks = pairs.select("squad_id").distinct().withColumn("bank_tenths", F.lit(5))
    return ledger.swap_order(pairs, banks, SQUAD).select("squad_id", "pair_no", "in_id", "step")


@query("rebased_log", f"""with {_CAP}, {ROUNDS},
log as (select c.squad_id, r.g as gameweek, c.starting, c.crank, coalesce(p.expected_points, c.expected_points) as ep,
    case squad_id % 4 when 0 then 'bench_boost' when 1 then 'triple_captain' end as chip, squad_id % 2 * 4.0 as hit
  from cranked c cross join generate_series(1, 3) r(g) left join part_rounds p on p.player_id = c.player_id and p.gameweek = r.g)
select squad_id, gameweek, round(sum(case when starting = 1 then ep end) + max(case when crank = 1 then ep end)
   + case when max(chip) = 'bench_boost' then sum(case when starting = 0 then ep end) else 0 end
   + case when max(chip) = 'triple_captain' then max(case when crank = 1 then ep end) else 0 end - max(hit), 6) as expected_points from log group by 1, 2""")
def rebased_log(spark, sf):
    log = captained(spark, sf).withColumns(
        {
            "gameweek": F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))),
            "chip": F.when(F.col("squad_id") % 4 == 0, "bench_boost").when(F.col("squad_id") % 4 == 1, "triple_captain"),
            "hit_cost": F.col("squad_id") % 2 * 4.0,
        }
    )
    out = sq.rebased_totals(log, part_rounds(spark, sf), [*SQUAD, "gameweek"])
    return rounded(out, "expected_points").select("squad_id", "gameweek", "expected_points")


# --- budgeted selection: one problem per price band of the catalogue -------------------------------------------

PRICES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8]
_PROBLEM = PARTS + """,
cand as (select *, player_id % 4 as problem_id from part_scores),
lam(price_level) as (select unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8]::double[])),
priced as (select *, expected_points - price_level * now_cost_millions as sc from cand, lam),
repl as (select problem_id, price_level, element_type, min(sc) as last_place from (select *, row_number() over (partition by problem_id, price_level, element_type order by sc desc, player_id) as k from priced)
  where k <= case element_type when 1 then 2 when 2 then 5 when 3 then 5 else 3 end group by 1, 2, 3),
clubbed as (select p.* from priced p join repl r on r.problem_id = p.problem_id and r.price_level = p.price_level and r.element_type = p.element_type
  qualify row_number() over (partition by p.problem_id, p.price_level, p.team_id order by p.sc - r.last_place desc, player_id) <= 3),
slotted as (select * from clubbed qualify row_number() over (partition by problem_id, price_level, element_type order by sc desc, player_id)
   <= case element_type when 1 then 2 when 2 then 5 when 3 then 5 else 3 end),
ok as (select problem_id, price_level from slotted group by 1, 2 having count(*) = 15 and sum(now_cost_millions) <= 100 + problem_id * 5 + 1e-6),
chosen as (select s.* from slotted s join ok using (problem_id, price_level))"""


def problems(spark, sf):
    cand = part_scores(spark, sf).withColumn("problem_id", F.col("player_id") % 4)
    budgets = cand.select("problem_id").distinct().withColumn("budget", F.lit(100.0) + F.col("problem_id") * 5)
    return cand, budgets


@query("price_sweep_rows", f"with {_PROBLEM} select problem_id, price_level, player_id from chosen")
def price_sweep_rows(spark, sf):
    return sq.price_sweep(*problems(spark, sf), PRICES).select("problem_id", "price_level", "player_id")


@query("price_sweep_selection", f"""with {_PROBLEM},{FORMATION_ROWS},
pr as (select *, row_number() over (partition by problem_id, price_level, element_type order by expected_points desc, player_id) as pos_rank from chosen),
fp as (select problem_id, price_level, formation_no, sum(expected_points) as xi, max(expected_points) as cap from pr join formations
   on pos_rank <= case element_type when 1 then gk when 2 then df when 3 then md else fw end group by 1, 2, 3 having count(*) = 11),
bf as (select * from fp qualify row_number() over (partition by problem_id, price_level order by xi desc, formation_no) = 1),
tot as (select problem_id, price_level, sum(expected_points) as sp, sum(now_cost_millions) as cost from chosen group by 1, 2),
obj as (select *, xi + cap + 0.25 * (sp - xi) as objective from bf join tot using (problem_id, price_level)),
best as (select * from obj qualify row_number() over (partition by problem_id order by round(objective, 9) desc, price_level) = 1),
bslot as (select * from priced qualify row_number() over (partition by problem_id, price_level, element_type order by sc desc, player_id)
   <= case element_type when 1 then 2 when 2 then 5 when 3 then 5 else 3 end),
bnd as (select problem_id, min(b) as bound from (select problem_id, price_level, sum(sc) + price_level * (100 + problem_id * 5) as b from bslot group by 1, 2) group by 1)
select problem_id, price_level, round(sp, 6) as squad_points, round(cost, 6) as squad_cost, round(objective, 6) as objective, formation_no,
  round(bound, 6) as bound_points, round(bound - sp, 6) as gap, case when sp is null then 'none found' else 'selected' end as status
from (select distinct problem_id from cand) left join best using (problem_id) left join bnd using (problem_id)""")
def price_sweep_selection(spark, sf):
    out = sq.select_squad(*problems(spark, sf), PRICES)
    return rounded(out, "squad_points", "squad_cost", "objective", "bound_points", "gap")


# --- transition form: each complete squad against all parts ----------------------------------------------------------

SWAPS = 2
SQUADS_A_TASK = 500
_SCORED = ["player_id", "team_id", "element_type", "now_cost_millions", "expected_points"]


def newcomers(spark, sf, owned=None, scores=None):
    """The parts that a squad can come to swap for at some price of money, whatever it owns: one pool for all squads, or with
    ``owned`` the same for each of them, in as many tasks as the squads need."""
    scores = part_scores(spark, sf) if scores is None else scores
    best = stored(useful(scores, [], PRICES, SWAPS).select(*_SCORED).distinct(), "best-parts")
    if owned is None:
        return best
    tasks = math.ceil(table(spark, sf, "part").count() / (SQUAD_SIZE * SQUADS_A_TASK))  # a count from the file footers
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
    wanted = owned.select("problem_id", "element_type").repartition(tasks, "problem_id").distinct()
    return wanted.join(best, "element_type")


@query("swap_sweep", f"""with {SQUADS},
own as (select squad_id as problem_id, *, now_cost_millions - 0.1 as sale_value from owned),
lam(price_level) as (select unnest({PRICES}::double[])),
club as (select problem_id, team_id, count(*) as n from own group by 1, 2),
pairs as (
  select o.problem_id, price_level, o.player_id as out_id, o.team_id as out_club, i.player_id as in_id, i.team_id as in_club,
         coalesce(c.n, 0) as n, o.sale_value, i.now_cost_millions as in_price, i.expected_points - o.expected_points as delta,
         (i.expected_points - price_level * i.now_cost_millions) - (o.expected_points - price_level * o.sale_value) as v
  from own o join part_scores i using (element_type) cross join lam left join club c on c.problem_id = o.problem_id and c.team_id = i.team_id
  where v > 0 and not exists (select 1 from own x where x.problem_id = o.problem_id and x.player_id = i.player_id)
),
first as (select * from pairs where n - (out_club = in_club)::int < 3 qualify row_number() over (partition by problem_id, price_level order by v desc, out_id, in_id) = 1),
second as (
  select p.* from pairs p join first f on f.problem_id = p.problem_id and f.price_level = p.price_level
  where p.out_id <> f.out_id and p.in_id <> f.in_id
    and p.n + (f.in_club = p.in_club)::int - (f.out_club = p.in_club)::int - (p.out_club = p.in_club)::int < 3
  qualify row_number() over (partition by p.problem_id, p.price_level order by p.v desc, p.out_id, p.in_id) = 1
),
taken as (select *, 1 as swap_no from first union all select *, 2 from second),
run as (select *, sum(in_price - sale_value) over w as spent, sum(delta) over w as gain from taken window w as (partition by problem_id, price_level order by swap_no)),
pick as (
  select problem_id, price_level, swap_no as swaps, gain - 4 * greatest(0, swap_no - 1) as net from run where spent <= 1.5 + 1e-6 and net > 0
  qualify row_number() over (partition by problem_id order by round(net, 9) desc, swap_no, price_level) = 1
),
done as (select problem_id, price_level, swap_no, out_id, in_id, delta, net from pick join taken using (problem_id, price_level) where swap_no <= swaps)
select problem_id, price_level, swap_no, out_id, in_id, round(delta, 6) as delta, round(net, 6) as net_gain, case when swap_no is null then 'none found' else 'selected' end as status
from (select distinct problem_id from own) left join done using (problem_id)""")
def swap_sweep(spark, sf):
    """Each complete squad may make two swaps, with any part."""
    scores = stored(part_scores(spark, sf).select(*_SCORED), "part-scores")  # one pass over the lines, for squads and newcomers
    owned = sq.complete_squads(squads(spark, sf, scores), SQUAD).withColumns(
        {"problem_id": F.col("squad_id"), "sale_value": F.col("now_cost_millions") - 0.1}
    )
    banks = owned.select("problem_id").distinct().withColumn("bank", F.lit(1.5))
    out = sq.sweep_swaps(owned, newcomers(spark, sf, scores=scores), banks, PRICES, SWAPS, 1)
    return rounded(out.drop("sale_value", "in_price"), "delta", "net_gain")


# --- the same by dynamic programme, on pools small enough for every squad to be listed in SQL ------------------------

_LISTED = f"""
quota(element_type, q) as (values (1, 2), (2, 5), (3, 5), (4, 3)),
chosen as (
  select problem_id, element_type, m, sum(new) as new, sum(price_tenths) as cost, list(expected_points order by expected_points desc) as eps, list(club) as clubs
  from numbered join quota using (element_type) join range(1, 1024) masks(m) on bit_count(m) = q and (m >> (no - 1)) & 1 = 1
  group by problem_id, element_type, m, q having count(*) = q and sum(new) <= 2
),
ends as (select g.problem_id, g.new + f.new as new, g.cost + f.cost as cost, g.eps as g, f.eps as f, g.clubs || f.clubs as clubs
  from chosen g join chosen f on g.problem_id = f.problem_id and g.element_type = 1 and f.element_type = 4 and g.new + f.new <= 2),
middle as (select d.problem_id, d.new + m.new as new, d.cost + m.cost as cost, d.eps as d, m.eps as m, d.clubs || m.clubs as clubs
  from chosen d join chosen m on d.problem_id = m.problem_id and d.element_type = 2 and m.element_type = 3 and d.new + m.new <= 2),
every as (
  select problem_id, e.new + x.new as new, g, d, m, f from ends e join middle x using (problem_id) join asked using (problem_id)
  where e.new + x.new <= 2 and e.cost + x.cost <= budget_tenths
    and len(list_filter(range(7), lambda c: len(list_filter(e.clubs || x.clubs, lambda y: y = c)) > 3)) = 0
),
{FORMATION_ROWS.strip()},
scored as (
  select problem_id, list_sum(g[1:gk]) + list_sum(d[1:df]) + list_sum(m[1:md]) + list_sum(f[1:fw]) as xi, greatest(g[1], d[1], m[1], f[1]) as cap,
         list_sum(g) + list_sum(d) + list_sum(m) + list_sum(f) as total, new from every, formations
),
top as (select problem_id, max(xi + cap + 0.25 * (total - xi) - 4 * greatest(0, new - free)) as objective from scored join asked using (problem_id) group by 1)
select problem_id, case when objective is null then 'none' else 'best' end as status, round(objective, 6) as objective from asked left join top using (problem_id)"""


def clubbed(df):
    """Seven clubs, so that their limit binds in small pools."""
    return df.withColumn("team_id", F.col("team_id") % 7)


@query("squad_programme", f"""with {PARTS},
dealt as (select *, (row_number() over (partition by element_type order by player_id) - 1) // case element_type when 1 then 3 when 4 then 4 else 6 end as problem_id from part_scores),
numbered as (select *, team_id % 7 as club, 0 as new, row_number() over (partition by problem_id, element_type order by player_id) as no from dealt),
asked as (select problem_id, 1200 + problem_id % 9 * 20 as budget_tenths, 0 as free from (select distinct problem_id from dealt)),{_LISTED}""")
def squad_programme(spark, sf):
    """The best squad out of every pool of 3/6/6/4 parts, or that there is none."""
    size = F.element_at(F.array(F.lit(3), F.lit(6), F.lit(6), F.lit(4)), F.col("element_type").cast("int"))
    dealt = numbered(part_scores(spark, sf), ["element_type"], ["player_id"], "_no").withColumn("problem_id", F.floor((F.col("_no") - 1) / size))
    budgets = dealt.select("problem_id").distinct().withColumn("budget", F.lit(120.0) + F.col("problem_id") % 9 * 2)
    return rounded(best_squads(clubbed(dealt), budgets).select("problem_id", "status", "objective"), "objective")


@query("transfer_programme", f"""with {SQUADS},
numbered as (
  select *, row_number() over (partition by problem_id, element_type order by new, player_id) as no from (
    select squad_id as problem_id, player_id, element_type, expected_points, price_tenths - 1 as price_tenths, team_id % 7 as club, 0 as new from owned union all
    select o.squad_id - 1, player_id, element_type, expected_points, price_tenths, team_id % 7, 1 from owned o where squad_id - 1 in (select squad_id from whole))
),
asked as (select problem_id, sum(price_tenths) + 15 as budget_tenths, 1 as free from numbered where new = 0 group by 1),{_LISTED}""")
def transfer_programme(spark, sf):
    """The best that every squad can become with two transfers, one of them free, from the players of the next one."""
    owned = clubbed(sq.complete_squads(squads(spark, sf), SQUAD)).withColumns({"problem_id": F.col("squad_id"), "sale_value": F.col("now_cost_millions") - 0.1})
    budgets = owned.select("problem_id").distinct().withColumn("budget", F.lit(1.5))
    pool = owned.withColumn("problem_id", F.col("squad_id") - 1)
    out = best_squads(pool, budgets, owned=owned, max_transfers=2, free_transfers=1)
    return rounded(out.select("problem_id", "status", "objective"), "objective")


# --- one record per squad ----------------------------------------------------------------------------------------

def advised_squads(spark, sf):
    """Line-ups with captains, and what the record says about each player."""
    pid, score = F.col("player_id"), F.col("confidence_score")
    return captained(spark, sf).withColumns({
        "confidence_level": F.when(score <= 49.9, "Low").when(score <= 74.9, "Medium").otherwise("High"),
        "expected_points_lower_80": F.greatest(F.lit(0.0), F.col("expected_points") - 1.0), "expected_points_upper_80": F.col("expected_points") + 1.0,
        "status": F.when(pid % 9 == 0, "i").otherwise("a"), "chance_of_playing_next_round": F.when(pid % 11 == 0, F.lit(75.0)),
    })


def squad_context_frame(spark, sf, optimum=None):
    """The nested record of each squad (L12): rounds 1 to 3 of the horizon are there, round 40 is not."""
    return analysis_context(
        advised_squads(spark, sf), part_rounds(spark, sf), part_scores(spark, sf), [1, 2, 3, 40], squad_pairs(spark, sf), optimum
    )


@query("squad_context", f"""with {_CAP},
o3 as (select squad_id, player_id, row_number() over (partition by squad_id order by expected_points desc, player_id) as no from lineup)
select c.squad_id, count(*) as players, max(case when crank = 1 then player_id end) as captain_id, max(formation_no) as formation_no,
  (select string_agg(cast(player_id as varchar), ',' order by no) from o3 where o3.squad_id = c.squad_id and no <= 3) as captaincy_options,
  count(*) filter (where player_id % 9 = 0 or player_id % 11 = 0 or confidence_score <= 49.9) as risks
from cranked c group by 1""")
def squad_context(spark, sf):
    c = squad_context_frame(spark, sf)
    # through JSON and back, as a reader of the record would see it
    text = c.select("squad_id", F.to_json("context").alias("j"))
    schema = c.schema["context"].dataType
    r = text.select("squad_id", F.from_json("j", schema).alias("c"))
    return r.select(
        "squad_id", F.size("c.user_squad.players").alias("players"), F.col("c.user_squad.current_captain").alias("captain_id"), "c.lineup_advice.formation_no",
        F.array_join(F.transform("c.captaincy_options", lambda x: x["player_id"].cast("string")), ",").alias("captaincy_options"),
        F.coalesce(F.size("c.risk_flags"), F.lit(0)).alias("risks"),
    )


@query("analysis_record", f"""with {_CAP}, {ROUNDS},
lead as (select player_id, sum(expected_points) as h from part_rounds where gameweek in (1, 2, 3) group by 1 order by h desc, player_id limit 10),
scope as (select string_agg(cast(g as varchar), ',' order by g) as horizon, min(g) as first from (select distinct gameweek as g from part_rounds where gameweek in (1, 2, 3, 40))),
o as (select squad_id, element_type, player_id, expected_points as e, price_tenths - 1 as sale, row_number() over (partition by squad_id, element_type order by expected_points, player_id) as rn from owned),
i as (select squad_id - 1 as squad_id, element_type, player_id, expected_points as e, price_tenths as price, row_number() over (partition by squad_id, element_type order by expected_points desc, player_id) as rn from owned),
plan as (select o.squad_id, count(*) as transfers, sum(i.e - o.e) as gross from o join i using (squad_id, element_type, rn) where i.e > o.e group by 1)
select c.squad_id, round(sum(now_cost_millions), 2) as total_cost_m, round(max(xi_points), 2) as xi_points, round(sum(case when starting = 0 then expected_points end), 2) as bench_expected_points,
  round(sum(case when starting = 1 then expected_points end) + max(case when crank = 1 then expected_points end), 2) as projected_points_with_captain,
  string_agg(case when starting = 0 then cast(player_id as varchar) end, ',' order by bench_order) as bench,
  (select horizon from scope) as horizon, (select first from scope) as current_gameweek, '40' as missing,
  (select string_agg(cast(player_id as varchar), ',' order by h desc, player_id) from lead) as targets,
  max(p.transfers) as transfers, round(max(p.gross) - 4 * greatest(0, max(p.transfers) - 1), 2) as net_gain
from cranked c left join plan p on p.squad_id = c.squad_id group by 1""")
def analysis_record(spark, sf):
    """What the record says beside its snapshots: scope, points, bench, plan and targets."""
    c = squad_context_frame(spark, sf)
    joined = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    user, scope = "context.user_squad", "context.analysis_scope"
    return c.select(
        "squad_id", F.col(f"{user}.total_cost_m"), F.col("context.lineup_advice.xi_points"), F.col(f"{user}.bench_expected_points"), F.col(f"{user}.projected_points_with_captain"),
        joined(F.col("context.lineup_advice.bench")).alias("bench"), joined(F.col(f"{scope}.horizon_gameweeks")).alias("horizon"), F.col(f"{scope}.current_gameweek"),
        joined(F.col(f"{scope}.missing_prediction_gameweeks")).alias("missing"), joined(F.transform("context.horizon_top_targets", lambda t: t["player_id"])).alias("targets"),
        F.col("context.transfer_plan.transfers"), F.col("context.transfer_plan.net_gain"),
    )


@query("optimal_comparison")
def optimal_comparison(spark, sf):
    """How far each squad is from the best one for its money out of its own players and those of the next squad."""
    owned = sq.complete_squads(squads(spark, sf), SQUAD).withColumn("problem_id", F.col("squad_id"))
    budgets = owned.groupBy("problem_id").agg(F.sum(F.col("price_tenths")).alias("_t")).select("problem_id", (F.col("_t") / 10.0).alias("budget"))
    pool = owned.unionByName(owned.withColumn("problem_id", F.col("squad_id") - 1))
    best = best_squads(pool, budgets).withColumnRenamed("problem_id", "squad_id")
    return squad_context_frame(spark, sf, best).select("squad_id", "context.optimal_comparison.*")
