"""Forecasts under the conditions of past rounds, on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.catalog.base import PARTS, ROUNDS, part_rounds, part_scores, query, rounded
from rosterlake.operators import scenario
from rosterlake.operators.aggregates import distribution

_ROWS = PARTS + "," + ROUNDS + """,
sc as (
  select p.player_id, g.gameweek as scenario_id, p.expected_points as ep, r.expected_points as pts, r.lines
  from part_scores p cross join (select distinct gameweek from part_rounds) g left join part_rounds r on r.player_id = p.player_id and r.gameweek = g.gameweek
),
m as (select player_id, avg(expected_points) as mean_points from part_rounds group by 1)"""


def past(spark, sf):
    history = part_rounds(spark, sf).withColumnRenamed("expected_points", "round_points")
    forecasts = part_scores(spark, sf).select("player_id", "expected_points")
    return scenario.scenarios(forecasts, history, ["player_id"], "gameweek", ["round_points", "lines"]), history


@query("scenario_draws", f"""with {_ROWS}
select player_id, scenario_id, round(greatest(0.0, ep + coalesce(pts - mean_points, 0.0)), 6) as scenario_points from sc left join m using (player_id)""")
def scenario_draws(spark, sf):
    """Every part's score under every past year: its own deviation of that year from its mean."""
    rows, history = past(spark, sf)
    means = history.groupBy("player_id").agg(F.avg("round_points").alias("mean_points"))
    return rounded(scenario.moved_scores(rows, "round_points", means, ["player_id"], "mean_points"), "scenario_points").select("player_id", "scenario_id", "scenario_points")


_OUT = _ROWS + """,
d as (select player_id, scenario_id, case when pts is null then 'absent' when lines >= 4 then 'starts' else 'cameo' end as outcome, coalesce(pts, 0.0) as points from sc)"""


def lived(spark, sf):
    rows, _ = past(spark, sf)
    return scenario.outcomes(rows, "round_points", F.col("lines") >= 4)


@query("scenario_outcomes", f"with {_OUT} select player_id, scenario_id, outcome, round(points, 6) as points from d")
def scenario_outcomes(spark, sf):
    return rounded(lived(spark, sf), "points").select("player_id", "scenario_id", "outcome", "points")


@query("scenario_summary", f"""with {_OUT},
t as (select player_id % 4 as block, scenario_id, sum(cast(round(points, 6) as decimal(18, 6)))::double as total from d group by 1, 2),
g as (select block, avg(total) as mean_value, min(total) as min_value, max(total) as max_value, count(*) as n, quantile_cont(total, 0.5) as median,
  quantile_cont(total, 0.1) as p10, quantile_cont(total, 0.9) as p90 from t group by 1)
select block, round(mean_value, 4) as mean_value, round(min_value, 4) as min_value, round(max_value, 4) as max_value, n, round(median, 4) as median, round(p10, 4) as p10, round(p90, 4) as p90,
  cast(block = (select block from g order by round(mean_value, 4) desc, block limit 1) as integer) as is_best from g""")
def scenario_summary(spark, sf):
    """Quarters of the roster by what they made in every past year."""
    points = F.round("points", 6).cast("decimal(18,6)")
    totals = lived(spark, sf).groupBy((F.col("player_id") % 4).alias("block"), "scenario_id").agg(F.sum(points).cast("double").alias("total"))
    out = distribution(totals, "block", "total")
    cols = ["mean_value", "min_value", "max_value", "median", "p10", "p90"]
    return out.withColumns({c: F.round(c, 4) for c in cols}).withColumn("is_best", F.col("is_best").cast("int"))
