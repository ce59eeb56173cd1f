"""Registry of queries on the driver's tables, and the panels they share.

Every query reads whole tables. The SQL beside it states the same result for a second engine.
Sums of prices are taken as decimals and results are rounded at 6 places, so that the order
of summation does not show.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.constants import SQUAD_QUOTA
from rosterlake.operators.ordered import numbered
from rosterlake.session import prepare


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        REGISTRY[name] = Query(name, run, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- orders as a match panel: entity = customer, season = year -------------------------------

def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority",
        F.year("o_orderdate").alias("season"),
    )


ORDERS = "select *, year(o_orderdate) as season from orders"
ENTITY = ["o_custkey", "season"]
TIME = ["o_orderdate", "o_orderkey"]


# --- parts as players: position from size, club = brand, price from retail price ----------------

def _points(c: str) -> Column:
    """Mean price in ten thousands, cut at four decimals: the same double everywhere."""
    total = F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return F.floor(total / F.count(F.lit(1))) / 10000.0


def part_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("player_id")).agg(
        _points("l_extendedprice").alias("_ep"),
        (F.floor(F.count_if(F.col("l_returnflag") != "A") * 100 / F.count(F.lit(1))) / 100.0).alias("_start"),
        (F.sum("l_quantity").cast("long") % 60 + 40).cast("double").alias("_conf"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("player_id"),
        F.col("p_name").alias("full_name"),
        F.substring("p_brand", 7, 9).cast("int").alias("team_id"),
        F.col("p_brand").alias("team_name"),
        (F.col("p_size") % 4 + 1).alias("element_type"),
        (F.round(F.col("p_retailprice") * 10).cast("long") % 100 + 40).alias("price_tenths"),
    )
    return parts.join(lines, "player_id", "left").select(
        *parts.columns,
        (F.col("price_tenths") / 10.0).alias("now_cost_millions"),
        F.coalesce("_ep", F.lit(0.0)).alias("expected_points"),
        F.coalesce("_start", F.lit(0.0)).alias("start_probability"),
        F.coalesce("_conf", F.lit(40.0)).alias("confidence_score"),
    )


PARTS = """
part_scores as (
  select p_partkey as player_id, p_name as full_name, cast(substr(p_brand, 7) as integer) as team_id,
         p_brand as team_name, p_size % 4 + 1 as element_type,
         cast(round(p_retailprice * 10) as bigint) % 100 + 40 as price_tenths,
         (cast(round(p_retailprice * 10) as bigint) % 100 + 40) / 10.0::double as now_cost_millions,
         coalesce(ep, 0.0::double) as expected_points, coalesce(st, 0.0::double) as start_probability,
         coalesce(cf, 40.0::double) as confidence_score
  from part left join (
    select l_partkey,
           floor(cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*)) / 10000.0::double as ep,
           floor(cast(count(*) filter (where l_returnflag <> 'A') * 100 as double) / count(*)) / 100.0::double as st,
           cast(cast(sum(l_quantity) as bigint) % 60 + 40 as double) as cf
    from lineitem group by l_partkey) on p_partkey = l_partkey
)"""


def part_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score per (player, round); round = ship year counted from 1995."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("player_id"), (F.year("l_shipdate") - 1994).alias("gameweek")
    ).agg(
        _points("l_extendedprice").alias("expected_points"),
        (F.sum("l_quantity").cast("long") % 60 + 40).cast("double").alias("confidence_score"),
        F.count(F.lit(1)).alias("lines"),
    )


ROUNDS = """
part_rounds as (
  select l_partkey as player_id, year(l_shipdate) - 1994 as gameweek,
         floor(cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*)) / 10000.0::double as expected_points,
         cast(cast(sum(l_quantity) as bigint) % 60 + 40 as double) as confidence_score, count(*) as lines
  from lineitem group by 1, 2
)"""


def squads(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> DataFrame:
    """Parts dealt into squads of 2/5/5/3 in id order inside each position."""
    quota = F.element_at(F.array(*[F.lit(q) for q in SQUAD_QUOTA.values()]), F.col("element_type"))
    return numbered(part_scores(spark, sf_dir) if scores is None else scores, ["element_type"], ["player_id"], "_no").withColumn(
        "squad_id", F.floor((F.col("_no") - 1) / quota)
    ).drop("_no")


SQUADS = PARTS + """,
squads as (
  select * exclude (rn), (rn - 1) // case element_type when 1 then 2 when 2 then 5 when 3 then 5 else 3 end as squad_id
  from (select *, row_number() over (partition by element_type order by player_id) as rn from part_scores)
),
whole as (select squad_id from squads group by squad_id having count(*) = 15),
owned as (select * from squads where squad_id in (select squad_id from whole))"""

FORMATION_ROWS = """
formations(formation_no, gk, df, md, fw) as (values
  (1,1,3,4,3),(2,1,3,5,2),(3,1,4,4,2),(4,1,4,5,1),(5,1,4,3,3),(6,1,5,4,1),(7,1,5,3,2),(8,1,5,2,3))"""

LINEUP = SQUADS + "," + FORMATION_ROWS + """,
pos_ranked as (
  select *, row_number() over (partition by squad_id, element_type order by expected_points desc, player_id) as pos_rank from owned
),
f_points as (
  select squad_id, formation_no, sum(expected_points) as xi_points
  from pos_ranked join formations
    on pos_rank <= case element_type when 1 then gk when 2 then df when 3 then md else fw end
  group by squad_id, formation_no having count(*) = 11
),
best as (
  select * from (select *, row_number() over (partition by squad_id order by xi_points desc, formation_no) as rn from f_points)
  where rn = 1
),
lineup as (
  select o.*, b.formation_no, b.xi_points,
         case when pos_rank <= case element_type when 1 then gk when 2 then df when 3 then md else fw end then 1 else 0 end as starting
  from pos_ranked o join best b using (squad_id) join formations using (formation_no)
),
lineup_ordered as (
  select *, case when starting = 0 then row_number() over (
      partition by squad_id, starting order by case when element_type = 1 then 1 else 0 end, expected_points desc, player_id) end as bench_order
  from lineup
)"""
