"""Manager ledgers: free transfers, bank, chips, executable swap order (L4R, L6R)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import (
    FIRST_HALF_END,
    FREE_TRANSFERS_PER_ROUND,
    MAX_FREE_TRANSFERS,
    MAX_TRANSFERS_PER_ROUND,
)
from rosterlake.functions.numbers import lookup
from rosterlake.operators.ordered import group_sizes, numbered, running

_CHUNK = 256


def _step(x: Column, f: Column) -> Column:
    return F.least(f["hi"], F.greatest(f["lo"], x + f["d"]))


def bounded_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], start: int,
    shift: Column, low: Column, high: Column, before: str, after: str,
) -> DataFrame:
    """Value before and after each row of ``x -> min(high, max(low, x + shift))``, in order.

    Such steps compose to a step of the same form, so a long group is folded in chunks: chunk
    steps are composed first, scanned (by this same function), and handed to the rows.
    """
    steps = numbered(
        df.withColumns({"_d": shift.cast("long"), "_lo": low.cast("long"), "_hi": high.cast("long")}),
        keys, order, "_no",
    )
    _, largest = group_sizes(df, keys)
    return _scan(steps, list(keys), largest, start, before, after).drop("_d", "_lo", "_hi", "_no")


def _scan(steps: DataFrame, keys: list[str], largest: int, start: int, before: str, after: str) -> DataFrame:
    chunked = steps.withColumn("_chunk", F.floor((F.col("_no") - 1) / _CHUNK))
    carried = [c for c in steps.columns if c not in keys]
    packed = chunked.groupBy(*keys, "_chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_no"), *[F.col(c) for c in carried if c != "_no"]))).alias("_rows")
    )
    fns = F.transform("_rows", lambda r: F.struct(r["_d"].alias("d"), r["_lo"].alias("lo"), r["_hi"].alias("hi")))
    if largest <= _CHUNK:
        packed = packed.withColumn("_start", F.lit(start).cast("long"))
    else:
        first = F.get(fns, F.lit(0))
        whole = F.aggregate(
            F.slice(fns, 2, F.greatest(F.size(fns) - 1, F.lit(0))), first,
            lambda acc, f: F.struct(
                (acc["d"] + f["d"]).alias("d"), _step(acc["lo"], f).alias("lo"), _step(acc["hi"], f).alias("hi")
            ),
        )
        summary = packed.select(
            *keys, (F.col("_chunk") + 1).alias("_no"), whole.alias("_w")
        ).select(
            *keys, "_no", F.col("_w.d").alias("_d"), F.col("_w.lo").alias("_lo"), F.col("_w.hi").alias("_hi")
        )
        starts = _scan(summary, keys, -(-largest // _CHUNK), start, "_start", "_end").select(
            *keys, (F.col("_no") - 1).alias("_chunk"), "_start"
        )
        packed = packed.join(starts, [*keys, "_chunk"])
    states = F.aggregate(
        fns, F.array(F.col("_start")),
        lambda acc, f: F.concat(acc, F.array(_step(F.element_at(acc, -1), f))),
    )
    return (
        packed.select(*keys, "_rows", states.alias("_states"))
        .select(*keys, "_states", F.posexplode("_rows").alias("_at", "_r"))
        .select(
            *keys, "_r.*",
            F.get("_states", F.col("_at")).alias(before), F.get("_states", F.col("_at") + 1).alias(after),
        )
    )


def free_transfers(
    decisions: DataFrame, keys: Sequence[str] = ("manager_id",), gameweek: str = "gameweek",
    start: int = 1, topups: dict[int, int] | None = None,
) -> DataFrame:
    """Free transfers before and after each round: unused ones roll over up to the cap, a
    wildcard or free hit holds them, a top-up raises them for the next round."""
    held = F.coalesce(F.col("chip").isin("wildcard", "free_hit"), F.lit(False))
    topup = lookup(topups, F.col(gameweek) + 1, 0) if topups else F.lit(0)
    used = F.coalesce("transfers", F.lit(0))
    shift = F.when(held, F.lit(0)).otherwise(FREE_TRANSFERS_PER_ROUND - used)
    low = F.greatest(F.when(held, F.lit(0)).otherwise(FREE_TRANSFERS_PER_ROUND), topup)
    low = F.least(low, F.lit(MAX_FREE_TRANSFERS))
    return bounded_scan(
        decisions, keys, [gameweek], start, shift, low, F.lit(MAX_FREE_TRANSFERS),
        "free_transfers_before", "free_transfers_after",
    )


def bank_after(decisions: DataFrame, keys: Sequence[str], order: Sequence[str], start_tenths: int) -> DataFrame:
    """Bank in tenths after each round: start + sales - purchases so far."""
    net = F.coalesce("sale_tenths", F.lit(0)) - F.coalesce("price_tenths", F.lit(0))
    return running(decisions, keys, order, {"_net": ("sum", net)}).withColumn(
        "bank_tenths", F.lit(start_tenths) + F.col("_net")
    ).drop("_net")


def chips_used(decisions: DataFrame, keys: Sequence[str], gameweek: str = "gameweek") -> DataFrame:
    """Uses of each chip per season half, with overuse flagged (one of each per half)."""
    half = F.when(F.col(gameweek) <= FIRST_HALF_END, F.lit("first")).otherwise(F.lit("second"))
    return decisions.filter(F.col("chip").isNotNull() & (F.col("chip") != "")).groupBy(
        *keys, half.alias("half"), "chip"
    ).agg(F.count(F.lit(1)).alias("used")).withColumn("overused", F.col("used") > 1)


def purchase_prices(swaps: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last purchase price of every player a manager ever bought and still holds: the last
    event per (manager, player) is a purchase, not a sale."""
    events = swaps.select(*keys, *order, F.col("in_id").alias("player_id"),
                          F.col("in_price_tenths").alias("purchase_tenths"), F.lit(1).alias("_in")).unionByName(
        swaps.select(*keys, *order, F.col("out_id").alias("player_id"),
                     F.lit(None).cast("long").alias("purchase_tenths"), F.lit(0).alias("_in"))
    )
    last = events.groupBy(*keys, "player_id").agg(
        F.max(F.struct(*order, "_in", "purchase_tenths")).alias("_e")
    )
    return last.filter(F.col("_e._in") == 1).select(*keys, "player_id", "_e.purchase_tenths")


def swap_order(pairs: DataFrame, banks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An order in which every swap is affordable when made (L6R): at each step the first
    remaining pair the running bank can pay. ``pairs`` has pair_no, out_id, in_id,
    sale_tenths, price_tenths; ``banks`` has bank_tenths. A pair that never becomes affordable
    has a null ``step``. Groups over the transfer cap break the rules: none of their swaps is
    made, so all of their pairs have a null ``step``, and :func:`over_transfer_cap` lists them."""
    k = list(keys)
    sizes = pairs.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    legal = sizes.filter(F.col("_n") <= MAX_TRANSFERS_PER_ROUND)
    bank = F.col("bank_tenths").cast("long").alias("bank_after_tenths")
    broken = pairs.join(sizes.filter(F.col("_n") > MAX_TRANSFERS_PER_ROUND).select(*k), k, "left_semi").join(banks.select(*k, bank), k)
    item = F.struct("pair_no", "out_id", "in_id", "sale_tenths", "price_tenths")
    packed = (
        pairs.join(legal.select(*k), k, "left_semi").groupBy(*k)
        .agg(F.array_sort(F.collect_list(item)).alias("_left"))
        .join(banks.select(*k, F.col("bank_tenths").cast("long").alias("_bank")), k)
    )
    empty = F.filter("_left", lambda p: F.lit(False))

    def choose(acc: Column, _: Column) -> Column:
        pick = F.get(
            F.filter(acc["left"], lambda p: acc["bank"] + p["sale_tenths"] - p["price_tenths"] >= 0), F.lit(0)
        )
        return F.when(
            pick.isNotNull(),
            F.struct(
                (acc["bank"] + pick["sale_tenths"] - pick["price_tenths"]).alias("bank"),
                F.filter(acc["left"], lambda p: p["pair_no"] != pick["pair_no"]).alias("left"),
                F.concat(acc["done"], F.array(pick)).alias("done"),
            ),
        ).otherwise(acc)

    folded = packed.select(
        *k,
        F.aggregate(
            F.sequence(F.lit(1), F.size("_left")),
            F.struct(F.col("_bank").alias("bank"), F.col("_left").alias("left"), empty.alias("done")),
            choose,
        ).alias("_f"),
    )
    made = folded.select(*k, F.col("_f.bank").alias("bank_after_tenths"), F.posexplode("_f.done").alias("_at", "_p")).select(
        *k, (F.col("_at") + 1).alias("step"), "_p.*", "bank_after_tenths"
    )
    stuck = folded.select(*k, F.col("_f.bank").alias("bank_after_tenths"), F.explode("_f.left").alias("_p")).select(
        *k, F.lit(None).cast("int").alias("step"), "_p.*", "bank_after_tenths"
    )
    return made.unionByName(stuck).unionByName(
        broken.select(*k, F.lit(None).cast("int").alias("step"), "pair_no", "out_id", "in_id", "sale_tenths", "price_tenths", "bank_after_tenths")
    )


def over_transfer_cap(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("transfers")).filter(
        F.col("transfers") > MAX_TRANSFERS_PER_ROUND
    )
