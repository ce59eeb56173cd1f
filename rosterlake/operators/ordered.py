"""Ordered (per-group, row-by-row) work that survives a hot group.

A window with ``PARTITION BY k`` puts all rows of one ``k`` into one task. Every function
here first takes the largest group's size from a map-side-combined count. Below the limit
(``spark.rosterlake.maxGroupRows``) the ordinary window is used. Above it the rows are
range-partitioned on (keys, order), which cuts a hot group into pieces of even size; each
piece is windowed on its own and the little that crosses a cut (a count, a running total,
the last few rows) is carried over from the earlier pieces. Both ways give the same rows.

``order`` is a list of column names; a leading ``-`` means descending. Nulls sort last.
It must be a total order inside a group for results to be reproducible.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rosterlake.session import MAX_GROUP_ROWS, pin, setting

PIECE = "_piece"
_HALO = "_halo"


def sort_columns(order: Sequence[str], reverse: bool = False) -> list[Column]:
    out = []
    for spec in order:
        descending = spec.startswith("-")
        column = F.col(spec[1:] if descending else spec)
        if reverse:
            out.append(column.asc_nulls_first() if descending else column.desc_nulls_first())
        else:
            out.append(column.desc_nulls_last() if descending else column.asc_nulls_last())
    return out


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(all rows, rows of the largest group), from one partially aggregated count."""
    if not keys:
        rows = df.count()
        return rows, rows
    total, largest = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n"), F.max("n"))
        .first()
    )
    return total or 0, largest or 0


def _window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    partition = [F.col(k) for k in keys] or [F.lit(0)]
    return Window.partitionBy(*partition).orderBy(*sort_columns(order))


def _hot(df: DataFrame, keys: Sequence[str], hot: bool | None) -> tuple[bool, int]:
    """Whether a group is over the limit, and into how many pieces to cut the table."""
    if hot is False:
        return False, 0
    limit = setting(df.sparkSession, MAX_GROUP_ROWS)
    if not hot and df.count() <= limit:  # no group is larger than the table, whose rows are often counted from file footers
        return False, 0
    total, largest = group_sizes(df, keys)
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    pieces = max(shuffles, math.ceil(total / max(1, limit)), 2)
    return bool(hot) or largest > limit, pieces


def is_hot(df: DataFrame, keys: Sequence[str], distinct: str | None = None) -> bool:
    """Whether a group is over the limit. For several ordered operators on the same groups,
    ask once and pass the answer on. With ``distinct``, groups are counted after removing
    duplicates of that column; an estimate is enough, as both plans give the same rows. A sketch of a
    group is far larger than its count, so only groups with more rows than the limit get one."""
    limit = setting(df.sparkSession, MAX_GROUP_ROWS)
    if df.count() <= limit:
        return False
    if distinct is None:
        return group_sizes(df, keys)[1] > limit
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    large = pin(large.select(*[F.col(k).alias(f"_l_{k}") for k in keys]))  # fewer than rows / limit
    if large.isEmpty():
        return False
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_l_{k}"))
    estimate = df.join(large, same, "left_semi").groupBy(*keys).agg(F.approx_count_distinct(distinct).alias("n")).agg(F.max("n")).first()[0]
    return (estimate or 0) * 1.2 > limit


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int) -> DataFrame:
    """Range-partition on (keys, order) and keep the piece number with each row."""
    ranges = [F.col(k).asc_nulls_first() for k in keys] + sort_columns(order)
    return pin(df.repartitionByRange(pieces, *ranges).withColumn(PIECE, F.spark_partition_id()))


def _carried(
    placed: DataFrame,
    keys: Sequence[str],
    totals: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
) -> DataFrame:
    """What the earlier pieces of a group hand to each later piece.

    A cut falls inside at most one group, so there are fewer rows here than pieces.
    """
    stats = placed.groupBy(*keys, PIECE).agg(*[c.alias(n) for n, c in totals.items()])
    partition = [F.col(k) for k in keys] or [F.lit(0)]
    by_piece = Window.partitionBy(*partition).orderBy(PIECE)
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    return (
        stats.select(
            *keys,
            PIECE,
            F.row_number().over(by_piece).alias("_index"),
            *[merge[n](n).over(before).alias(n) for n in totals],
        )
        .filter(F.col("_index") > 1)
    )


def _attach(placed: DataFrame, carry: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    renamed = carry.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.col(PIECE).alias("_c_piece"),
        F.col("_index"),
        *names,
    )
    condition = F.col(PIECE) == F.col("_c_piece")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return placed.join(renamed, condition, "left").drop(
        "_c_piece", *[f"_c_{k}" for k in keys]
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "row_no",
    hot: bool | None = None,
) -> DataFrame:
    """Exact 1-based row number per group. ``keys=[]`` numbers the whole table."""
    keys = list(keys)
    is_hot, pieces = _hot(df, keys, hot)
    if not is_hot:
        return df.withColumn(name, F.row_number().over(_window(keys, order)).cast("long"))
    placed = _cut(df, keys, order, pieces)
    carry = _carried(
        placed, keys, {"_before": F.count(F.lit(1))}, {"_before": lambda n: F.sum(n)}
    )
    own = F.row_number().over(_window([*keys, PIECE], order))
    return (
        _attach(placed.withColumn("_own", own), carry, keys, ["_before"])
        .withColumn(name, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop("_own", "_before", "_index", PIECE)
    )


_MERGE = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, tuple[str, Column]],
    include_current: bool = True,
    hot: bool | None = None,
) -> DataFrame:
    """Running ``sum``/``count``/``min``/``max`` from the first row of the group on.

    ``totals`` maps an output name to (function name, column). For values *ahead* of a row
    pass the reversed order.
    """
    keys = list(keys)
    last = Window.currentRow if include_current else -1
    is_hot, pieces = _hot(df, keys, hot)
    if not is_hot:
        frame = _window(keys, order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({n: _MERGE[f][0](c).over(frame) for n, (f, c) in totals.items()})
    placed = _cut(df, keys, order, pieces)
    carry = _carried(
        placed,
        keys,
        {f"_c_{n}": _MERGE[f][0](c) for n, (f, c) in totals.items()},
        {f"_c_{n}": (F.sum if f == "count" else _MERGE[f][0]) for n, (f, _) in totals.items()},
    )
    frame = _window([*keys, PIECE], order).rowsBetween(Window.unboundedPreceding, last)
    own = placed.withColumns({n: _MERGE[f][0](c).over(frame) for n, (f, c) in totals.items()})
    joined = _attach(own, carry, keys, [f"_c_{n}" for n in totals])
    return joined.withColumns(
        {n: _MERGE[f][1](F.col(f"_c_{n}"), F.col(n)) for n, (f, _) in totals.items()}
    ).drop(*[f"_c_{n}" for n in totals], "_index", PIECE)


def lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    hot: bool | None = None,
) -> DataFrame:
    """Window columns that read at most ``before`` earlier rows of the group.

    ``columns`` receives the window and returns the new columns; all of them share one
    shuffle and one sort.
    """
    keys = list(keys)
    is_hot, pieces = _hot(df, keys, hot)
    if not is_hot:
        return df.withColumns(columns(_window(keys, order)))
    placed = _cut(df, keys, order, pieces)
    carry = pin(
        _carried(placed, keys, {"_before": F.count(F.lit(1))}, {"_before": lambda n: F.sum(n)})
    )
    ranked = _attach(
        placed.withColumn(
            "_rank", F.row_number().over(_window([*keys, PIECE], order)).cast("long")
        ),
        carry,
        keys,
        ["_before"],
    ).withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))
    # The last rows of every piece that has a successor: at most pieces x before rows.
    backwards = Window.partitionBy(*[F.col(k) for k in keys], F.col(PIECE)).orderBy(
        *sort_columns(order, reverse=True)
    )
    split = carry.select(*[F.col(k).alias(f"_s_{k}") for k in keys]).distinct()
    same_group = F.lit(True)
    for k in keys:
        same_group = same_group & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    tails = (
        ranked.withColumn("_from_end", F.row_number().over(backwards))
        .filter(F.col("_from_end") <= before)
        .drop("_from_end")
    )
    if keys:
        tails = tails.join(split, same_group, "left_semi")
    target = carry.select(
        *[F.col(k).alias(f"_t_{k}") for k in keys],
        F.col(PIECE).alias("_t_piece"),
        F.col("_index").alias("_t_index"),
        F.col("_before").alias("_t_before"),
    )
    reach = F.col("_t_index") == F.col("_next")
    for k in keys:
        reach = reach & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    index = F.coalesce(F.col("_index"), F.lit(1))
    halo = (
        tails.withColumn("_next", F.explode(F.sequence(index + 1, index + before)))
        .join(target, reach)
        .filter(F.col("_rank") > F.col("_t_before") - before)
        .withColumn(PIECE, F.col("_t_piece"))
    )
    plain = df.columns
    both = placed.select(*plain, PIECE, F.lit(False).alias(_HALO)).unionByName(
        halo.select(*plain, PIECE, F.lit(True).alias(_HALO))
    )
    return (
        both.withColumns(columns(_window([*keys, PIECE], order)))
        .filter(~F.col(_HALO))
        .drop(PIECE, _HALO)
    )


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, name: str | None = None
) -> DataFrame:
    """First ``k`` rows per group. Spark limits each map task to ``k`` rows per group before
    the shuffle, so a hot group never travels whole."""
    rank = name or "_rank"
    if not keys:
        top = df.orderBy(*sort_columns(order)).limit(k)
        return top.withColumn(rank, F.row_number().over(_window([], order))) if name else top
    out = df.withColumn(rank, F.row_number().over(_window(keys, order))).filter(F.col(rank) <= k)
    return out if name else out.drop(rank)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in a named total order."""
    return top_rows(df, keys, order, 1)


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row per key in a named total order."""
    flipped = [s[1:] if s.startswith("-") else f"-{s}" for s in order]
    return top_rows(df, keys, flipped, 1)


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, without one task holding the group:
    equal values are counted first, then positions are found in the running count."""
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranked = running(counted, keys, [value], {"_upto": ("sum", F.col("_n"))})
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    if keys:
        placed = ranked.join(sizes, keys)
    else:
        placed = ranked.join(F.broadcast(sizes), F.lit(True))
    aggs = []
    for name, p in points.items():
        position = F.lit(float(p)) * (F.col("_size") - 1)
        for tag, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (index < F.col("_upto")) & (index >= F.col("_upto") - F.col("_n"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"_{tag}_{name}"))
    picked = placed.groupBy(*keys, "_size").agg(*aggs)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}")
                + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
                * (F.lit(float(p)) * (F.col("_size") - 1) - F.floor(F.lit(float(p)) * (F.col("_size") - 1)))
            ).alias(n)
            for n, p in points.items()
        ],
    )


def collect_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: Column,
    name: str,
    part_rows: int = 1000,
    hot: bool | None = None,
) -> DataFrame:
    """Ordered arrays per group, in numbered parts of at most ``part_rows`` items: a group
    within the bound gives one row (part 0), a larger one gives several, and no row is lost."""
    numbered_rows = numbered(df, keys, order, "_no", hot=hot).withColumn(
        "part_no", F.floor((F.col("_no") - 1) / part_rows).cast("int")
    )
    packed = F.array_sort(F.collect_list(F.struct(F.col("_no"), item.alias("item"))))
    return numbered_rows.groupBy(*keys, "part_no").agg(
        F.transform(packed, lambda x: x["item"]).alias(name)
    )
