"""Ranks of all rows under a composite key by a distributed radix sort, least significant digit first.

The key columns are laid side by side as one unsigned number of as many bits as their ranges need. Every pass is a stable
counting sort by one digit: rows stand in blocks of consecutive positions, each block counts its digits, a row's destination
is the number of rows with smaller digits, plus those with its digit in earlier blocks, plus those before it in its own block.
The first number is a prefix sum over at most ``2 ** DIGIT_BITS`` totals on the driver, the second a running sum over blocks,
digit by digit, the third a counting sort inside the block. After the last digit a row's position is its rank.

No task holds more than a block, however often a key value occurs. Every pass ends as a table in the shared folder, so a lost
executor costs part of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.llm.runtime import ship, written

#: Positions of a block, and bits of a digit: the counts of a block are at most an eighth of its rows.
BLOCK_BITS, DIGIT_BITS = 13, 10
_SIGN = -(1 << 63)


def _fields(rows: DataFrame, keys: Sequence[tuple[str, bool]]) -> list[tuple[Column, int]]:
    """Each key as a column of non-negative bits in rising order, and their number. Nulls come before all else in a rising
    key and after all else in a falling one."""
    spans = rows.agg(*[f(c).alias(f"{name}{i}") for i, (c, _) in enumerate(keys) for name, f in (
        ("least", F.min), ("most", F.max), ("nulls", lambda c: F.count(F.when(F.col(c).isNull(), 1))))]).first()
    out: list[tuple[Column, int]] = []
    for i, (name, falling) in enumerate(keys):
        least, most, nulls = spans[f"least{i}"], spans[f"most{i}"], spans[f"nulls{i}"]
        if nulls:
            out.append((F.col(name).isNull().cast("long") if falling else F.col(name).isNotNull().cast("long"), 1))
        if least is None or least == most:
            continue
        value = F.col(name).cast("long")
        if most - least < 1 << 62:
            out.append((F.coalesce(F.lit(most) - value if falling else value - F.lit(least), F.lit(0)), (most - least).bit_length()))
        else:  # a difference could overflow: the sign bit turned, all 64 bits are in order
            turned = value.bitwiseXOR(F.lit(_SIGN))
            out.append((F.coalesce(F.bitwise_not(turned) if falling else turned, F.lit(0).cast("long")), 64))
    return out


def _digit(fields: list[tuple[str, int]], low: int) -> Column:
    """Bits ``low`` to ``low + DIGIT_BITS`` of the fields side by side, the last field lowest."""
    out, place = F.lit(0).cast("long"), 0
    for name, bits in reversed(fields):
        begin, end = max(low, place), min(low + DIGIT_BITS, place + bits)
        if begin < end:
            part = F.shiftrightunsigned(F.col(name), begin - place).bitwiseAND(F.lit((1 << (end - begin)) - 1))
            out = out + F.shiftleft(part, begin - low)
        place += bits
    return out.cast("int")


def _destinations(rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """A counting sort of one block: its rows take the next free places of their digits."""
    if not rows.num_rows:
        return rows
    slots = np.full(1 << BLOCK_BITS, -1)
    slots[np.asarray(rows["pos"]) & ((1 << BLOCK_BITS) - 1)] = np.arange(rows.num_rows)
    in_order = slots[slots >= 0]
    digits = np.asarray(rows["digit"])[in_order]
    base = np.zeros(1 << DIGIT_BITS, dtype=np.int64)
    base[np.asarray(offsets["digit"])] = np.asarray(offsets["offset"])
    by_digit = np.argsort(digits.astype(np.uint16), kind="stable")
    counts = np.bincount(digits, minlength=len(base))
    heads = np.cumsum(counts) - counts
    grouped = digits[by_digit]
    to = base[grouped] + np.arange(len(grouped)) - heads[grouped]
    placed = rows.take(pa.array(in_order[by_digit]))
    return placed.set_column(placed.schema.get_field_index("pos"), "pos", pa.array(to, pa.int64()))


def ranks(rows: DataFrame, row: str, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """(``row``, rank): the rank of every row from 1 under the keys, each (column of whole numbers, falling). ``row`` is a
    whole number of its own for each row. Rows equal in all keys get neighbouring ranks in an order of no meaning. An empty
    table has no ranks."""
    ship(rows.sparkSession)
    source = written(rows.select(F.monotonically_increasing_id().alias("pos"), F.col(row).cast("long").alias("row"), *[
        F.col(c).alias(f"_key{i}") for i, (c, _) in enumerate(keys)
    ]), "keys")
    laid = _fields(source, [(f"_key{i}", falling) for i, (_, falling) in enumerate(keys)])
    names = [f"field{i}" for i in range(len(laid))]
    fields = list(zip(names, (bits for _, bits in laid)))
    held = source.select("pos", "row", *[c.alias(n) for (c, _), n in zip(laid, names)])
    for low in range(0, max(1, sum(bits for _, bits in fields)), DIGIT_BITS):
        held = written(_pass(held, _digit(fields, low)), "radix")
    return held.select(F.col("row").alias(row), (F.col("pos") + 1).alias("rank"))


def _pass(held: DataFrame, digit: Column) -> DataFrame:
    blocks = held.withColumns({"digit": digit, "block": F.shiftright("pos", BLOCK_BITS)})
    counts = written(blocks.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n")), "digits")
    totals = np.zeros(1 << DIGIT_BITS, dtype=np.int64)
    for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect():  # at most one row a digit
        totals[r.digit] = r.n
    smaller = F.get(F.array(*[F.lit(int(n)) for n in np.cumsum(totals) - totals]), F.col("digit"))
    earlier = F.sum("n").over(W.partitionBy("digit").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("block", "digit", (smaller + F.coalesce(earlier, F.lit(0))).alias("offset"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    return blocks.groupBy("block").cogroup(offsets.groupBy("block")).applyInArrow(_destinations, schema).drop("digit", "block")
