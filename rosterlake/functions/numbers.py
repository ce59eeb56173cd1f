"""Lenient numbers, ratios, flags and rounding."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Double, with anything unreadable (NaN included) as null."""
    value = as_column(c).cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def number_columns(columns: list[str], df: DataFrame) -> dict[str, Column]:
    """The listed columns that exist, as doubles; only text needs a lenient cast."""
    out = {}
    for name in columns:
        if name in df.columns:
            numeric = isinstance(df.schema[name].dataType, T.NumericType)
            value = F.col(name).cast("double")
            out[name] = F.when(~F.isnan(value), value) if numeric else to_number(name)
    return out


def or_zero(c: Column | str) -> Column:
    return F.coalesce(as_column(c), F.lit(0.0))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Null where the denominator is zero or missing."""
    return F.try_divide(as_column(numerator), as_column(denominator))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value, keeping null as null."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Value for a key from a small fixed mapping."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(literal, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def sale_value(purchase_tenths: Column | str, current_tenths: Column | str) -> Column:
    """Price falls pass through; half of a gain counts, floored to a tenth."""
    bought, now = as_column(purchase_tenths).cast("long"), as_column(current_tenths).cast("long")
    return F.when(now <= bought, now).otherwise(bought + F.floor((now - bought) / 2))


def to_tenths(millions: Column | str) -> Column:
    return F.round(as_column(millions) * 10).cast("long")
