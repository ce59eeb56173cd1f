"""Text helpers."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.constants import CURRENT_INFO_WORDS
from rosterlake.functions.numbers import as_column

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _named_entities() -> Column:
    """The published names of HTML 5, from the standard library's table, as one constant."""
    names = {f"&{name}": text for name, text in html5.items() if name.endswith(";")}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _entity(e: Column) -> Column:
    """What a character reference stands for; one that stands for nothing stays. By the HTML rule the numbers 128 to 159 are
    read as Windows-1252, and 0, surrogates and what lies beyond Unicode as the replacement character."""
    digits = F.substring(e, F.lit(3), F.length(e) - 3)
    number = F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)).otherwise(digits).try_cast("int")
    no_character = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    code = F.when(no_character, 0xFFFD).otherwise(number)
    windows = F.get(F.array(*[F.lit(bytes([i]).decode("cp1252", "ignore") or chr(i)) for i in range(128, 160)]), number - 128)
    character = F.when(number.between(128, 159), windows).otherwise(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"))
    return F.coalesce(F.when(F.substring(e, 2, 1) == "#", character).otherwise(F.try_element_at(_named_entities(), e)), e)


def decode_entities(text: Column | str) -> Column:
    """Named and numeric character references that end with a semicolon, each decoded once."""
    whole = as_column(text)
    found = F.transform(F.array_distinct(F.regexp_extract_all(whole, F.lit(_ENTITY), F.lit(0))), lambda e: F.struct(e.alias("e"), _entity(e).alias("to")))
    # ampersands come last, so that what they make is not decoded again
    last = F.concat(F.filter(found, lambda x: x["to"] != "&"), F.filter(found, lambda x: x["to"] == "&"))
    decoded = F.aggregate(last, whole, lambda done, x: F.replace(done, x["e"], x["to"]))
    return F.when(whole.contains("&"), decoded).otherwise(whole)


def collapse_text(text: Column | str) -> Column:
    """Decode character references, drop control characters, collapse whitespace, trim."""
    out = F.regexp_replace(decode_entities(text), CONTROL, " ")
    return F.trim(F.regexp_replace(out, SPACES, " "))


def clean_text(text: Column | str, limit: int | None = None) -> Column:
    """Collapsed text, whole unless a display limit is asked for."""
    whole = collapse_text(text)
    return whole if limit is None else F.substring(whole, 1, limit)


def keyword_flag(text: Column | str, words: list[str] = CURRENT_INFO_WORDS) -> Column:
    """Whether a single word matches as a word, or a phrase as a substring; case-insensitive."""
    lowered = F.lower(as_column(text))
    single = [w for w in words if " " not in w]
    hit = lowered.rlike(r"\b(" + "|".join(map(re.escape, single)) + r")\b") if single else F.lit(False)
    for phrase in words:
        if " " in phrase:
            hit = hit | lowered.contains(phrase)
    return hit


def parse_round_counts(text: Column | str) -> Column:
    """'16:5, 17:2' -> {16: 5, 17: 2}; an entry that is not 'int:int' makes the result null.

    Of entries for the same round the last one counts."""
    items = F.filter(
        F.transform(F.split(as_column(text), ","), lambda s: F.trim(s)), lambda s: s != ""
    )
    pairs = F.transform(
        items,
        lambda s: F.struct(
            F.trim(F.substring_index(s, ":", 1)).try_cast("int").alias("k"),
            F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).try_cast("int").alias("v"),
        ),
    )
    bad = F.exists(pairs, lambda p: p["k"].isNull() | p["v"].isNull()) | F.exists(
        items, lambda s: ~s.contains(":")
    )
    latest = F.aggregate(
        pairs,
        F.create_map().cast("map<int,int>"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])
        ),
    )
    return F.when(~bad, latest)


def round_count_errors(df: DataFrame, column: str) -> DataFrame:
    """The strict form: rows whose entry list cannot be read."""
    return df.filter(F.col(column).isNotNull() & parse_round_counts(column).isNull())
