"""Judging addresses: rules by host and path, then a weighted vocabulary counted with Aho-Corasick.

A strict term rejects on one hit, soft terms on several distinct ones. A term counts only where no letter or digit
touches it. A null address has an empty host and path, no hits, and is allowed; so is an empty one. Repeated rows are
judged each on their own. The cost is one pass over the address, whatever the size of the vocabulary.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.runtime import extended, ship

# Terms by the category that public block lists file them under, in English, German, French and Spanish.
#: One of these rejects.
STRICT = (
    "porn", "porno", "pornhub", "pornstar", "xxx", "xvideos", "xnxx", "hentai", "nsfw", "camgirl", "camgirls", "sexcam", "sexcams",
    "escort", "escorts", "milf", "bdsm", "gangbang", "blowjob",
)
#: Several of these, all different, reject; each alone is found in honest addresses too.
SOFT_BY_CATEGORY = {
    "adult": ("adult", "adults", "dating", "erotic", "erotik", "erotique", "erotico", "fetish", "nude", "nackt", "desnuda", "sex", "sexe", "sexo", "sexy", "singles", "webcam", "webcams"),
    "gambling": ("apuestas", "bet", "bets", "betting", "bingo", "casino", "casinos", "gambling", "gewinnspiel", "jackpot", "loteria", "loterie", "lottery", "lotto", "odds", "poker", "roulette", "ruleta", "slots", "wager", "wetten", "win", "winner", "winners"),
    "offers": ("billig", "bonus", "cheap", "free", "giveaway", "gratis", "gratuit", "kostenlos", "prize", "prizes", "promo"),
    "finance": ("forex", "kredit", "loan", "loans", "payday", "prestamo", "prestamos"),
    "pharmacy": ("cialis", "levitra", "pills", "tramadol", "viagra", "xanax"),
    "piracy": ("crack", "cracked", "keygen", "nulled", "serials", "torrent", "torrents", "warez"),
    "spam": ("backlinks", "clickbait", "doorway", "farm", "replica", "replicas", "seo", "spam"),
}
SOFT = tuple(term for terms in SOFT_BY_CATEGORY.values() for term in terms)
SOFT_HITS = 2
#: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _upper_to_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_place(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``: both empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.col(url), "://", 1))
    tail = F.when(rest.isNotNull(), F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(tail, r"^[^/?#]*(/[^?#]*)", 1)
    return pages.withColumns({"host": _upper_to_lower(host), "path": path})


def rule_of(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, as text and as verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


@functools.lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in strict + soft:
        found.add_word(term, term)
    found.make_automaton()
    return found


def hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """Distinct strict and soft terms that stand alone in the address, A-Z read as a-z."""
    if not url:
        return [], []
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
    touches = lambda i: 0 <= i < len(text) and text[i] in "abcdefghijklmnopqrstuvwxyz0123456789"
    seen = {term for end, term in _automaton(strict, soft).iter(text) if not touches(end + 1) and not touches(end - len(term))}
    return sorted(seen & set(strict)), sorted(seen & set(soft))


def judge(
    pages: DataFrame, url: str = "url", strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT,
    soft_hits: int = SOFT_HITS, rules: tuple = RULES,
) -> DataFrame:
    """Add host, path, rule, strict_hits, soft_hits (arrays of terms) and verdict. Columns of these names are replaced."""
    ship(pages.sparkSession)
    ours = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits", "_by_rule"]
    placed = with_place(pages.drop(*[c for c in ours if c != url]), url)
    name, verdict = rule_of(rules)
    ruled = placed.withColumns({"rule": name, "_by_rule": verdict})
    schema = extended(ruled, "strict_hits array<string>, soft_hits array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [hits(u, strict, soft) for u in batch[url].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array([b[k] for b in both], pa.list_(pa.string())) for k in (0, 1)],
                names=batch.schema.names + ["strict_hits", "soft_hits"],
            )

    bad = (F.size("strict_hits") >= 1) | (F.size("soft_hits") >= soft_hits)
    return ruled.mapInArrow(run, schema).withColumn(
        "verdict", F.coalesce("_by_rule", F.when(bad, "block").otherwise("allow"))
    ).drop("_by_rule")
