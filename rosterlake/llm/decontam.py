"""Benchmark passages in documents by Wu-Manber multi-pattern search over words.

The patterns are the windows of ten consecutive words of every benchmark item (an item of fewer words is one window).
A shift table over hashed blocks of two words says how far a position can move on, a bucket by suffix block holds the
patterns that may end there, and the words themselves are then compared. Many stretches of text are searched side by
side, each with its own position.

Words are lower-cased (A-Z) runs of digits, a-z and characters beyond ASCII. A null or empty text has no words and no
hits; neither has a benchmark item without words. Windows that several items share count for each. Repeated benchmark
ids count once. Repeated documents are judged each on their own. Long texts are searched in stretches, without prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.runtime import extended, pieces, ship, text_bytes, written
from rosterlake.llm.words import ALNUM, Words, mix, slices, split

WINDOW = 10
#: Bytes of benchmark text whose tables are sent to the workers at a time; a larger benchmark is searched in blocks.
BLOCK_BYTES = 16 << 20
#: Positions that one search runs through before another takes over; all searches of a slice run side by side.
STRETCH = 512
_SLOTS = 22
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Tables:
    """Shift table and suffix buckets for patterns of one length."""

    def __init__(self, patterns: np.ndarray, owners: list[np.ndarray], texts: list[bytes]):
        self.length = patterns.shape[1]
        self.block = min(2, self.length)
        ends = np.arange(self.block - 1, self.length)
        slots = np.stack([self._slot(patterns, j) for j in ends])
        self.shift = np.full(1 << _SLOTS, self.length - self.block + 1, dtype=np.uint8)
        for j, row in zip(ends, slots):
            self.shift[row] = np.minimum(self.shift[row], self.length - 1 - j)
        order = np.argsort(slots[-1], kind="stable")
        self.patterns, self.suffix = patterns[order], slots[-1][order]
        self.owners, self.texts = [owners[i] for i in order], [texts[i] for i in order]

    def _slot(self, words: np.ndarray, at: int | np.ndarray) -> np.ndarray:
        last = words[..., at]
        joined = last if self.block == 1 else words[..., at - 1] * _PAIR + last
        return (mix(joined) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def search(self, words: Words) -> Iterator[tuple[int, int]]:
        """(last word, pattern) of every occurrence."""
        h, m = words.hashes[0], self.length
        begin, stop = words.first[:-1] + m - 1, words.first[1:]
        open_ = begin < stop
        begin, stop = begin[open_], stop[open_]
        cuts = -(-(stop - begin) // STRETCH)
        at = np.repeat(begin, cuts) + STRETCH * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        until = np.minimum(at + STRETCH, np.repeat(stop, cuts))
        ends = []
        while len(at):
            step = self.shift[self._slot(h, at)]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < until
            at, until = at[going], until[going]
        end = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
        slot = self._slot(h, end) if len(end) else end
        low, high = np.searchsorted(self.suffix, slot, "left"), np.searchsorted(self.suffix, slot, "right")
        n = high - low
        end, pattern = np.repeat(end, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for j in range(m):  # the first words rule most out, as their blocks are the least alike
            same = h[end - m + 1 + j] == self.patterns[pattern, j]
            end, pattern = end[same], pattern[same]
        for e, k in zip(end.tolist(), pattern.tolist()):
            if _joined(words, e - m + 1, e + 1) == self.texts[k]:
                yield e, k


def _joined(words: Words, a: int, b: int) -> bytes:
    return b" ".join([words.raw[words.starts[i] : words.ends[i]].tobytes() for i in range(a, b)])


class Patterns:
    """Windows of benchmark items, with tables that are built on first use where they are used."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.items, self.window, self._tables = items, window, None

    def __getstate__(self):
        return {"items": self.items, "window": self.window, "_tables": None}

    def tables(self) -> list[Tables]:
        if self._tables is None:
            words = split(pa.array([t for _, t in self.items], pa.string()), ALNUM, lower=True)
            groups: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                m = min(self.window, int(b - a))
                for s in range(a, b - m + 1 if m else a):
                    groups.setdefault(m, {}).setdefault(_joined(words, s, s + m), (s, set()))[1].add(i)
            self._tables = [
                Tables(
                    np.stack([words.hashes[0][s : s + m] for s, _ in found.values()]),
                    [np.array(sorted(o)) for _, o in found.values()], list(found),
                )
                for m, found in sorted(groups.items())
            ]
        return self._tables

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, list[list[list[int]]], list[set[int]]]:
        """Words per text; hit ranges of words (start, end exclusive), merged; numbers of the items that occur."""
        words = split(texts, ALNUM, lower=True)
        change = np.zeros(len(words) + 1, dtype=np.int64)
        items: list[set[int]] = [set() for _ in range(len(texts))]
        for table in self.tables():
            for end, k in table.search(words):
                change[end - table.length + 1] += 1
                change[end + 1] -= 1
                items[int(np.searchsorted(words.first, end, "right")) - 1].update(table.owners[k].tolist())
        inside = np.cumsum(change[:-1]) > 0
        ranges: list[list[list[int]]] = []
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            edge = np.diff(np.concatenate(([0], inside[a:b].astype(np.int8), [0]))) if items[i] else np.zeros(1)
            ranges.append(np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1).tolist())
        return words.per_doc(), ranges, items


def _merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def mark(docs: DataFrame, benchmark: DataFrame, column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``hits`` (merged ranges of hit words), ``n_hit``, ``items`` (ids that occur) and ``contaminated``.
    ``benchmark`` has item_id and text. Its blocks are searched one after another, each with a bounded broadcast."""
    spark = docs.sparkSession
    ship(spark)
    bench = benchmark.select("item_id", "text")
    n_blocks = pieces(text_bytes(bench), block_bytes)
    id_type = bench.schema["item_id"].dataType.simpleString()
    kept = docs.drop("n_words", "hits", "items", "n_hit", "contaminated")
    names = kept.columns
    out = kept.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast("array<array<int>>"), "items": F.lit(None).cast(f"array<{id_type}>")})
    schema = extended(kept, f"n_words long, hits array<array<int>>, items array<{id_type}>")
    for block in range(n_blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        held = spark.sparkContext.broadcast(Patterns([(r.item_id, r.text) for r in rows.collect()], window))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            patterns = held.value
            for batch in batches:
                for part in slices(batch, column):
                    n, ranges, found = patterns.hits(part[column])
                    before = part["hits"].to_pylist(), part["items"].to_pylist()
                    ranges = [_merged((b or []) + r) for b, r in zip(before[0], ranges)]
                    ids = [list(set(b or []) | {patterns.items[i][0] for i in f}) for b, f in zip(before[1], found)]
                    new = pa.array(n, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int32()))), pa.array(ids, part["items"].type)
                    yield pa.RecordBatch.from_arrays([part[c] for c in names] + list(new), names=[*names, "n_words", "hits", "items"])

        out = out.mapInArrow(run, schema)
        if block % 4 == 3 and block + 1 < n_blocks:
            out = written(out, "decontam")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return out.withColumns({"n_hit": n_hit, "contaminated": n_hit > 0})
