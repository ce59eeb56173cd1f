"""Repeated passages removed word by word: a count-min sketch first, exact grouping only of what it estimates repeated.

Documents are dealt into blocks by id. Every block counts its windows into its own sketch, cell by cell, and the sketches
are merged per range of cells. A window whose estimate (the least of its cells) is one occurs once, so only the others
go on; the sketch never underestimates, so none is lost. The second pass groups those by a hash of their words, of 128 bits
between blocks and of 64 inside one (some million windows), and tells each block which of them it holds first. The sketch has as many cells as the input needs, spread over the
cluster in ranges; nothing is broadcast or collected but one count of bytes. A block sends a message to every range that it
has cells in, so the number of messages (not their bytes) grows with the square of the input until each holds few cells:
for inputs of terabytes raise ``block_bytes``.

A window is ``window`` consecutive words of one document. Each word is removed that a window covers whose words also
start earlier: in a smaller doc_id, or earlier in the same document. A null doc_id comes before all others. Ids are whole numbers. Rows of the
same doc_id count as one document with several texts: the same start is not earlier, so exact repeats of a whole row
leave each other alone. Null and empty texts have no words; a text shorter than a window keeps all of its words.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.runtime import extended, pieces, ship, text_bytes
from rosterlake.llm.words import mix, slices, split

WINDOW = 20
#: Text that one task holds at a time.
BLOCK_BYTES = 8 << 20
#: Rows of the sketch, and cells of a row for each window (rounded up to a power of two).
DEPTH = 2
CELLS_PER_WINDOW = 8
#: Cells that one task merges at a time.
RANGE_BITS = 23
#: Windows that one task groups at a time, about.
GROUPED = 4_000_000
_U = np.uint64
_SALTS = np.array([0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], dtype=np.uint64)


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned 64-bit numbers as bytes, of a rising row the steps; equal bytes of all numbers stand together."""
    if rising:
        values = np.diff(values, prepend=_U(0))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).view("<u8").reshape(n).astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if rising else values


class Block:
    """The windows of a block's documents. ``distinct``: hashes in rising order; ``of``: which of them each window is."""

    def __init__(self, rows: pa.Table, column: str, window: int, key: str = "_doc", second: bool = False):
        ids = rows[key].to_pylist()
        low = -(1 << 63)
        self.ids = np.array([low if i is None else i for i in ids], dtype=np.int64)
        known, rank = np.unique(self.ids, return_inverse=True)
        self.known, self.rank, self.window, self.rows = known, rank, window, rows
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        self.n_words, base, row = np.zeros(len(ids), dtype=np.int64), 0, 0
        for part in slices(rows, column, 2 << 20):
            words = split(part[column], seeds=(1, 2) if second else (1,))
            starts, first = words.windows(window, 11)
            doc = np.searchsorted(words.first, starts, "right") - 1
            found[0].append(first)
            if second:
                found[1].append(words.windows(window, 12, 1)[1])
            found[2].append(base + starts)
            found[3].append(row + doc)
            found[4].append(starts - words.first[doc])
            self.n_words[row : row + part.num_rows] = words.per_doc()
            base, row = base + len(words), row + part.num_rows
        joined = [np.concatenate(f) if f else np.zeros(0, dtype=np.int64) for f in found]
        self.first, self.second, self.word, self.doc, start = joined
        self.total = base
        self.order = (self.rank[self.doc].astype(np.int64) << 32) | start
        by_hash = np.argsort(self.first, kind="stable")
        ranked = self.first[by_hash]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, dtype=np.int64)
        self.distinct = ranked[heads].astype(np.uint64)
        self.uses = np.diff(np.append(heads, len(ranked)))
        self.of = np.empty(len(ranked), dtype=np.int64)
        self.of[by_hash] = np.repeat(np.arange(len(heads)), self.uses)
        self.earliest = np.minimum.reduceat(self.order[by_hash], heads) if len(heads) else heads
        self._by_hash, self._heads = by_hash, heads

    def cells(self, row: int, bits: int) -> np.ndarray:
        return mix(self.distinct ^ _SALTS[row]) >> _U(64 - bits)

    def sketch(self, depth: int, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row, range, cells in rising order, which were counted more than once)."""
        for row in range(depth):
            cells = self.cells(row, bits)
            by_cell = np.argsort(cells, kind="stable")
            ranked = cells[by_cell]
            heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, dtype=np.int64)
            counts = np.add.reduceat(self.uses[by_cell], heads) if len(heads) else heads
            unique = ranked[heads]
            ranges = (unique >> _U(RANGE_BITS)).astype(np.int64)
            for k in np.unique(ranges):
                a, b = np.searchsorted(ranges, [k, k + 1])
                yield row, int(k), unique[a:b] - (_U(k) << _U(RANGE_BITS)), counts[a:b] > 1

    def repeated(self, answers: dict[tuple[int, int], np.ndarray], depth: int, bits: int) -> np.ndarray:
        """Which distinct windows the merged sketch estimates at more than one."""
        out = np.ones(len(self.distinct), dtype=bool)
        for row in range(depth):
            cells = self.cells(row, bits)
            unique, at = np.unique(cells, return_inverse=True)
            ranges = (unique >> _U(RANGE_BITS)).astype(np.int64)
            flags = [answers[row, int(k)][: np.count_nonzero(ranges == k)] for k in np.unique(ranges)]
            out &= np.concatenate(flags)[at] if flags else out
        return out

    def once(self) -> np.ndarray:
        """A window of each distinct hash that its earliest document holds."""
        late = self.order[self._by_hash] != np.repeat(self.earliest, self.uses)
        return self._by_hash[self._heads + np.minimum.reduceat(np.where(late, 1 << 40, np.arange(len(late)) - np.repeat(self._heads, self.uses)), self._heads)]

    def removed(self, mine: np.ndarray) -> np.ndarray:
        """Which words go. ``mine``: whether this block holds the first of each distinct window."""
        late = ~mine[self.of] | (self.order > self.earliest[self.of])
        change = np.zeros(self.total + self.window + 1, dtype=np.int64)
        np.add.at(change, self.word[late], 1)
        np.add.at(change, self.word[late] + self.window, -1)
        return np.cumsum(change)[: self.total] > 0


_SENT = "step int, part long, _block long, n long, a binary, b binary, c binary"
_SAID = "step int, part long, _block long, bits binary"


def _bits(flags: np.ndarray) -> bytes:
    return pa.compress(np.packbits(flags).tobytes(), codec="zstd", asbytes=True) + len(flags).to_bytes(8, "little")


def _flags(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-8:], "little")
    raw = pa.decompress(data[:-8], -(-n // 8), codec="zstd", asbytes=True)
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def _table(ddl_names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=ddl_names)


def _sent(rows: list[tuple]) -> pa.Table:
    return _table(["step", "part", "_block", "n", "a", "b", "c"], rows, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3])


def _said(rows: list[tuple]) -> pa.Table:
    return _table(["step", "part", "_block", "bits"], rows, [pa.int32(), pa.int64(), pa.int64(), pa.binary()])


def count_cells(rows: pa.Table, column: str, window: int, depth: int, bits: int) -> pa.Table:
    """A block's sketch, one row for each row and range of cells."""
    block = rows["_block"][0].as_py()
    held = Block(rows, column, window)
    return _sent([(r, k, block, len(c), pack(c, True), _bits(more), None) for r, k, c, more in held.sketch(depth, bits)])


def merge_cells(rows: pa.Table) -> pa.Table:
    """Adds up one range of cells over all blocks; tells each block which of its cells hold more than one."""
    counts, parts = np.zeros(1 << RANGE_BITS, dtype=np.uint8), rows.to_pylist()
    for r in parts:
        cells = unpack(r["a"], r["n"], True)
        counts[cells] = np.minimum(counts[cells] + 1 + _flags(r["b"]), 2)
    return _said([(r["step"], r["part"], r["_block"], _bits(counts[unpack(r["a"], r["n"], True)] > 1)) for r in parts])


def _answers(said: pa.Table, steps: range) -> dict[tuple[int, int], np.ndarray]:
    return {(r["step"], r["part"]): _flags(r["bits"]) for r in said.to_pylist() if r["step"] in steps}


def send_repeated(rows: pa.Table, said: pa.Table, column: str, window: int, depth: int, bits: int, parts: int) -> pa.Table:
    """The block's windows that may be repeated: both hashes and the earliest document, by range of the first hash."""
    if not rows.num_rows:
        return _sent([])
    block = rows["_block"][0].as_py()
    held = Block(rows, column, window, second=True)
    if not len(held.distinct):
        return _sent([])
    chosen = np.flatnonzero(held.repeated(_answers(said, range(depth)), depth, bits))
    first, second = held.distinct[chosen], held.second[held.once()[chosen]]
    doc = held.known[held.earliest[chosen] >> 32].view(np.uint64)
    part = ((first >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    out = []
    for k in np.unique(part):
        a, b = np.searchsorted(part, [k, k + 1])
        out.append((depth, int(k), block, int(b - a), pack(first[a:b], True), pack(second[a:b]), pack(doc[a:b])))
    return _sent(out)


def group_windows(rows: pa.Table) -> pa.Table:
    """Exact groups of equal windows; tells each block which of its windows no other block holds earlier."""
    parts = rows.to_pylist()
    first = np.concatenate([unpack(r["a"], r["n"], True) for r in parts])
    second = np.concatenate([unpack(r["b"], r["n"]) for r in parts])
    doc = np.concatenate([unpack(r["c"], r["n"]) for r in parts]).view(np.int64)
    order = np.argsort(first, kind="stable")
    same = (first[order][1:] == first[order][:-1])
    if (second[order][1:] != second[order][:-1])[same].any():
        order = np.lexsort((second, first))
        same = first[order][1:] == first[order][:-1]
    heads = np.flatnonzero(np.concatenate(([True], ~(same & (second[order][1:] == second[order][:-1])))))
    least = np.repeat(np.minimum.reduceat(doc[order], heads), np.diff(np.append(heads, len(order))))
    mine = np.empty(len(order), dtype=bool)
    mine[order] = doc[order] == least
    out, at = [], 0
    for r in parts:
        out.append((r["step"], r["part"], r["_block"], _bits(mine[at : at + r["n"]])))
        at += r["n"]
    return _said(out)


def finish(rows: pa.Table, said: pa.Table, column: str, window: int, depth: int, bits: int, names: list[str]) -> pa.Table:
    """The block's documents with their kept words."""
    held = Block(rows, column, window)
    mine = np.ones(len(held.distinct), dtype=bool)
    if len(held.distinct):
        chosen = np.flatnonzero(held.repeated(_answers(said, range(depth)), depth, bits))
        told = _answers(said, range(depth, depth + 1))
        if len(chosen):
            mine[chosen] = np.concatenate([told[k] for k in sorted(told)])
    gone = held.removed(mine)
    ends = np.cumsum(held.n_words)
    begins = ends - held.n_words
    sums = np.concatenate(([0], np.cumsum(gone)))
    n_removed = sums[ends] - sums[begins]
    kept = []
    for text, a, b, n in zip(rows[column].to_pylist(), begins.tolist(), ends.tolist(), n_removed.tolist()):
        words = text.encode("utf-8").split() if text else []
        if n:
            words = [w for w, g in zip(words, gone[a:b].tolist()) if not g]
        kept.append(b" ".join(words).decode("utf-8"))
    return pa.table(
        [rows[c] for c in names] + [pa.array(held.n_words), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
        names=[*names, "n_words", "n_removed", "kept"],
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept`` (kept words joined by one space) to documents."""
    spark = docs.sparkSession
    ship(spark)
    total = text_bytes(docs, column)
    blocks = pieces(total, block_bytes)
    bits = max(RANGE_BITS, int(np.ceil(np.log2(max(2, CELLS_PER_WINDOW * total / 6)))))
    parts = pieces(total // 6, GROUPED)
    kept = docs.drop("_doc", "_block", "n_words", "n_removed", "kept")
    names = kept.columns
    dealt = kept.withColumns({
        "_doc": F.col(doc_id).cast("long"), "_block": F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(blocks)),
    }).repartition(blocks, "_block")
    run: Callable = functools.partial
    sketched = dealt.groupBy("_block").applyInArrow(
        _wrap(run(count_cells, column=column, window=window, depth=DEPTH, bits=bits), 1), _SENT
    )
    merged = sketched.groupBy("step", "part").applyInArrow(_wrap(merge_cells, 1), _SAID)
    sent = dealt.groupBy("_block").cogroup(merged.groupBy("_block")).applyInArrow(
        _wrap(run(send_repeated, column=column, window=window, depth=DEPTH, bits=bits, parts=parts), 2), _SENT
    )
    told = sent.groupBy("step", "part").applyInArrow(_wrap(group_windows, 1), _SAID)
    return dealt.groupBy("_block").cogroup(merged.unionAll(told).groupBy("_block")).applyInArrow(
        _wrap(run(finish, column=column, window=window, depth=DEPTH, bits=bits, names=names), 2),
        extended(kept, "n_words long, n_removed long, kept string"),
    )


def _wrap(fn: Callable, tables: int) -> Callable:
    """Spark reads the number of tables from the signature."""
    if tables == 1:
        return lambda rows: fn(rows)
    return lambda left, right: fn(left, right)
