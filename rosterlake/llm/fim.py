"""Fill-in-middle by a piece table: a document is a list of descriptors over buffers that never change.

Buffer 0 holds the text's bytes, the others one sentinel each. A descriptor is (buffer, start, end) in bytes. Cutting splits
the descriptor of the whole text in three, an arrangement permutes them and puts sentinels between them, and an output's
digest is taken by streaming over its descriptors, so no arranged copy has to be made for it. Restoring cuts the output at its
sentinels and applies the inverse permutation.

Units are words with the white space before them, and white space at the end of a text; two cuts are drawn from the SHA-256 of
seed and doc_id, so a row's form does not depend on any other row or on partitions. A null text is an empty one; an empty text
and one that holds a sentinel stay plain, so sentinels in an output are always its own. A null doc_id draws as the empty
text; rows that share a doc_id share their draws, each cut over its own units. A text is read as one piece however long it
is. Columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rosterlake.llm.runtime import extended, ship
from rosterlake.llm.words import SPACED, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Share of the texts that are arranged, and of these the share that begins with the suffix.
ARRANGED_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
SEED = "42"
#: For each form the parts in output order, each behind its sentinel: 0 prefix, 1 middle, 2 suffix.
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_SENTINELS = (PREFIX, MIDDLE, SUFFIX)
#: Bytes of a text that are looked at at a time.
STRETCH = 1 << 22

Piece = tuple[int, int, int]


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """The byte at which each unit ends."""
    ends, n = [], len(raw)
    for begin in range(0, n, STRETCH):
        word = SPACED[raw[begin : begin + STRETCH + 1]]
        last = np.append(word[1:], False) if begin + STRETCH >= n else word[1:]
        ends.append(begin + 1 + np.flatnonzero(word[: len(last)] & ~last))
    found = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    return np.append(found, n) if n and not SPACED[raw[-1]] else found


def draws(doc_id: int | str | None, seed: str = SEED) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


class PieceTable:
    """Immutable buffers and the descriptors that read them in order."""

    def __init__(self, text: bytes, pieces: list[Piece] | None = None):
        self.buffers = [memoryview(text), *map(memoryview, _SENTINELS)]
        self.pieces = [(0, 0, len(text))] if pieces is None else pieces

    def split(self, at: tuple[int, ...]) -> list[Piece]:
        """The one descriptor of the text, cut at rising bytes."""
        (buffer, start, end), = self.pieces
        edges = [start, *(start + a for a in at), end]
        return [(buffer, a, b) for a, b in zip(edges, edges[1:])]

    def arranged(self, form: str, at: tuple[int, int]) -> "PieceTable":
        parts = self.split(at)
        out = PieceTable.__new__(PieceTable)
        out.buffers = self.buffers
        out.pieces = [p for k in ORDER[form] for p in ((1 + k, 0, len(_SENTINELS[k])), parts[k])]
        return out

    def restored(self, form: str) -> "PieceTable":
        """Descriptors of the text inside an output: cut behind each sentinel, put back in order."""
        whole = bytes(self.buffers[0])
        marks, parts = [], [(0, 0, 0)] * 3
        for k in ORDER[form]:
            marks.append(whole.index(_SENTINELS[k], marks[-1] if marks else 0))
        for k, begin, end in zip(ORDER[form], marks, [*marks[1:], len(whole)]):
            parts[k] = (0, begin + len(_SENTINELS[k]), end)
        return PieceTable(whole, parts)

    def chunks(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield self.buffers[buffer][start:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()

    def text(self) -> str:
        return b"".join(self.chunks()).decode("utf-8")


def code_points(raw: np.ndarray, start: int, end: int) -> int:
    return sum(int(np.count_nonzero((raw[a : min(a + STRETCH, end)] & 0xC0) != 0x80)) for a in range(start, end, STRETCH))


def cut(text: str | None, doc_id: int | str | None, seed: str = SEED) -> tuple[PieceTable, str, int, int | None, int | None]:
    """The arranged table, its form, the number of units, and the code points of prefix and middle."""
    data = (text or "").encode("utf-8")
    table, raw = PieceTable(data), np.frombuffer(data, dtype=np.uint8)
    ends = unit_ends(raw)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= ARRANGED_PERCENT or any(s in data for s in _SENTINELS):
        return table, "plain", n, None, None
    form = "spm" if h4 % 100 < SUFFIX_FIRST_PERCENT else "psm"
    at = tuple(int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return table.arranged(form, at), form, n, code_points(raw, 0, at[0]), code_points(raw, *at)


PIECES = "array<struct<buffer:int,start:long,end:long>>"
_PIECE = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def transform(docs: DataFrame, column: str = "text", seed: str = SEED, texts: bool = True) -> DataFrame:
    """All columns, with ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars``, ``pieces`` (descriptors:
    buffer 0 is the text, 1 to 3 the sentinels of prefix, middle and suffix), ``output_sha256`` and, with ``texts``,
    ``output``."""
    ship(docs.sparkSession)
    added = ["n", "form", "prefix_chars", "middle_chars", "pieces", "output_sha256", "output"][: 7 if texts else 6]
    kept = [c for c in docs.columns if c not in added]
    schema = extended(docs.select(*kept), f"n long, form string, prefix_chars long, middle_chars long, pieces {PIECES}, output_sha256 string" + ", output string" * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 4 << 20):
                found = [cut(t, i, seed) for t, i in zip(part[column].to_pylist(), part["doc_id"].to_pylist())]
                tables, forms, n, prefix, middle = zip(*found)
                described = [[dict(zip(("buffer", "start", "end"), p)) for p in t.pieces] for t in tables]
                new = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(described, pa.list_(_PIECE)), pa.array([t.sha256() for t in tables], pa.string())]
                if texts:
                    new.append(pa.array([t.text() for t in tables], pa.string()))
                yield pa.RecordBatch.from_arrays([part[c] for c in kept] + new, names=[*kept, *added])

    return docs.select(*kept).mapInArrow(run, schema)


def restore(outputs: DataFrame, column: str = "output", texts: bool = True) -> DataFrame:
    """The columns but the output, with ``restored_sha256`` and, with ``texts``, ``restored``: the text, from nothing but
    ``column`` and ``form``. Null outputs are empty ones, a null form is plain."""
    ship(outputs.sparkSession)
    added = ["restored_sha256", "restored"][: 2 if texts else 1]
    kept = [c for c in outputs.columns if c not in (column, *added)]
    schema = extended(outputs.select(*kept), "restored_sha256 string" + ", restored string" * texts)
    source = outputs.select(*kept, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 4 << 20):
                tables = []
                for output, form in zip(part[column].to_pylist(), part["form"].to_pylist()):
                    table = PieceTable((output or "").encode("utf-8"))
                    tables.append(table.restored(form) if form in ORDER else table)
                new = [pa.array([t.sha256() for t in tables], pa.string())]
                if texts:
                    new.append(pa.array([t.text() for t in tables], pa.string()))
                yield pa.RecordBatch.from_arrays([part[c] for c in kept] + new, names=[*kept, *added])

    return source.mapInArrow(run, schema)
