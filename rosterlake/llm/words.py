"""Words of Arrow text columns as 64-bit hashes, computed for whole slices at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_U = np.uint64
#: Bytes of text whose words are hashed at a time.
_STRETCH = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _weights(n: int, seed: int) -> np.ndarray:
    """An odd weight for every position in a word."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)
    return mix(steps) | _U(1)


@dataclass
class Words:
    """``starts``/``ends``: byte ranges in ``raw``; ``first``: index of each document's first word, one more at the end."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.starts)

    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int, seed: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every run of ``size`` words inside one document."""
        h = self.hashes[which]
        if len(h) < size:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        ends = np.repeat(self.first[1:], self.per_doc())
        starts = np.flatnonzero(np.arange(size, len(h) + size) <= ends)
        return starts, rolled(h, size, seed)[starts]


def rolled(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Order-dependent hash of every ``size`` neighbours, by doubling the width."""
    base = int(_weights(1, seed)[0])
    power = lambda e: _U(pow(base, e, 1 << 64))
    out, done, step, width = None, 0, h, 1
    while True:
        if size & width:
            if out is None:
                out, done = step, width
            else:
                n = len(step) - done
                out, done = out[:n] * power(width) + step[done : done + n], done + width
        if done == size:
            return mix(out[: len(h) - size + 1])
        n = len(step) - width
        step = step[:n] * power(width) + step[width : width + n]
        width *= 2


def split(texts: pa.Array, kind: np.ndarray = SPACED, lower: bool = False, seeds: tuple[int, ...] = (1,)) -> Words:
    """Words of every text. A null has none."""
    raw, offsets = flat(texts)
    if lower:
        raw = _LOWER[raw]
    inside = kind[raw]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begin[heads] = inside[heads]
    end[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offsets)
    hashes = [np.zeros(len(starts), dtype=np.uint64) for _ in seeds]
    begin = 0
    while begin < len(starts) and seeds:  # a stretch of words at a time, so that a long text takes no more room than its words
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + _STRETCH, side="right")))
        lengths = ends[begin:end] - starts[begin:end]
        heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        value = raw[np.repeat(starts[begin:end], lengths) + place].astype(np.uint64) + _U(1)
        longest = int(lengths.max())
        for h, s in zip(hashes, seeds):
            h[begin:end] = mix(np.add.reduceat(value * _weights(longest, s)[place], heads))
        begin = end
    return Words(raw, starts, ends, first, hashes)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Cut a batch so that each part has about ``most`` bytes of text, or one row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0), dtype=np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if len(sizes):
        yield batch.slice(begin)
