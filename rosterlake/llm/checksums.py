"""CRC-32 of words and of runs of words, for whole slices of text at a time.

A CRC-32 is linear over bits, so a word's is the exclusive or of what each byte adds at its distance from the word's end, and
a run's follows from those of its words: moving a checksum past ``n`` further bytes is a fixed map of its four bytes.
"""

from __future__ import annotations

import zlib

import numpy as np

from rosterlake.llm.words import Words

#: Words up to this many bytes are read through tables, longer ones by zlib.
WIDE = 64
#: Bytes of text whose words are read at a time.
STRETCH = 1 << 20
_POLYNOMIAL = np.uint32(0xEDB88320)


def _one_byte() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ _POLYNOMIAL, x >> 1)
    return x


_BYTE = _one_byte()


def _past_a_zero(x: np.ndarray) -> np.ndarray:
    return (x >> 8) ^ _BYTE[x & 0xFF]


def _repeated(x: np.ndarray, times: int) -> np.ndarray:
    out = [x]
    for _ in range(times):
        out.append(_past_a_zero(out[-1]))
    return np.stack(out)


#: What a byte adds when so many bytes follow it, and what each byte of a checksum becomes past so many bytes.
_ADDED = _repeated(_BYTE, WIDE)
_MOVED = _repeated(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None], WIDE + 1)
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(WIDE + 2)], dtype=np.uint32)


def moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums moved past ``by`` bytes, at most ``WIDE + 1`` each."""
    table = _MOVED.reshape(-1)
    base = by.astype(np.int64) * 1024
    out = table[base + (x & 0xFF)]
    for k in (1, 2, 3):
        out ^= table[base + 256 * k + ((x >> (8 * k)) & 0xFF)]
    return out


def of_words(words: Words) -> np.ndarray:
    """The checksum of every word."""
    out = np.zeros(len(words), dtype=np.uint32)
    lengths = words.ends - words.starts
    begin = 0
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(words.ends, words.starts[begin] + STRETCH, side="right")))
        short = begin + np.flatnonzero(lengths[begin:end] <= WIDE)
        sizes = lengths[short]
        if len(short):
            heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
            byte = words.raw[np.repeat(words.starts[short], sizes) + place]
            follow = np.repeat(sizes, sizes) - 1 - place
            out[short] = np.bitwise_xor.reduceat(_ADDED[follow, byte], heads) ^ _ZEROS[sizes]
        begin = end
    for i in np.flatnonzero(lengths > WIDE):
        out[i] = zlib.crc32(words.raw[words.starts[i] : words.ends[i]])
    return out


def of_runs(words: Words, longest: int) -> list[np.ndarray]:
    """For 1 to ``longest`` words: the checksum of the run that starts at each word, joined by one space. Runs that
    would leave their document have to be passed over by the caller (``inside``)."""
    single = of_words(words)
    lengths = words.ends - words.starts
    runs, wide = [single], np.flatnonzero(lengths > WIDE)
    spaced = np.minimum(lengths, WIDE)
    follow = moved(np.full(len(words), zlib.crc32(b" "), dtype=np.uint32), spaced) ^ single
    for n in range(1, longest):
        if len(words) <= n:
            runs.append(np.zeros(0, dtype=np.uint32))
            continue
        before = runs[-1][: len(words) - n]
        run = moved(before, spaced[n:] + 1) ^ follow[n:]
        for i in wide[wide >= n]:
            run[i - n] = zlib.crc32(words.raw[words.starts[i] : words.ends[i]], zlib.crc32(b" ", int(before[i - n])))
        runs.append(run)
    return runs


def inside(words: Words, n: int) -> np.ndarray:
    """Whether the run of ``n`` words from each word stays in its document, for the words that ``of_runs`` has a run for."""
    last = np.repeat(words.first[1:], words.per_doc())
    return np.arange(n, len(words) + 1) <= last[: max(0, len(words) - n + 1)]
