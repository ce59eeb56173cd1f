"""Byte-level BPE in linear time: Aho-Corasick matches, longest first, with backtracking over pairs that cannot stand together.

A segmentation is the one that merging by rank would give exactly when every two neighbours can stand together, so the
longest match is taken at each place, and given up for a shorter one only when it does not fit its left neighbour.
Bytes are mapped to Latin-1 characters, which is what the automaton reads.

Null and empty texts give no tokens. A very long match of the pattern costs time in proportion to its length.
Repeated rows are encoded each on their own. Other columns are kept as they are.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rosterlake.llm.runtime import extended, ship
from rosterlake.llm.words import slices

#: Distinct matches, and distinct cuts, whose ids a worker remembers; beyond it those not met for longest are forgotten.
REMEMBERED = 300_000


#: No match of the usual byte-level patterns reaches over a single space between two characters that aren't white space:
#: a match takes such a space only as its first character. Texts are cut there, and whole cuts are remembered.
CUT = r"(?<=\S) (?=\S)"


class Memory:
    """Ids by text, in two halves: what is met again moves to the newer one, and when that is full the older one is dropped."""

    def __init__(self):
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        ids = self.newer.get(key)
        if ids is None:
            ids = self.older.get(key)
            if ids is not None:
                self.put(key, ids)
        return ids

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= 64:
            if len(self.newer) >= REMEMBERED // 2:
                self.older, self.newer = self.newer, {}
            self.newer[key] = ids


class Encoder:
    """Ranks from a file of ``base64-token rank`` lines."""

    def __init__(self, path: str, pattern: str, cut: str | None = CUT):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(number) for token, number in pairs}
        self.token = {number: token for token, number in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.cut = re.compile(cut) if cut else None
        self.halves = {number: self._last_merge(token) for token, number in self.rank.items()}
        self.rank = {t: n for t, n in self.rank.items() if self.halves[n] is not None}
        self.shorter = {n: next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), None) for t, n in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, number in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (number, len(token) - 1))
        self.automaton.make_automaton()
        self.size = {number: len(token) for number, token in self.token.items()}
        self._fits: dict[int, bool] = {}  # by left << 32 | right
        self._known, self._cuts = Memory(), Memory()
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge ends in this one: itself twice for a byte, none if merging never gets there."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            at = int(np.argmin(ranks))
            if ranks[at] == np.inf:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if any(p not in self.rank for p in parts):
            return None
        return self.rank[parts[0]], self.rank[parts[-1]]

    def _edge(self, number: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge while this one is built, each with the rank of the merge that ends it."""
        out, until = [], np.inf
        while True:
            out.append((number, until))
            half = self.halves[number][side]
            if half == number:
                return out
            number, until = half, number

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes leaves these two tokens apart."""
        known = self._fits.get(left << 32 | right)
        if known is None:
            a = self._right.get(left)
            if a is None:
                a = self._right[left] = self._edge(left, 1)
            b = self._left.get(right)
            if b is None:
                b = self._left[right] = self._edge(right, 0)
            known = self._fits[left << 32 | right] = not any(self._crosses(x, y) for x in a for y in b)
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
        return known

    def _crosses(self, x: tuple[int, float], y: tuple[int, float]) -> bool:
        """Whether two edge tokens merge before either is merged away; of equal ranks the left pair goes first."""
        merged = self.rank.get(self.token[x[0]] + self.token[y[0]])
        return merged is not None and merged < x[1] and merged <= y[1]

    def encode_match(self, match: str) -> list[int]:
        data = match.encode("utf-8")
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        longest = [0] * len(data)
        for end, (number, before) in self.automaton.iter(data.decode("latin-1")):
            longest[end - before] = number  # ends come in order, so the last one stored is the longest
        out: list[int] = []
        size, shorter, known, fits = self.size, self.shorter, self._fits, self.fits
        at, dead, until = 0, set(), len(data)
        number, left = longest[0], None
        while True:
            end = at + size[number]
            if left is None:
                good = True
            else:
                good = known.get(left << 32 | number)
                if good is None:
                    good = fits(left, number)
            if good and end not in dead:
                out.append(number)
                if end == until:
                    return out
                at, left, number = end, number, longest[end]
                continue
            while (less := shorter[number]) is None:
                dead.add(at)
                number = out.pop()
                at -= size[number]
            number, left = less, out[-1] if out else None

    def _matches(self, text: str) -> bytes:
        return self._joined(self.pattern.findall(text))

    def _joined(self, matches: list[str]) -> bytes:
        known = self._known
        if len(matches) == 1:  # its cut is remembered, so it need not be
            return known.get(matches[0]) or self._packed(matches[0])
        found = []
        for match in matches:
            ids = known.get(match)
            if ids is None:
                ids = self._packed(match)
                known.put(match, ids)
            found.append(ids)
        return b"".join(found)

    def _packed(self, match: str) -> bytes:
        ids = self.encode_match(match)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of cuts, each with the space before it, by one search: a match that begins with a space begins a cut."""
        cuts: list[list[str]] = []
        for match in self.pattern.findall(" " + " ".join(words)):
            if match[0] == " ":
                cuts.append([match])
            else:
                cuts[-1].append(match)
        out = {}
        for word, matches in zip(words, cuts, strict=True):
            out[word] = ids = self._joined(matches)
            self._cuts.put(word, ids)
        return out

    def _words(self, text: str) -> bytes:
        """The same as cutting at ``CUT``, by a plain split: words with white space at an edge, or without characters, stay
        with the neighbour beyond it."""
        words = text.split(" ")
        found = list(map(self._cuts.newer.get, words))
        found[0] = None
        new, edged, glued = [], [], set()  # places of unknown words, of edged ones, and of words that stay with the one before
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                if i and (ids := self._cuts.get(word)) is not None:
                    found[i] = ids
                    continue
                first = not word or word[0].isspace()
                last = not word or word[-1].isspace()
                if first:
                    glued.add(i)
                if last:
                    glued.add(i + 1)
                if i:
                    (edged if first or last else new).append(i)
        if new:
            known = self._new(list(dict.fromkeys(words[i] for i in new)))
            for i in new:
                found[i] = known[words[i]]
        glued -= {0, len(words)}
        for i in sorted(glued):
            if i - 1 in glued:
                continue
            end = i + 1
            while end in glued:
                end += 1
            run = " ".join(words[i - 1 : end])
            found[i - 1 : end] = [self._matches(" " + run if i > 1 else run)] + [b""] * (end - i)
        if found[0] is None:
            found[0] = self._matches(words[0])
        for i in edged:
            if found[i] is None:
                found[i] = self._matches(" " + words[i])
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None:
            return self._matches(text)
        if self.cut.pattern == CUT:
            return self._words(text)
        first, *rest = self.cut.split(text)
        return b"".join([self._matches(first), *(self._matches(" " + part) for part in rest)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str, cut: str | None) -> Encoder:
    return Encoder(path, pattern, cut)


def encode(
    docs: DataFrame, path: str, pattern: str, column: str = "text", decode: bool = False, cut: str | None = CUT,
) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (binary, four bytes an id, little-endian), and with ``decode`` the bytes the ids
    stand for as ``decoded``. ``path`` is read where the tasks run, so the file must be installed on every machine."""
    ship(docs.sparkSession)
    added = ["n_tokens", "ids", "decoded"][: 3 if decode else 2]
    kept = [c for c in docs.columns if c not in added]
    schema = extended(docs.select(*kept), "n_tokens long, ids binary" + ", decoded binary" * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern, cut)
        pa.default_memory_pool().release_unused()  # a worker that ran another operator before keeps its buffers otherwise
        for batch in batches:
            for part in slices(batch, column, 1 << 20):
                ids = [coder.encode(text) if text else b"" for text in part[column].to_pylist()]
                new = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    new.append(pa.array([coder.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([part[c] for c in kept] + new, names=[*kept, *added])

    return docs.select(*kept).mapInArrow(run, schema)
