"""Language of whole texts by unigrams over the pieces of a fixed public vocabulary, summed over all segmentations.

Every language has a probability for each piece. A word's probability is the sum over all ways to cut it into pieces
(forward algorithm over its bytes), a text's is the product over its words, and the answer is the likeliest language.
Piece probabilities are fitted by expectation-maximisation (forward-backward) on a bounded sample of labelled texts.

A null text, and one without a letter, gets ``und`` with score 0; so does every text when nothing labelled is there to
learn from. ``in_language`` says whether the text reads like any of the languages at all: its log probability may lie below that of
the least likely text of the sample, byte for byte, by no more than ``SLACK``; noise of letters falls far below, and short texts
are given the benefit of the doubt. It is false where ``lang_pred`` is ``und``, and true for all others where nothing has been
learned. Words longer than ``LONGEST`` bytes are cut every ``LONGEST`` bytes, so long texts are read whole. Ties go to
the language that sorts first. Repeated rows are judged each on their own.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.runtime import extended, ship, written
from rosterlake.llm.words import slices

UNKNOWN = "und"
#: Labelled texts of a language that the fit uses at most (expected number, chosen by a hash of their text).
SAMPLE_ROWS = 2_000
ROUNDS = 3
#: Added to every expected count, so that no piece is impossible.
SMOOTHING = 0.1
#: How far (in nats) a text's log probability may lie below the floor of the sample.
SLACK = 100.0
LONGEST = 48
REMEMBERED = 200_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary as byte strings; a word is read with a space before it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                whole.add(model.id_to_piece(i).replace("▁", " ").encode("utf-8"))
        self.pieces = sorted(p for p in whole if 0 < len(p) <= LONGEST)
        self.index = {p: i for i, p in enumerate(self.pieces)}
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, piece in enumerate(self.pieces):
            by_length[len(piece)].append(i)
        self.tables = {}
        for length, numbers in by_length.items():
            keys = np.zeros(len(numbers), dtype=np.uint64)
            for k in range(length):
                keys = keys * _BASE + np.array([self.pieces[i][k] + 1 for i in numbers], dtype=np.uint64)
            order = np.argsort(keys)
            self.tables[length] = keys[order], np.array(numbers)[order]
        self.longest = max(by_length)

    def found(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For words of one length (rows of bytes): by piece length, the piece that begins at each byte, or one past the last."""
        n = words.shape[1]
        value = words.astype(np.uint64) + _U(1)
        keys, out = np.zeros((len(words), n + 1), dtype=np.uint64), {}
        for length in range(1, min(n, self.longest) + 1):
            keys = keys[:, : n - length + 1] * _BASE + value[:, length - 1 :]
            if length in self.tables:
                known, numbers = self.tables[length]
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out[length] = np.where(known[at] == keys, numbers[at], len(self.pieces))
        return out

    def forward(self, found: dict[int, np.ndarray], n: int, p: np.ndarray) -> np.ndarray:
        """Probability of the first j bytes, for every j (axis 0), word and language. ``p``: piece, then language."""
        count = next(iter(found.values())).shape[0]
        reach = np.zeros((n + 1, count, p.shape[1]))
        reach[0] = 1
        for j in range(1, n + 1):
            for length, numbers in found.items():
                if length <= j:
                    reach[j] += reach[j - length] * p[numbers[:, j - length]]
        return reach

    def backward(self, found: dict[int, np.ndarray], n: int, p: np.ndarray) -> np.ndarray:
        count = next(iter(found.values())).shape[0]
        rest = np.zeros((n + 1, count, p.shape[1]))
        rest[n] = 1
        for i in range(n - 1, -1, -1):
            for length, numbers in found.items():
                if i + length <= n:
                    rest[i] += p[numbers[:, i]] * rest[i + length]
        return rest

    def log_words(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """Log probability of every word (rows) in every language."""
        out = np.empty((len(words), p.shape[1]))
        for n, rows, block in _by_length(words):
            out[rows] = np.log(np.maximum(self.forward(self.found(block), n, p)[n], 1e-300))
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece in words of one language. ``p``: one column."""
        total = np.zeros(len(self.pieces) + 1)
        for n, rows, block in _by_length(words):
            found = self.found(block)
            ahead, behind = self.forward(found, n, p)[..., 0], self.backward(found, n, p)[..., 0]
            share = counts[rows] / np.maximum(ahead[n], 1e-300)
            for length, numbers in found.items():
                for i in range(n - length + 1):
                    use = ahead[i] * p[numbers[:, i], 0] * behind[i + length] * share
                    total += np.bincount(numbers[:, i], weights=use, minlength=len(total))
        return total[:-1]


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, np.frombuffer(b"".join([words[i] for i in rows]), dtype=np.uint8).reshape(len(rows), n)


def cut(text: str) -> list[bytes]:
    """A text's words, each with a space before it, as bytes."""
    out = []
    for word in text.split():
        raw = b" " + word.encode("utf-8")
        out += [raw] if len(raw) <= LONGEST else [raw[i : i + LONGEST] for i in range(0, len(raw), LONGEST)]
    return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


class Model:
    """Languages and their piece probabilities (piece, then language; a last row of zeros for what is no piece), and the
    least log probability a byte that a text of the sample has in its likeliest language."""

    def __init__(self, path: str, languages: list[str], p: np.ndarray, floor: float = -np.inf):
        self.path, self.languages, self.p, self.floor = path, languages, p, floor

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts one after another, remembering the words it has met."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, vocabulary(model.path)
        self.row: dict[bytes, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every text in every language, and the bytes of its words."""
        split = [cut(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.row})
        if len(self.row) + len(new) > REMEMBERED:
            self.row, self.logs = {}, self.logs[:0]
            new = list({w for words in split for w in words})
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.logs = np.concatenate((self.logs, self.pieces.log_words(new, self.model.p)))
        row = self.row
        logs = np.array([self.logs[[row[w] for w in words]].sum(axis=0) for words in split]).reshape(len(texts), -1)
        return logs, np.array([sum(map(len, words)) for words in split], dtype=float)


def fit(
    docs: DataFrame, path: str, usable: Column, column: str = "text", label: str = "lang",
    sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS,
) -> Model:
    """Piece probabilities from labelled texts among the ``usable`` rows. Sums per piece and language reach the driver,
    which is a size that does not grow with the table."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.filter(usable & F.col(label).isNotNull() & F.col(column).isNotNull()).select(
        F.col(label).alias("label"), F.col(column).alias("text")
    )
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    p = np.full((len(vocabulary(path).pieces) + 1, len(languages)), 1.0 / len(vocabulary(path).pieces))
    p[-1] = 0
    if not languages:
        return Model(path, [], p)
    scale = 1 << 30
    limit = F.element_at(F.create_map(*[F.lit(x) for n in languages for x in (n, min(1.0, sample_rows / counts[n]) * scale)]), F.col("label"))
    sample = written(rows.filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < limit), "language-sample")

    def uses(batches: Iterator[pa.RecordBatch], p: np.ndarray) -> Iterator[pa.RecordBatch]:
        known, total = vocabulary(path), {}
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                met: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
                for name, text in zip(part["label"].to_pylist(), part["text"].to_pylist()):
                    for word in cut(text):
                        met[name][word] += 1
                for name, words in met.items():
                    k = languages.index(name)
                    got = known.expected(list(words), np.array(list(words.values()), dtype=float), p[:, k : k + 1])
                    total[k] = total.get(k, 0) + got
        for k, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(got[at])], names=["k", "piece", "uses"])

    for _ in range(rounds):
        held = spark.sparkContext.broadcast(p)
        sums = sample.mapInArrow(lambda batches, held=held: uses(batches, held.value), "k int, piece int, uses double")
        got = np.zeros_like(p)
        for r in sums.groupBy("k", "piece").agg(F.sum("uses").alias("uses")).collect():
            got[r.piece, r.k] = r.uses
        got[:-1] += SMOOTHING
        p = got / got.sum(axis=0)
    model = spark.sparkContext.broadcast(Model(path, languages, p))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                logs, size = score(part["text"].to_pylist())
                a_byte = (logs.max(axis=1) / np.maximum(size, 1.0))[size > 0]
                yield pa.RecordBatch.from_arrays([pa.array([a_byte.min()] if len(a_byte) else [], pa.float64())], names=["least"])

    floor = sample.filter(spoken("text")).mapInArrow(least, "least double").agg(F.min("least")).first()[0]
    return Model(path, languages, p, -np.inf if floor is None else float(floor))


def spoken(column: str = "text") -> Column:
    """The text has a letter."""
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score``, the share of the likeliest language in the sum over all, and ``in_language``."""
    ship(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "in_language", "_spoken").withColumn("_spoken", spoken(column))
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, languages = held.value.scorer(), held.value.languages
        for batch in batches:
            for part in slices(batch, column, 4 << 20):
                spoken = part["_spoken"].to_pylist()
                label, share, like = [UNKNOWN] * len(spoken), [0.0] * len(spoken), spoken
                if languages:
                    logs, size = score([t if s else None for t, s in zip(part[column].to_pylist(), spoken)])
                    best = logs.argmax(axis=1)
                    odds = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    label = [languages[b] if s else UNKNOWN for b, s in zip(best, spoken)]
                    share = np.where(spoken, odds, 0.0)
                    like = np.array(spoken) & (logs.max(axis=1) >= held.value.floor * size - SLACK)
                new = [pa.array(label, pa.string()), pa.array(share, pa.float64()), pa.array(like, pa.bool_())]
                yield pa.RecordBatch.from_arrays(part.columns + new, names=[*names, "lang_pred", "score", "in_language"])

    return kept.mapInArrow(run, extended(kept, "lang_pred string, score double, in_language boolean")).drop("_spoken")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of the fit: a third, by checksum of the id as text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1
