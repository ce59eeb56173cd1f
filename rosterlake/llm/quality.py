"""Quality of whole texts by histogram gradient-boosted trees over document statistics.

Every text becomes a row of ``NAMES``: shares of kinds of characters and words, repetition of words, word pairs and lines,
lengths. Boosted trees over histograms of at most ``BINS`` bins a statistic are fitted to labelled texts, a bounded sample of
``SAMPLE_ROWS``. The trees are then laid out in five flat arrays, and all rows of a batch walk all trees level by level in numpy,
in the same pass that computes the statistics, so a table is read once and nothing but scores leaves a task.

A null text and an empty one have the statistics of no words, and a score like any other. Labels other than 0 and 1 count as
none; a doc_id labelled twice counts with both labels. Without labels of both kinds every score is the share of label 1,
a half without any. Rows that share a doc_id are scored each on their own. Columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.runtime import extended, ship, written
from rosterlake.llm.words import SPACED, Words, flat, slices, split

#: Labelled texts that the fit uses at most (expected number, by a hash of their doc_id).
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, STEP = 30, 4, 64, 0.2
#: Score from which a text counts as good.
GOOD = 0.7

#: Kinds of bytes; the first four by their range, the others by what they hold, 0 for the rest.
_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256),
          "space": b"\t\n\v\f\r ", "stop": b".,;:", "shout": b"!?", "bar": b"|/\\", "quote": b"\"'()[]{}<>", "symbol": b"#$%&*@^~=+_`-"}
_KIND = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate(_KINDS.values(), 1):
    _KIND[list(_bytes)] = _k

NAMES = (
    "log_bytes", "log_words", "log_lines", "upper_share", "digit_share", "wide_share", "space_share",
    "stops_a_word", "shouts_a_word", "bars_a_word", "quotes_a_word", "symbols_a_word", "word_length", "log_longest_word",
    "short_words", "shouted_words", "distinct_words", "commonest_word", "repeated_words", "distinct_pairs", "words_a_line", "distinct_lines",
)
_STRETCH = 1 << 20


def _by_kind(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each kind (columns) in each text (rows)."""
    width, n = len(_KINDS) + 1, len(offsets) - 1
    out = np.zeros(n * width, dtype=np.int64)
    for begin in range(0, len(raw), _STRETCH):
        part = raw[begin : begin + _STRETCH]
        doc = np.searchsorted(offsets, np.arange(begin, begin + len(part)), side="right") - 1
        out += np.bincount(doc * width + _KIND[part], minlength=n * width)
    return out.reshape(n, width)


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of different values and how often its commonest one occurs."""
    most = np.zeros(n, dtype=np.int64)
    if not len(doc):
        return most, most
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    heads = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))))
    np.maximum.at(most, doc[heads], np.diff(np.append(heads, len(doc))))
    return np.bincount(doc[heads], minlength=n), most


def _sums(words: Words, value: np.ndarray) -> np.ndarray:
    so_far = np.concatenate(([0], np.cumsum(value)))
    return so_far[words.first[1:]] - so_far[words.first[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    raw, offsets = flat(texts)
    words, lines = split(texts, SPACED), split(texts, _NOT_A_LINE_FEED)
    n, n_words, n_lines = len(offsets) - 1, words.per_doc(), lines.per_doc()
    kinds, size = _by_kind(raw, offsets), np.diff(offsets)
    count = {name: kinds[:, k] for k, name in enumerate(_KINDS, 1)}
    a_word, a_line, a_byte = np.maximum(n_words, 1), np.maximum(n_lines, 1), np.maximum(size, 1)
    length = words.ends - words.starts
    uppers = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90), dtype=np.int32)))
    shouted = (length > 1) & (2 * (uppers[words.ends] - uppers[words.starts]) > length)
    hashes, of = words.hashes[0], np.repeat(np.arange(n), n_words)
    different, commonest = _distinct(of, hashes, n)
    neighbours = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, dtype=np.int64)
    same = np.zeros(len(of), dtype=bool)
    same[neighbours + 1] = hashes[neighbours] == hashes[neighbours + 1]
    at, pair = words.windows(2, seed=3)
    pairs, _ = _distinct(of[at], pair, n)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, of, length)
    different_lines, _ = _distinct(np.repeat(np.arange(n), n_lines), lines.hashes[0], n)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), count["upper"] / letters, count["digit"] / a_byte, count["wide"] / a_byte, count["space"] / a_byte,
        count["stop"] / a_word, count["shout"] / a_word, count["bar"] / a_word, count["quote"] / a_word, count["symbol"] / a_word, _sums(words, length) / a_word, np.log1p(longest),
        _sums(words, length <= 3) / a_word, _sums(words, shouted) / a_word, different / a_word, commonest / a_word, _sums(words, same) / a_word, pairs / np.maximum(n_words - 1, 1), n_words / a_line, different_lines / a_line,
    ])


_NOT_A_LINE_FEED = np.ones(256, dtype=bool)
_NOT_A_LINE_FEED[10] = False


class Trees:
    """Trees in flat arrays: at node i a row goes to ``left[i]`` if its ``feature[i]`` is at most ``threshold[i]``, else to
    ``right[i]``; a leaf leads to itself and adds ``value[i]``. Without trees every score is ``share``."""

    def __init__(self, roots: list[int], feature: list[int], threshold: list[float], left: list[int], right: list[int], value: list[float], depth: int, share: float = 0.5):
        self.roots, self.feature, self.left, self.right = (np.array(x, dtype=np.int64) for x in (roots, feature, left, right))
        self.threshold, self.value = np.array(threshold, dtype=float), np.array(value, dtype=float)
        self.depth, self.share = depth, share

    @classmethod
    def constant(cls, share: float) -> "Trees":
        return cls([], [], [], [], [], [], 0, share)

    @classmethod
    def flattened(cls, model: GBTClassificationModel) -> "Trees":
        """From the printed form of each tree, whose lines stand in the order of a walk that goes left first."""
        roots, feature, threshold, left, right, value = [], [], [], [], [], []

        def add(lines: Iterator[str], weight: float) -> int:
            line, here = next(lines), len(feature)
            for array, start in zip((feature, threshold, left, right, value), (0, 0.0, here, here, 0.0)):
                array.append(start)
            if line.startswith("Predict:"):
                value[here] = weight * float(line.split(":")[1])
                return here
            words = line.strip("If ()").split()  # feature 3 <= 0.25
            feature[here], threshold[here] = int(words[1]), float(words[3])
            left[here] = add(lines, weight)
            assert next(lines).startswith("Else")
            right[here] = add(lines, weight)
            return here

        for tree, weight in zip(model.trees, model.treeWeights):
            roots.append(add((line.strip() for line in tree.toDebugString.splitlines()[1:] if line.strip()), weight))
        return cls(roots, feature, threshold, left, right, value, max(t.depth for t in model.trees))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(rows), self.share)
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        row = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1.0 / (1.0 + np.exp(-2.0 * self.value[at].sum(axis=1)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are not learned from: a quarter, by checksum of the id as text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, usable: Column, column: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(features, label) of about ``sample_rows`` labelled texts. Only drawn texts meet their labels in a shuffle."""
    ship(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isin(0, 1)).filter(usable).distinct()
    scale = 1 << 30
    share = int(min(1.0, sample_rows / max(1, known.count())) * scale)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share
    texts = docs.select("doc_id", F.col(column).alias("text")).filter(usable & drawn).join(known.filter(drawn), "doc_id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = pa.array(list(statistics(part["text"])), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part["label"].cast(pa.float64()), rows], names=["label", "features"])

    rows = written(texts.mapInArrow(run, "label double, features array<double>"), "statistics")
    n = rows.count()
    if n > 2 * sample_rows:  # ids that stand for many rows
        rows = rows.filter(F.pmod(F.xxhash64("features"), F.lit(scale)) < int(sample_rows / n * scale)).limit(2 * sample_rows)
    return rows


def fit(docs: DataFrame, labels: DataFrame, usable: Column, column: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from the labels of ``usable`` rows (a condition on doc_id)."""
    rows = sample(docs, labels, usable, column, label, sample_rows).select(array_to_vector("features").alias("vector"), "label")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Trees.constant(next(iter(counts), 0.5))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=STEP, seed=7)
    return Trees.flattened(trees.fit(rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)))


def predict(docs: DataFrame, trees: Trees, column: str = "text", good: float = GOOD) -> DataFrame:
    """All columns, with ``score`` (0 to 1) and ``predicted`` (1 from ``good`` on, else 0)."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trees)
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                score = held.value.score(statistics(part[column]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(score >= good).cast(pa.int32())], names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, extended(kept, "score double, predicted int"))
