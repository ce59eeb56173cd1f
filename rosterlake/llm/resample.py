"""Documents drawn so that they look like a target: importance weights over hashed features, ranked by radix sort.

A text's features are its runs of 1 to 3 words, each hashed into a bucket by CRC-32. What a bucket occurs more often in the
target than in the documents is its gain; a text's weight is the sum of its gains, looked up in one array. Noise of the
Gumbel kind, fixed by the doc_id, turns the highest scores into a draw without replacement. The ranks come from ``radix``.

A-Z are read as a-z; a word is a run of letters a-z, digits and whatever is not ASCII. A null text has no words, weight 0
and rank null, and so has an empty one. A null doc_id draws its noise from the empty text and comes first among ties. Rows
that share a doc_id share their noise and are ranked each on their own: by score, doc_id, then fewer features. Texts with
fewer words than ``least_words`` get a weight and a score but are not drawn. Without a target all gains fall with the
documents' own counts; an empty table gives an empty one. Columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import checksums
from rosterlake.llm.radix import ranks
from rosterlake.llm.runtime import extended, ship, written
from rosterlake.llm.words import ALNUM, slices, split

BUCKETS = 10_000
LONGEST_RUN = 3
#: Share of the documents that is drawn, and the words a document needs to be drawn.
PERCENT, LEAST_WORDS = 5, 20
SEED = "42"
ADDED = ("n_words", "n_features", "weight", "score", "rank")


def buckets(texts: pa.Array) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The index of each text's first word, one more at the end, and for each length of a run the words at which a run
    starts and the runs' buckets."""
    words = split(texts, ALNUM, lower=True, seeds=())
    runs = checksums.of_runs(words, LONGEST_RUN)

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n, run in enumerate(runs, 1):
            at = np.flatnonzero(checksums.inside(words, n))
            yield at, run[at] % np.uint32(BUCKETS)

    return words.first, each()


def bucket_counts(docs: DataFrame, column: str = "text") -> np.ndarray:
    """How often each bucket occurs in the whole table. One row a bucket reaches the driver."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, column):
                for _, found in buckets(part[column])[1]:
                    total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in docs.select(column).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the logarithm of the ratio of both smoothed shares, rounded down."""
    s_all, t_all = int(documents.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(s_all + BUCKETS) / (float(s + 1) * float(t_all + BUCKETS))))
        for s, t in zip(documents.tolist(), target.tolist())
    ], dtype=np.int64)


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """A thousand times a Gumbel draw that the id fixes, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, column: str = "text", seed: str = SEED) -> DataFrame:
    """The columns but the text, with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in docs.columns if c not in (column, *ADDED)]
    schema = extended(docs.select(*kept), "n_words long, n_features long, weight long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            for part in slices(batch, column):
                first, found = buckets(part[column])
                at_word, n_features = np.zeros(first[-1] + 1, dtype=np.int64), np.zeros(part.num_rows, dtype=np.int64)
                for n, (at, bucket) in enumerate(found):
                    at_word[at] += gain[bucket]
                    n_features += np.maximum(np.diff(first) - n, 0)
                so_far = np.concatenate(([0], np.cumsum(at_word)))
                weight = so_far[first[1:]] - so_far[first[:-1]]
                score = weight + np.array([noise(i, seed) for i in part["doc_id"].to_pylist()], dtype=np.int64)
                new = [pa.array(x.astype(np.int64)) for x in (np.diff(first), n_features, weight, score)]
                yield pa.RecordBatch.from_arrays([part[c] for c in kept] + new, names=[*kept, *ADDED[:4]])

    return docs.select(*kept, column).mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, column: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED,
) -> DataFrame:
    """The columns but the text of every document, with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``: from 1
    for the drawn ``percent`` of those with ``least_words`` words, null for the others. ``target`` needs the same text column."""
    gain = gains(bucket_counts(docs, column), bucket_counts(target, column))
    scored = weighed(docs.drop("_row"), gain, column, seed).withColumn("_row", F.monotonically_increasing_id())
    rows = written(scored, "weights")
    able = rows.filter(F.col("n_words") >= least_words)
    n_drawn = percent * able.count() // 100
    order = ranks(able, "_row", [("score", True), ("doc_id", False), ("n_features", False)])
    return rows.join(order.filter(F.col("rank") <= n_drawn), "_row", "left").drop("_row")
