"""Repeated runs of lines, found by winnowing over line hashes.

Every window of ``run`` consecutive lines selects the least of its line hashes, the last of equals, as its fingerprint. Two
equal runs of at least that many lines select the same positions, so a position whose fingerprint occurs once is no part of
a repetition. Only selected positions are shuffled, each once, with the windows that selected it. Positions are joined by
fingerprint; one that is shared is extended over its neighbours' line hashes, window by window, to the lines before it and
after it that occur earlier (in a smaller doc_id, or earlier in the same document). Extended matches that overlap or touch
grow together into whole runs, and these later runs are deleted.

A single line of ``long_words`` words or more selects itself too, so a paragraph between other neighbours and a copy of a
one-line text go as well. A word is what stands between white space; in scripts written without spaces two characters count
as a word. Shorter single lines stay: they recur without being copies. With ``long_words=None`` only runs count.

Lines are what stands between line feeds; lines of white space alone are passed over, and go from a text that loses others.
Lines are told apart by 128 bits. A null doc_id comes before all others. Rows that share a doc_id count as one document with
several texts: equal places are not earlier, so exact repeats of a row leave each other alone. Null texts stay null, empty
ones empty, and of texts of fewer lines than a run only long lines go. A text that loses all its lines is empty, and its row
stays. Columns named ``n_lines``, ``n_removed`` or ``runs`` are replaced, all others stay whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.llm.runtime import ship, written
from rosterlake.llm.words import SPACED, rolled, slices, split

RUN = 2
#: Words from which a single line counts as a passage of its own.
LONG_WORDS = 20
_BLANK = r"^[\x20\x09-\x0D]*$"
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WORD = regex.compile(rf"[{_UNSPACED}]{{1,2}}|[^\x20\x09-\x0D{_UNSPACED}]+")
_IN_LINE = np.ones(256, dtype=bool)
_IN_LINE[10] = False
#: Scripts without spaces begin at U+0E00, in bytes of UTF-8 from here on.
_MAY_LACK_SPACES = 0xE0
POSITIONS = "doc_id {0}, version long, place int, fingerprint long, windows array<struct<start:int,size:int,a:long,b:long>>"


def lines(column: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(F.col(column), F.lit("")), "\n", -1), lambda x: ~x.rlike(_BLANK))


class Lines:
    """The lines of a slice of texts that are not blank: hashes, the text of each, and its number in it."""

    def __init__(self, texts: pa.Array, long_words: int | None):
        found = split(texts, _IN_LINE, seeds=(1, 2))
        inked = np.concatenate(([0], np.cumsum(SPACED[found.raw])))
        kept = inked[found.ends] > inked[found.starts]
        self.h, self.g = (h[kept] for h in found.hashes)
        self.doc = np.repeat(np.arange(len(texts)), found.per_doc())[kept]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.number = np.arange(len(self.doc)) - self.first[self.doc]
        self.long = np.zeros(len(self.doc), dtype=bool)
        if long_words is not None and len(self.doc):
            self.long = self._words(found.raw, found.starts[kept], found.ends[kept]) >= long_words

    @staticmethod
    def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spaced = SPACED[raw]
        heads = spaced.copy()
        heads[1:] &= ~spaced[:-1]
        so_far = np.concatenate(([0], np.cumsum(heads)))
        wide = np.concatenate(([0], np.cumsum(raw >= _MAY_LACK_SPACES)))
        out = so_far[ends] - so_far[starts] + (spaced[starts] & ~heads[starts])  # a text may begin inside the last one's word
        for i in np.flatnonzero(wide[ends] > wide[starts]):
            out[i] = sum(1 for _ in _WORD.finditer(raw[starts[i] : ends[i]].tobytes().decode("utf-8")))
        return out

    def windows(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The line at which each window starts, its size, the line that it selects, and the hash of its lines twice."""
        n = len(self.doc) - run + 1
        start = np.flatnonzero(self.doc[:n] == self.doc[run - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
        place = start.copy()
        for k in range(1, run):
            place = np.where(self.h[start + k] <= self.h[place], start + k, place)
        keys = [rolled(x, run, seed=5)[start] if len(start) else np.zeros(0, dtype=np.uint64) for x in (self.h, self.g)]
        alone = np.flatnonzero(self.long) if run > 1 else start[:0]
        sizes = np.concatenate((np.full(len(start), run), np.ones(len(alone), dtype=np.int64)))
        return np.concatenate((start, alone)), sizes, np.concatenate((place, alone)), np.concatenate((keys[0], self.h[alone])), np.concatenate((keys[1], self.g[alone]))


def positions(docs: DataFrame, run: int, column: str, long_words: int | None) -> DataFrame:
    """(doc_id, version, place, fingerprint, windows): every selected line once, with the windows that selected it."""
    ship(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                found = Lines(part[column], long_words)
                start, size, place, a, b = found.windows(run)
                order = np.lexsort((size, start, place))
                start, size, place, a, b = (x[order] for x in (start, size, place, a, b))
                heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(place)), dtype=bool), place[1:] != place[:-1])))
                at = place[heads]
                each = pa.StructArray.from_arrays(
                    [pa.array(found.number[start], pa.int32()), pa.array(size, pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    names=["start", "size", "a", "b"],
                )
                windows = pa.ListArray.from_arrays(pa.array(np.append(heads, len(place)), pa.int32()), each)
                owner = pa.array(found.doc[at])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(owner), part["version"].take(owner), pa.array(found.number[at], pa.int32()), pa.array(found.h[at].view(np.int64)), windows],
                    names=["doc_id", "version", "place", "fingerprint", "windows"],
                )

    return docs.mapInArrow(find, POSITIONS.format(docs.schema["doc_id"].dataType.simpleString()))


def repeated_runs(docs: DataFrame, run: int = RUN, column: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """(doc_id, version, runs): for each text the runs of lines that occur earlier, as (start, end), end exclusive."""
    found = written(positions(docs, run, column, long_words), "positions")
    shared = found.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    joined = found.join(shared, "fingerprint").select("doc_id", "version", "place", F.explode("windows").alias("_w")).select("doc_id", "version", "place", "_w.*")
    where = F.struct("doc_id", "start")
    first = joined.groupBy("a", "b", "size").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # a shared position reaches as far to both sides as its windows occur earlier
    late = joined.join(first, ["a", "b", "size"]).filter(where > F.col("first")).groupBy("doc_id", "version", "place").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end")
    )
    in_text = W.partitionBy("doc_id", "version").orderBy("start", "place")
    reached = F.max("end").over(in_text.rowsBetween(W.unboundedPreceding, -1))
    opened = late.withColumn("_new", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int"))
    runs = opened.withColumn("_run", F.sum("_new").over(in_text)).groupBy("doc_id", "version", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    return runs.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop_repeated_lines(docs: DataFrame, run: int = RUN, column: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """Documents with repeated runs deleted from the text, and with ``n_lines``, ``n_removed`` and ``runs`` added."""
    kept = docs.drop("n_lines", "n_removed", "runs")
    of_id, of_text, in_lines, at_edges = (_free(kept, c) for c in ("_of_id", "_of_text", "_in_lines", "_at_edges"))
    source = docs.select("doc_id", F.xxhash64(column).alias("version"), F.col(column).alias("text"))
    runs = repeated_runs(source, run, "text", long_words).select(F.col("doc_id").alias(of_id), F.col("version").alias(of_text), "runs")
    joined = kept.join(runs, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64(column) == F.col(of_text)), "left")
    parted = joined.withColumns({in_lines: lines(column), "runs": F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>"))})
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col("runs"), F.array(F.struct(F.size(in_lines).alias("start"), F.lit(0).alias("end"))))
    stretches = F.transform(F.sequence(F.lit(0), F.size("runs")), lambda k: F.slice(in_lines, F.get(at_edges, k)["end"] + 1, F.get(at_edges, k + 1)["start"] - F.get(at_edges, k)["end"]))
    n_removed = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return parted.withColumn(at_edges, edges).withColumns({
        "n_lines": F.size(in_lines).cast("long"), "n_removed": n_removed,
        column: F.when(F.size("runs") > 0, F.array_join(F.flatten(stretches), "\n")).otherwise(F.col(column)),
    }).select(*kept.columns, "n_lines", "n_removed", "runs")
