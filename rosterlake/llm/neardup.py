"""Near-duplicate documents: a multi-index Hamming join of MinHash signatures, links confirmed on full shingle sets.

A signature has 40 positions of 21 bits, each the low bits of a minimum over the document's shingles. It is split into 10
chunks of 4. Two signatures that differ in at most ``DISTANCE`` = 19 positions have, by the pigeonhole principle, a chunk
with at most one difference; every chunk is therefore indexed four times, each time with another position left out, and
all pairs within that distance meet. (At a similarity of 0.8 the chance of a larger distance is 3 in 100,000.)

Documents with the same shingle set are one node. In each bucket of the index every node is compared with the bucket's
first node; the links found give components. Only where the nodes that share a first node still lie in several components
are the others compared, in tiles of bounded size and only across components, so a large group of copies is not paired
out, yet no link that would join two components is lost.

Documents without words, and null texts, have an empty set and are linked with nothing. Null ids take part in nothing: they
have a null component and are kept. Rows that share a doc_id are one node with several sets. Long texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.runtime import ship, written
from rosterlake.llm.words import _weights, mix, slices, split

SHINGLE = 5
PERCENT = 80
CHUNKS, WIDTH, BITS = 10, 4, 21
DISTANCE = 2 * CHUNKS - 1
#: Nodes of one side that a task compares at a time.
TILE = 1_000
#: Bits of the bitmap that says which texts are read again (2 MB, in at most 270,000 rows).
FILTER_BITS = 1 << 24
_U = np.uint64
_SEEDS = _weights(CHUNKS * WIDTH, 77)
_SIX = 6


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, rising."""
    words = split(texts, lower=True)
    starts, hashes = words.windows(shingle, 21)
    cuts = np.searchsorted(starts, words.first)
    n = words.per_doc()
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b > a:
            yield np.unique(hashes[a:b])
        elif n[i]:
            whole = np.array([n[i]], dtype=np.uint64)
            for h in words.hashes[0][words.first[i] : words.first[i + 1]]:
                whole = mix(whole * _U(0x9E3779B97F4A7C15) + h)
            yield whole
        else:
            yield np.zeros(0, dtype=np.uint64)


def _set_bytes(found: np.ndarray) -> bytes:
    """Six bytes of each hash: enough to count what two sets share."""
    return np.ascontiguousarray((found >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SIX]).tobytes()


def _of_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _SIX, 8), dtype=np.uint8)
    out[:, :_SIX] = np.frombuffer(data, dtype=np.uint8).reshape(-1, _SIX)
    return out.view("<u8").reshape(-1)


def _digest(found: np.ndarray) -> bytes:
    """128 bits that name a set."""
    sides = [mix(found ^ s).sum(dtype=np.uint64) for s in _SEEDS[:2]]
    return np.array(sides, dtype="<u8").tobytes()


def signatures(docs: DataFrame, shingle: int, column: str) -> DataFrame:
    """doc_id, n_shingles, set_key and signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                sets = list(_sets(part[column], shingle))
                sizes = np.array([len(s) for s in sets])
                sign = np.zeros((len(sets), len(_SEEDS)), dtype="<u4")
                full = np.flatnonzero(sizes)
                if len(full):
                    joined, heads = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for k, seed in enumerate(_SEEDS):
                        least = np.minimum.reduceat((joined ^ seed) * seed, heads)
                        sign[full, k] = (mix(least) & _U((1 << BITS) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(sizes, pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([r.tobytes() for r in sign], pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "sign"],
                )

    return docs.select("doc_id", column).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sign binary")


def _read_signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(len(column), len(_SEEDS))


def index_keys(nodes: DataFrame) -> DataFrame:
    """(key, id): each chunk of each signature, with each of its positions left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _read_signs(batch["sign"]).astype(np.uint64)
            for chunk in range(CHUNKS):
                for out in range(WIDTH):
                    key = np.full(len(signs), chunk * WIDTH + out, dtype=np.uint64)
                    for k in range(WIDTH):
                        if k != out:
                            key = mix(key * _U(0x9E3779B97F4A7C15) + signs[:, chunk * WIDTH + k])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch["id"]], names=["key", "id"])

    return nodes.select("id", "sign").mapInArrow(run, "key long, id long")


def _near(shared: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, set_a, set_b) those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = _of_bytes(x.as_py()), _of_bytes(y.as_py())
                good.append(bool(_near(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def tile_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links across components between the two sides of a tile, one for each two components."""
    side = np.asarray(rows["side"])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):  # a tile with itself
        right = left
    ids, comp, sizes = (np.asarray(rows[c]) for c in ("id", "comp", "n_shingles"))
    signs, sets = _read_signs(rows["sign"]), [_of_bytes(s) for s in rows["set"].to_pylist()]
    done, out = set(), []
    for i in left:
        a, b = sizes[i], sizes[right]
        other = right[(comp[right] != comp[i]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))]
        other = other[(signs[other] != signs[i]).sum(axis=1) <= DISTANCE]
        if not len(other):
            continue
        joined, n = np.concatenate([sets[j] for j in other]), np.array([len(sets[j]) for j in other])
        at = np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)
        shared = np.add.reduceat((sets[i][at] == joined).astype(np.int64), np.concatenate(([0], np.cumsum(n)[:-1])))
        for j in other[_near(shared, len(sets[i]), n, percent)]:
            both = (min(comp[i], comp[j]), max(comp[i], comp[j]))
            if both not in done:
                done.add(both)
                out.append((ids[i], ids[j]))
    return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp) for every node of (a, b): the smallest id it can reach. Labels spread to neighbours and then jump to the
    label of their label, so the number of rounds grows with the logarithm of a path's length."""
    both = written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), name)
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), name)
    while True:
        told = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("_told"))
        hooked = labels.join(told, "id").select("id", F.least("comp", "_told").alias("_new"), "comp")
        roots = hooked.select(F.col("id").alias("_new"), F.col("_new").alias("_root"))
        after = written(hooked.join(roots, "_new").select("id", F.col("_root").alias("comp"), (F.col("_root") != F.col("comp")).alias("_moved")), name)
        labels = after.select("id", "comp")
        if after.filter("_moved").isEmpty():
            return labels


def _ceil(c, n: int):
    return F.ceil(c / F.lit(float(n))).cast("int")


def near_duplicates(docs: DataFrame, column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable over links) and ``kept`` of every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), column)
    signed = written(signatures(texts, shingle, column), "signatures")
    taking = signed.filter("n_shingles > 0 and doc_id is not null")
    nodes = written(taking.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sign").alias("sign"), F.first("n_shingles").alias("n_shingles")), "nodes")

    keys = index_keys(nodes)
    pivots = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).filter("pivot <> _last").drop("_last")
    stars = written(keys.join(pivots, "key").filter("id <> pivot").select("id", "pivot").distinct(), "stars")

    involved = stars.select("id").union(stars.select("pivot")).distinct()
    taking_part = nodes.drop("n_shingles").join(involved, "id", "left_semi")
    chosen = _perhaps_in(texts.withColumnRenamed("doc_id", "id"), involved)
    sets = written(_with_sets(chosen, column, shingle).join(taking_part, ["id", "set_key"]).drop("set_key"), "sets")

    a = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"), F.col("sign").alias("sign_a"), F.col("n_shingles").alias("n_a"))
    b = a.toDF("b", "set_b", "sign_b", "n_b")
    short = sets.select("id", "sign", "n_shingles")
    close = stars.join(short, "id").join(short.toDF("pivot", "sign_b", "n_b"), "pivot").filter(
        (100 * F.least("n_shingles", "n_b") >= percent * F.greatest("n_shingles", "n_b"))
    )
    close = _within(close).select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    first = written(confirmed(close.join(b.select("b", "set_b"), "b").join(a.select("a", "set_a"), "a").select("a", "b", "set_a", "set_b"), percent).distinct(), "links")

    # several sets under one id: links between their nodes
    several = taking.groupBy("doc_id").agg(F.min("set_key").alias("_a"), F.max("set_key").alias("_b")).filter("_a <> _b").select("doc_id")
    owned = taking.join(several, "doc_id", "left_semi").join(nodes.select("set_key", "id"), "set_key").select("doc_id", "id")
    twice = owned.join(owned.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").filter("a <> id").select("a", F.col("id").alias("b"))
    first = first.union(twice)
    labels = components(first)

    # members of a pivot's family that are still apart
    family = stars.union(stars.select("pivot", "pivot").distinct()).join(labels, "id", "left").select("pivot", "id", F.coalesce("comp", "id").alias("comp"))
    per_comp = family.groupBy("pivot", "comp").agg(F.count(F.lit(1)).alias("n"))
    apart = per_comp.groupBy("pivot").agg(
        F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("n_comps")
    ).filter("n_comps > 1")
    placed = family.join(apart, "pivot").withColumns({"m": _ceil(F.col("n_main"), tile), "r": _ceil(F.col("n_all") - F.col("n_main"), tile)})
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("comp") == F.col("main"), F.col("m")).otherwise(F.col("r"))).cast("int")
    placed = placed.withColumn("t", mine)
    # tiles: of the others with each other (0, t, u), t <= u, and of the others with the main component (1, t, m)
    others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda u: F.struct(
            F.lit(0).alias("kind"), F.least("t", u).alias("x"), F.greatest("t", u).alias("y"), F.when(F.col("t") <= u, 0).otherwise(1).alias("side")
        )),
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda u: F.struct(F.lit(1).alias("kind"), F.col("t").alias("x"), u.alias("y"), F.lit(0).alias("side"))),
    )
    main = F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda u: F.struct(F.lit(1).alias("kind"), u.alias("x"), F.col("t").alias("y"), F.lit(1).alias("side")))
    tiles = placed.withColumn("_t", F.explode(F.when(F.col("comp") == F.col("main"), main).otherwise(others)))
    tiles = tiles.select("pivot", "id", "comp", "_t.*").join(sets, "id")
    fn = functools.partial(tile_links, percent=percent)
    more = tiles.groupBy("pivot", "kind", "x", "y").applyInArrow(lambda rows: fn(rows), "a long, b long")
    more = written(more.distinct(), "links")
    final = components(more.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    ))
    labels = labels.join(final.toDF("comp", "_final"), "comp", "left").select("id", F.coalesce("_final", "comp").alias("comp")).union(
        final.join(labels, "id", "left_anti").select("id", "comp")
    )
    of_set = nodes.join(labels, "id", "left").select("set_key", F.coalesce("comp", "id").alias("component_id"))
    judged = signed.join(of_set, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")), F.col("doc_id")).alias("component_id"),
    )
    return judged.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _perhaps_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is set in a bitmap of the hashed ids: all of ``ids``, and few others while the bitmap is not crowded.
    It has a fixed size, so it can be broadcast, and texts that matter to nobody are not shuffled."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    word, bit = F.floor(place / 63).cast("int"), (place % 63).cast("int")
    bitmap = ids.groupBy(word.alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(id), %d) %% 63 as int))" % FILTER_BITS)).alias("_bits"))
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bitmap), "_word")
    return marked.filter(F.expr("shiftright(_bits, _bit) & 1 = 1")).select(*rows.columns)


def _with_sets(chosen: DataFrame, column: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                sets = list(_sets(part[column], shingle))
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_bytes(s) for s in sets], pa.binary())],
                    names=["id", "set_key", "n_shingles", "set"],
                )

    return chosen.mapInArrow(run, "id long, set_key binary, n_shingles long, set binary")


def _within(pairs: DataFrame) -> DataFrame:
    """Pairs whose signatures differ in at most ``DISTANCE`` positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_read_signs(batch["sign"]) != _read_signs(batch["sign_b"])).sum(axis=1)
            yield batch.filter(pa.array(apart <= DISTANCE, pa.bool_()))

    return pairs.mapInArrow(run, pairs.schema)
