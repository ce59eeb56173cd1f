"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are grouped by the nearest of some centroids. What is left after subtracting the centroid is turned by one random
rotation and kept as a sign bit per dimension, with two correction scalars: its length, and how much of its direction the
signs keep. From these the inner product with a query is estimated without bias, and an error bound that holds but for a
chance set by ``EPSILON`` gives the least distance a vector can have. Only vectors whose bound reaches the ten nearest so
far are read in full and ranked by their exact distance.

Every row is indexed. Centroids are fitted on a bounded sample. A query searches the groups nearest to it first, and then
every group that its tenth distance so far cannot rule out by the distance to the centroid and the group's radius; so no
group is left out for lack of room, and recall does not hang on a number of probes. A large group is searched in pieces of bounded size, so a
vector that fills a third of the table does not fill a task.

Vectors that are null, zero, of another length than the first, or hold a null or non-finite component, take no part,
neither as query nor as candidate. Equal distances rank the smaller vec_id first; rows that share a vec_id with the query
are its own and no candidates. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterlake.llm.runtime import ship, written

NEAREST = 10
#: Vectors on which the centroids are fitted, at most (expected number, by a hash of the id).
SAMPLE_ROWS = 20_000
CENTROIDS = 64
ROUNDS = 8
#: Groups that a query searches first, nearest centroid first; the distances found there rule out others.
FIRST = 2
#: Vectors of a group that one task searches at a time.
PIECE_ROWS = 8_192
#: Widens the error bound: at 4 the estimate is off by more about three times in 100,000.
EPSILON = 4.0


def usable(embedding: str = "embedding") -> Column:
    """Vectors that take part."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None, :], 0)


def centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of a sample's groups."""
    if len(sample) <= k:
        return sample
    found = sample[np.random.default_rng(3).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = squared(sample, found).argmin(axis=1)
        sums, n = np.zeros_like(found), np.bincount(near, minlength=k)
        np.add.at(sums, near, sample)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


class Codes:
    """One-bit codes of vectors around one centroid."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        rest = (vectors - centre) @ turn.T
        self.dims = rest.shape[1]
        self.length = np.sqrt((rest * rest).sum(axis=1))
        unit = rest / np.maximum(self.length, 1e-300)[:, None]
        self.bits = np.packbits(rest > 0, axis=1)
        signs = np.where(rest > 0, 1.0, -1.0) / np.sqrt(self.dims)
        self.kept = np.maximum((signs * unit).sum(axis=1), 1e-9)
        self.spread = np.sqrt(np.maximum(1 - self.kept**2, 0)) / self.kept / np.sqrt(max(self.dims - 1, 1))

    def estimate(self, query: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances to a query, and the least they can be."""
        rest = turn @ (query - centre)
        away = np.sqrt((rest * rest).sum())
        if away == 0:
            return self.length**2, self.length**2
        unit = rest / away / np.sqrt(self.dims)
        inner = self._signed_sums(unit) / self.kept
        middle = self.length**2 + away**2 - 2 * self.length * away * inner
        return middle, middle - 2 * self.length * away * EPSILON * self.spread

    def _signed_sums(self, unit: np.ndarray) -> np.ndarray:
        """Sum of a vector's components with the signs of each code, a byte of the code at a time."""
        padded = np.zeros(self.bits.shape[1] * 8)
        padded[: self.dims] = unit
        patterns = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
        tables = patterns @ padded.reshape(-1, 8).T
        return sum(tables[self.bits[:, k], k] for k in range(self.bits.shape[1]))


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances, components added in their order."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        step = query[k] - vectors[:, k]
        total += step * step
    return np.sqrt(total)


def nearest(
    query: np.ndarray, own: int, limit: float, ids: np.ndarray, vectors: np.ndarray, codes: Codes, centre: np.ndarray, turn: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest by exact distance among those whose bound reaches ``limit`` and the k-th distance found here."""
    middle, least = codes.estimate(query, centre, turn)
    order = np.argsort(middle)
    order = order[(ids[order] != own) & (least[order] <= limit * limit * (1 + 1e-9))]
    first, rest = order[: 4 * k], order[4 * k :]
    scores = exact(query, vectors[first])
    if len(rest):
        limit = np.sort(scores)[k - 1]
        rest = rest[least[rest] <= limit * limit * (1 + 1e-9)]
        first, scores = np.concatenate((first, rest)), np.concatenate((scores, exact(query, vectors[rest])))
    top = np.lexsort((ids[first], scores))[:k]
    return ids[first][top], scores[top]


def search(
    rows: DataFrame, is_query: Column, k: int = NEAREST, sample_rows: int = SAMPLE_ROWS, n_centroids: int = CENTROIDS,
    first: int = FIRST, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query row among all rows of vec_id, embedding."""
    spark = rows.sparkSession
    ship(spark)
    sound = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), is_query.alias("_asks")).filter(
        F.col("vec_id").isNotNull() & usable()
    )
    sizes = sound.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("vec_id", F.size("embedding").alias("d")))["d"].alias("d")).first()
    if not sizes.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sound = sound.filter(F.size("embedding") == sizes.d)
    share = min(1.0, sample_rows / sizes.n)
    sample = sound.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("embedding").toArrow()
    centres = centroids(_matrix(sample["embedding"]), n_centroids) if sample.num_rows else np.zeros((1, sizes.d))
    held = spark.sparkContext.broadcast((centres, rotation(sizes.d)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = squared(_matrix(batch["embedding"]), held.value[0]) if batch.num_rows else np.zeros((0, 1))
            near = [pa.array(away.argmin(axis=1), pa.int32()), pa.array(np.sqrt(away.min(axis=1)), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *near], names=[*batch.schema.names, "group", "away"])

    kind = rows.schema["embedding"].dataType.simpleString()
    grouped = written(sound.mapInArrow(assign, f"vec_id long, embedding {kind}, _asks boolean, group int, away double"), "vectors")
    groups = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # one row a centroid
    pieces = F.element_at(F.create_map(*[F.lit(x) for g in groups for x in (g["group"], -(-g.n // piece_rows))]), F.col("group"))
    radius = {g["group"]: g.radius for g in groups}
    data = grouped.select("vec_id", "embedding", "group", F.pmod(F.xxhash64("vec_id"), pieces).cast("int").alias("piece"))

    def probe(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(radius))
        for batch in batches:
            if not batch.num_rows:
                continue
            away = np.sqrt(squared(_matrix(batch["query"]), held.value[0][known]))
            rank = np.argsort(np.argsort(away, axis=1), axis=1)
            if again:
                reach = away - np.array([radius[g] for g in known.tolist()])
                at, group = np.nonzero((rank >= first) & (reach <= np.asarray(batch["limit"])[:, None] + 1e-6))
            else:
                at, group = np.nonzero(rank < first)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(known[group], pa.int32())], names=[*taken.schema.names, "group"])

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            centre, turn = held.value[0][left["group"][0].as_py()], held.value[1]
            ids, vectors = np.asarray(left["vec_id"]), _matrix(left["embedding"])
            codes = Codes(vectors, centre, turn)
            for own, limit, query in zip(right["query_id"].to_pylist(), right["limit"].to_pylist(), _matrix(right["query"])):
                got, score = nearest(query, own, limit, ids, vectors, codes, centre, turn, k)
                out.append((np.full(len(got), own), got, score))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    def found(asked: DataFrame, again: bool) -> DataFrame:
        asked = written(asked.mapInArrow(lambda batches: probe(batches, again), f"query_id long, query {kind}, limit double, group int"), "asked")
        counts = {r["group"]: r.n for r in asked.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a centroid
        if not counts:
            return spark.createDataFrame([], "query_id long, vec_id long, score double")
        # the queries of a group are cut into pieces too: a task holds one piece of either side
        asks = F.element_at(F.create_map(*[F.lit(x) for g in groups for x in (g["group"], max(1, -(-counts.get(g["group"], 0) // piece_rows)))]), F.col("group"))
        side = asked.withColumn("ask", F.pmod(F.xxhash64("query_id"), asks).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        wanted = data.filter(F.col("group").isin(*counts)).withColumn("ask", F.explode(F.sequence(F.lit(0), asks - 1)))
        keys = ["group", "piece", "ask"]
        return wanted.groupBy(*keys).cogroup(side.groupBy(*keys)).applyInArrow(
            lambda left, right: find(left, right), "query_id long, vec_id long, score double"
        )

    def best(candidates: DataFrame) -> DataFrame:
        by_score = W.partitionBy("query_id").orderBy("score", "vec_id")
        return candidates.withColumn("rank", F.row_number().over(by_score).cast("int")).filter(F.col("rank") <= k)

    asked = grouped.filter("_asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = written(best(found(asked.withColumn("limit", F.lit(float("inf"))), False)), "near")
    limits = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("limit"))
    limited = asked.join(limits, "query_id", "left").select("query_id", "query", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    far = found(limited, True)
    return best(near.drop("rank").union(far)).select("query_id", "rank", "vec_id", "score")
