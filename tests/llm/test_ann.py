import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import ann


def brute(rows, k, asks):
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None and len(v) == 8]
    out = set()
    for q, v in good:
        if asks(q):
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in good if i != q)[:k]
            out |= {(q, rank, i, round(d, 9)) for rank, (d, i) in enumerate(near, 1)}
    return out


def run(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(0), "group": F.lit("x")})
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(df, F.col("vec_id") % 20 == 0, k, **kw).collect()}


def vectors(seed, n=600):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    return [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(n)]


def test_equals_brute_force_in_small_pieces(spark):
    rows = vectors(1)
    assert run(spark, rows, piece_rows=40, n_centroids=9, first=1) == brute(rows, 10, lambda i: i % 20 == 0)


def test_odd_vectors_ties_and_a_common_one(spark):
    rows = vectors(2, 200)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one vector fills much of the table
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [float("inf")] * 8), (2100, [1.0])]
    rows += [(None, rows[1][1])]
    assert run(spark, rows, piece_rows=30) == brute(rows, 10, lambda i: i % 20 == 0)


def test_fewer_candidates_and_an_empty_table(spark):
    rows = vectors(3, 4)
    assert run(spark, rows) == brute(rows, 10, lambda i: i % 20 == 0) and len(run(spark, rows)) == 3
    assert run(spark, []) == set()


@pytest.mark.parametrize("dims", [8, 20, 64])
def test_bounds_hold_and_estimates_are_near(dims):
    rng = np.random.default_rng(4)
    data, query, centre, turn = rng.normal(size=(4_000, dims)), rng.normal(size=dims), rng.normal(size=dims) * 0.1, ann.rotation(dims)
    codes = ann.Codes(data, centre, turn)
    middle, least = codes.estimate(query, centre, turn)
    true = ((data - query) ** 2).sum(axis=1)
    assert (least <= true + 1e-9).mean() > 0.999
    assert abs((middle - true).mean()) < 0.05 * true.mean()
    assert np.allclose(turn @ turn.T, np.eye(dims))
