import itertools
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.llm import neardup


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((top(rows[i][0]), top(rows[j][0])))
            root[y] = x
    out = []
    for (d, _), s in zip(rows, sets):
        comp = None if d is None else top(d) if s else d
        out.append((d, len(s), comp, comp == d))
    return sorted(out, key=str)


def run(spark, rows, n, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sign", F.lit("clash"))
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, shingle=n, **kw).collect()), key=str)


def edited(rng, words, vocab, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = rng.choice(vocab)
    return " ".join(out)


def tables(seed, copies=80):
    """A base with many edited copies, of which some are linked, some only through others, some not at all."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3_000)]
    rows = []
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(150)]
        n = copies if g == 0 else rng.randint(1, 12)
        rows += [(rng.randint(1, 100_000), edited(rng, base, vocab, rng.randint(0, 8))) for _ in range(n)]
        rows += [(rng.randint(1, 100_000), " ".join(base))] * (2 if g == 1 else 1)
        rows += [(rng.randint(1, 100_000), " ".join(base).upper()) for _ in range(5)]
    rows += [(rng.randint(1, 100_000), " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40)))) for _ in range(60)]
    rows += [(200_000, None), (200_001, ""), (200_002, " \n"), (200_003, "one two"), (200_004, "One  two"), (200_005, "one"), (None, "one two"), (None, None)]
    return rows


@pytest.mark.parametrize("seed, tile", [(1, 1_000), (2, 7)])
def test_equals_brute_force(spark, seed, tile):
    rows = tables(seed)
    assert run(spark, rows, 4, tile=tile) == brute(rows, 4)


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (2, b), (3, a), (3, b), (4, b + " end")]
    got = {d: c for d, _, c, _ in run(spark, rows, 5)}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}


def test_empty_and_long(spark):
    assert run(spark, [], 5) == []
    text = " ".join(f"u{i}" for i in range(100_000))
    assert run(spark, [(5, text), (4, text + " more")], 5) == brute([(5, text), (4, text + " more")], 5)


def test_chains_of_links_reach_the_smallest_id(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40, 0, -1)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.comp for r in neardup.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 42)}, 100: 100, 101: 100}
