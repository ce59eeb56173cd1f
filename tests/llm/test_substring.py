import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import substring


def brute(rows, window):
    low = -(1 << 63)
    first = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (1 << 63, 0)), (low if doc is None else doc, i))
    out = []
    for doc, text in rows:
        w, gone = (text or "").encode().split(), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (low if doc is None else doc, i):
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_n": F.monotonically_increasing_id(), "kept": F.lit("clash"), "step": F.lit(1)})
    got = substring.remove_repeats(docs, **kw).orderBy("_n").collect()
    return [(r.n_words, r.n_removed, r.kept) for r in got]


def tables(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "A", "a"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = [make(25) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [make(rng.randint(0, 30))] + [rng.choice(passage) + " " + make(rng.randint(0, 5)) for _ in range(rng.randint(0, 3))]
        rows.append((rng.randint(1, 200), "\n ".join(parts)))
    rows += [(i + 500, rows[0][1]) for i in range(40)]  # a large group of copies
    return rows + [rows[3], rows[3], (None, passage[0]), (None, None), (900, ""), (901, None), (902, "x " * 300)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = tables(seed)
    assert run(spark, rows, window=20) == brute(rows, 20)


def test_many_small_blocks_give_the_same(spark):
    rows = tables(3)
    assert run(spark, rows, window=5, block_bytes=400) == brute(rows, 5)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring, "CELLS_PER_WINDOW", 0)
    rows = tables(4)
    assert run(spark, rows, window=20) == brute(rows, 20)


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == []
    text = " ".join(f"u{i}" for i in range(200_000))
    assert run(spark, [(1, text), (2, text + " end")]) == [(200_000, 0, text), (200_001, 200_000, "end")]


def test_packing_is_lossless():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1_000, dtype=np.uint64))
    assert (substring.unpack(substring.pack(values, True), 1_000, True) == values).all()
    assert (substring.unpack(substring.pack(values), 1_000) == values).all()
