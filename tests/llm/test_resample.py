import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import radix, resample

KINDS = "doc_id long, text string"


def runs(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(S + 10_000) / (float(s[b] + 1) * float(T + 10_000))))
    out = []
    for doc, text in rows:
        n, found = runs(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0], r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    pool = ["House", "hügel", "水", "a-b", "x1", "Ä", "z" * 70, "end."] + [f"w{i}" for i in range(200)]
    rows = [(rng.randint(-50, 1 << 40), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    rows += [(1, None), (2, ""), (3, "..."), (None, "w1 w2 " * 15), (4, rows[0][1]), rows[5], rows[5], (rows[5][0], "w3 " * 40)]
    return rows + [(1000 + i, "w5 w6 w7 " * 9) for i in range(150)], ["w5 w6 w7 w8 House", None, "hügel 水 x1 " * 5]


def got(spark, rows, target, **kw):
    docs = spark.createDataFrame(rows, KINDS).withColumns({"rank": F.lit("clash"), "_row": F.lit(1), "pos": F.lit(2), "block": F.lit(3)})
    found = resample.resample(docs.repartition(7), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long"), **kw)
    return sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_brute_force(spark):
    rows, target = corpus(1)
    want = brute(rows, target, percent=30)
    assert got(spark, rows, target, percent=30) == want
    assert sum(r[4] is not None for r in want) > 50


def test_empty_tables_and_long_texts(spark):
    assert got(spark, [], []) == [] and got(spark, [], ["a b"]) == []
    rows = [(1, "w " * 400_000 + "é" * 100_000 + " q"), (2, " \n "), (3, None)]
    assert got(spark, rows, [], percent=100) == brute(rows, [], percent=100)


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "x", 5)], "doc_id long, text string, source string, score int")
    found = resample.resample(docs, docs, percent=100)
    assert found.columns == ["doc_id", "source", "n_words", "n_features", "weight", "score", "rank"]
    assert [(r.source, r.n_words, r["rank"]) for r in found.collect()] == [("x", 30, 1)]


@pytest.mark.parametrize("keys", [[("a", False)], [("a", True), ("b", False)], [("b", True), ("a", False)]])
def test_radix_ranks_equal_a_sort(spark, keys, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK_BITS", 6)  # many blocks; workers get it with the job through the module's own constants
    rng = random.Random(len(keys))
    big = (1 << 63) - 1
    rows = [(i, rng.choice([None, 0, 7, 7, 7, -3, rng.randint(-(1 << 20), 1 << 20), big, -big - 1]), rng.choice([None, 1, 2, rng.randint(0, 1 << 33)])) for i in range(700)]
    ranks = {r.id: r["rank"] for r in radix.ranks(spark.createDataFrame(rows, "id long, a long, b long").repartition(5), "id", keys).collect()}
    assert sorted(ranks.values()) == list(range(1, len(rows) + 1))

    def key(row):
        out = []
        for name, falling in keys:
            v = row["id a b".split().index(name)]
            out += [(v is None) if falling else (v is not None), 0 if v is None else -v if falling else v]
        return out

    ordered = sorted(rows, key=lambda r: ranks[r[0]])
    assert [key(r) for r in ordered] == sorted(map(key, rows))


def test_radix_ranks_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([], "id long, a long")
    assert radix.ranks(empty, "id", [("a", True)]).collect() == []
    same = spark.range(20_000).withColumn("a", F.lit(4))
    assert sorted(r["rank"] for r in radix.ranks(same, "id", [("a", True)]).collect()) == list(range(1, 20_001))


def test_a_block_is_sorted_stably():
    rows = pa.table({"pos": [3, 1, 2, 0], "digit": pa.array([1, 0, 1, 0], pa.int32()), "block": [0] * 4, "row": [30, 10, 20, 0]})
    placed = radix._destinations(rows, pa.table({"block": [0, 0], "digit": pa.array([0, 1], pa.int32()), "offset": [5, 100]}))
    assert dict(zip(placed["row"].to_pylist(), placed["pos"].to_pylist())) == {0: 5, 10: 6, 20: 100, 30: 101}


def test_checksums_of_runs():
    texts = pa.array(["ab " + "x" * 63 + " " + "y" * 64 + " " + "z" * 65 + " " + "é" * 90 + " end", "", None, "one"])
    _, found = resample.buckets(texts)
    got = np.concatenate([b for _, b in found])
    assert sorted(got.tolist()) == sorted(b for t in texts.to_pylist() for b in runs(t)[1])
