import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rosterlake.llm import quality

SF = "/root/testdata/sf0.01"


def plain(text):
    """The statistics of one text, one by one."""
    raw = (text or "").encode()
    words = "".join(c if c not in "\t\n\v\f\r" else " " for c in text or "").split(" ")
    words = [w.encode() for w in words if w]
    lines = [x for x in raw.split(b"\n") if x]
    of = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    upper, lower = of(range(65, 91)), of(range(97, 123))
    n, size, pairs = max(len(words), 1), max(len(raw), 1), list(zip(words, words[1:]))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), upper / max(upper + lower, 1), of(range(48, 58)) / size, of(range(128, 256)) / size, of(b"\t\n\v\f\r ") / size,
        of(b".,;:") / n, of(b"!?") / n, of(b"|/\\") / n, of(b"\"'()[]{}<>") / n, of(b"#$%&*@^~=+_`-") / n, sum(map(len, words)) / n, math.log1p(max(map(len, words), default=0)),
        sum(len(w) <= 3 for w in words) / n, sum(len(w) > 1 and 2 * sum(65 <= c <= 90 for c in w) > len(w) for w in words) / n, len(set(words)) / n, max(Counter(words).values(), default=0) / n,
        sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(len(words) - 1, 1), len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
    ]


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdé") for _ in range(rng.randint(1, 9)))
    good = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(5, 30))) + "." for _ in range(rng.randint(1, 5)))
    bad = [lambda: " ".join(word() + "###" for _ in range(40)), lambda: " | ".join(word() for _ in range(40)), lambda: (word() + " ") * 60, lambda: good().upper().replace(" ", "!! ")]
    return [(i, good(), 1) if rng.random() < 0.7 else (i, rng.choice(bad)(), 0) for i in range(n)]


def test_statistics_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(quality, "_STRETCH", 50)
    found = [None, "", " \n\n", "Ab AB! AB!\n\nab|ab", "x"] + [t for _, t, _ in texts(1, 60)]
    assert np.allclose(quality.statistics(pa.array(found)), [plain(t) for t in found])
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.NAMES))


def test_flattened_trees_score_like_the_model(spark):
    rows = spark.createDataFrame([([float(x) for x in quality.statistics(pa.array([t]))[0]], float(q)) for _, t, q in texts(2, 300)], "features array<double>, label double").select(
        array_to_vector("features").alias("vector"), "label", "features"
    )
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=7, maxDepth=3, stepSize=0.3, seed=1).fit(rows)
    want = [(r.features, r.probability[1]) for r in model.transform(rows).select("features", "probability").collect()]
    got = quality.Trees.flattened(model).score(np.array([f for f, _ in want]))
    assert np.allclose(got, [p for _, p in want])


def test_held_out_texts_are_told_apart(spark):
    rows = texts(3, 700)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(-1, None), (-2, ""), (None, "no id"), rows[0][:2], (-3, "word " * 200_000)], "doc_id long, text string").withColumns({"score": F.lit("clash"), "label": F.lit(3), "features": F.lit(0)})
    labels = spark.createDataFrame([(i, q, "x") for i, _, q in rows] + [(None, 1, "x"), (5, None, "x"), (6, 7, "x"), rows[0][:1] + (rows[0][2], "x")], "doc_id long, quality int, text string")
    trees = quality.fit(docs, labels, ~quality.held_out())
    found = {r.doc_id: r for r in quality.predict(docs, trees).withColumn("held", quality.held_out()).collect()}
    held = [(found[i].predicted, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and all(found[i].held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert found[-1].score == found[-2].score


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = texts(4, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, _, q in rows]
    scores = []
    for labels in ([(i, q) for i, _, q in rows], turned):
        trees = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), ~quality.held_out())
        scores.append(sorted((r.doc_id, r.score) for r in quality.predict(docs, trees).collect()))
    assert np.allclose(scores[0], scores[1])


@pytest.mark.parametrize("known, want", [([], 0.5), ([(1, 1), (3, 1)], 1.0), ([(1, 0)], 0.0), ([(1, None), (3, 5)], 0.5)])
def test_labels_of_one_kind(spark, known, want):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id long, text string")
    trees = quality.fit(docs, spark.createDataFrame(known, "doc_id long, quality int"), F.lit(True))
    assert [r.score for r in quality.predict(docs, trees).collect()] == [want, want]
    assert quality.predict(docs.limit(0), trees).collect() == []


def test_the_sample_is_bounded(spark):
    rows = texts(5, 50)
    docs = spark.createDataFrame([(i % 10, t) for i, t, _ in rows] * 4, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    assert quality.sample(docs, labels, F.lit(True), sample_rows=20).count() <= 40
