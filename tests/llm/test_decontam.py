import random
import re

from pyspark.sql import functions as F

from rosterlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    out = []
    for _, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            p = words(t)
            m = min(10, len(p))
            grams = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    items.add(item)
        out.append((len(w), len(hit), sorted(items, key=str), bool(hit)))
    return out


def tables(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)] + ["É", "ß", "THE"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, make(rng.choice([0, 1, 2, 3, 9, 10, 14, 30]))) for i in range(25)] + [(3, make(12)), (40, None), (41, "  ")]
    docs = [(i, make(rng.choice([0, 1, 5, 40, 700]))) for i in range(30)]
    docs += [(i + 100, make(4) + "! " + t + " - " + make(3)) for i, t in bench if t] + [(500, None), (501, ""), (501, "")]
    return docs, bench


def run(spark, docs, bench, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_n": F.monotonically_increasing_id(), "hits": F.lit("clash")})
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontam.mark(d, b, **kw).orderBy("_n").collect()
    return [(r.n_words, r.n_hit, sorted(r["items"], key=str), r.contaminated) for r in got]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs, bench = tables(seed)
        assert run(spark, docs, bench) == brute(docs, bench)


def test_blocks_of_a_larger_benchmark_give_the_same(spark):
    docs, bench = tables(3)
    assert run(spark, docs, bench, block_bytes=300) == brute(docs, bench)


def test_long_text_and_empty_tables(spark):
    bench = [(7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    text = " ".join(["noise words here"] * 100_000) + " " + bench[0][1].upper()
    assert run(spark, [(1, text)], bench) == [(300_011, 11, [7], True)]
    assert run(spark, [(1, "a b")], []) == [(2, 0, [], False)]
    assert run(spark, [], bench) == []
