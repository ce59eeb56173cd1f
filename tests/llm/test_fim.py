import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from rosterlake.llm import fim

KINDS = "doc_id long, text string"


def brute(doc, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc, n, "plain", None, None, text, text)
    if h4 % 100 < 80:
        return (doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def corpus():
    rng = random.Random(3)
    bits = ["wörd", "水", " ", "\n", "\t ", "<", "<S", "P>", "a<M", " ", "\x1f", "x"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(i, "a <S> b") for i in range(500, 510)] + [(600, None), (601, ""), (602, " \n"), (None, "null id"), (603, "word"), rows[7], rows[7]]
    return rows + [(700 + i, "lang é " * 60_000) for i in range(6)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_equals_brute_force_and_gives_the_text_back(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, KINDS).withColumns({"form": F.lit(5), "pieces": F.lit("clash"), "extra": F.col("doc_id") * 2})
    done = fim.transform(docs.repartition(5))
    back = fim.restore(done)
    assert "output" not in back.columns and back.columns[-2:] == ["restored_sha256", "restored"]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored, r.restored_sha256) for r in back.collect()]
    want = [(*w[:5], sha(w[5]), w[6], sha(w[6])) for w in (brute(*r) for r in rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    texts = {r.output_sha256: r.output for r in done.select("output", "output_sha256").collect()}
    assert all(sha(t) == d for d, t in texts.items())
    assert all(r.extra is None or r.extra == 2 * r.doc_id for r in done.collect())


def test_empty_table(spark):
    assert fim.restore(fim.transform(spark.createDataFrame([], KINDS))).collect() == []


def test_restoring_takes_nothing_but_output_and_form(spark):
    rows = [("<P>a<<S>c<M>b", "psm"), ("<S>c<P>a<M>b", "spm"), ("<S>", "plain"), (None, "plain"), ("x", None), ("<S><P><M>", "spm")]
    found = fim.restore(spark.createDataFrame(rows, "output string, form string"))
    assert [r.restored for r in found.collect()] == ["a<bc", "abc", "<S>", "", "x", ""]


def test_descriptors_share_the_text(spark):
    text = "one two three four"
    doc = next(i for i in range(100) if brute(i, text)[2] == "spm" and 0 < brute(i, text)[3] < 13 and brute(i, text)[4])
    table, form, n, prefix, middle = fim.cut(text, doc)
    assert (form, n) == ("spm", 4) and [b for b, _, _ in table.pieces] == [3, 0, 1, 0, 2, 0]
    assert {p[1:] for p in table.pieces if p[0] == 0} == {(0, prefix), (prefix, prefix + middle), (prefix + middle, len(text))}


def test_units_of_long_texts_are_cut_in_stretches(monkeypatch):
    monkeypatch.setattr(fim, "STRETCH", 4)
    for text in ("", " ", "abcd", "abcd ", "abc def", "abcd efgh  ", "a b c d e f", "    x", "abcdefgh"):
        ends = [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
        assert fim.unit_ends(np.frombuffer(text.encode(), dtype=np.uint8)).tolist() == ends
