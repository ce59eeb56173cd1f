import random
import re
import time

from pyspark.sql import functions as F

from rosterlake.llm import pii

BRUTE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def brute(text):
    return [(k, m.start(), m.end()) for k, p, good in BRUTE for m in p.finditer(text) if good(m[0])]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x@y.z", ".", "..", "-", "+", "+1 (555) 010-9999", "192.168.0.1", "300.1.1.1", "4111 1111 1111 1111", "1", "25", "  ", " ", "é", "(", ")", "\n", "4111-1111-1111-1112", "0000001.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000):
        pii.candidates(text, pii.base_spans(text))


def test_a_megabyte_of_contacts_takes_linear_time():
    text = "".join(f"p{i}@mail{i % 97}.org, +1 555 {i:07d}, 10.0.{i % 200}.{i % 99}; " for i in range(24_000))
    start = time.perf_counter()
    found = pii.candidates(text, pii.base_spans(text))
    assert len(text) > 1_000_000 and len(found) > 60_000 and time.perf_counter() - start < 10


def test_free_candidates_touch_no_base_span():
    rng = random.Random(4)
    parts = ["x@y.z", "+1 (555) 010-9999", "192.168.0.1", "4111 1111 1111 1111", " ", ", ", "tel 555 010 9999", "1.2.3", "12 345 678", "a (at) b (dot) org"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        base = pii.base_spans(text)
        for c in pii.candidates(text, base):
            touched = any(a < c["end"] and c["start"] < b for _, a, b in base)
            assert c["free"] == (not touched and not c["out"]), (text, c)


def sentence(rng, what):
    return " ".join(rng.choice("we met them at noon near old mill and spoke of it".split()) for _ in range(8)) + f" {what} " + "then left."


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        number = "".join(rng.choice("0123456789") for _ in range(15))
        check = next(d for d in "0123456789" if pii.luhn(number + d))
        what = rng.choice([
            f"ann{i}@mail.example.com", f"10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)}", number + check, f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
            f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", number + "abc", f"page {rng.randint(1, 999)}", f"300.{rng.randint(256, 999)}.1.1", str(rng.randint(10**7, 10**9)),
        ])
        out.append((i, sentence(rng, what)))
    return out


def test_query_rows_have_base_spans_and_trees_add_only_new_ones(spark):
    rows = [*corpus(), (1000, None), (1001, ""), (3, corpus()[3][1]), (None, "x@y.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "kind": F.lit(1), "_n": F.monotonically_increasing_id()})
    got = pii.find(docs).orderBy("_n").collect()
    assert len(got) == len(rows)
    for r, (_, text) in zip(got, rows):
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert base == brute(text or "")
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert [s for s in spans if s[0] in pii.BASE] == base
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        added = [s for s in spans if s[0] not in pii.BASE]
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "no data"), (2, "x@y.zz")], "doc_id long, text string")
    assert [len(r.spans) for r in pii.find(docs).orderBy("doc_id").collect()] == [0, 1]
    assert pii.find(docs.limit(0)).collect() == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é mail a@b.cc or 10.0.0.1!"), (2, "none")], "doc_id long, text string")
    found = docs.join(pii.find(docs), "doc_id").withColumn("clean", pii.redacted("text", "spans")).orderBy("doc_id")
    assert [r.clean for r in found.collect()] == ["é mail <email> or <ip>!", "none"]


def planted(n=1600, seed=2):
    """A corpus with labelled formats, and plausible ones that no strict pattern finds: text by id, and what must be added."""
    rng = random.Random(seed)
    rows, want, never = [], set(), set()
    for i, (_, text) in enumerate(corpus(seed, n)):
        rows.append((i, text))
    for i in range(n, n + 60):
        local = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        what, to = [(f"ann{i} (at) mail (dot) com", want), (f"call {local}", want), (f"version {rng.randint(1, 9)}.{rng.randint(10, 99)}.{rng.randint(1000, 9999)}", never), (f"on 2021-{rng.randint(10, 12)}-{rng.randint(10, 28)}", never)][i % 4]
        rows.append((i, sentence(rng, what)))
        to.add(i)
    return rows, want, never


def test_plausible_formats_are_added_and_versions_are_not(spark):
    rows, want, never = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans if s.kind not in pii.BASE] for r in pii.find(docs).collect()}
    assert not any(found[i] for i in never)
    assert sum(bool(found[i]) for i in want) >= 0.9 * len(want)


def test_rare_kinds_keep_their_share_of_the_sample(spark):
    rng = random.Random(4)
    rows, want, never = planted()
    numbers = [(10_000 + i, " ; ".join(f"page {rng.randint(1, 99)}-{rng.randint(100, 999)}" for _ in range(40))) for i in range(500)]
    docs = spark.createDataFrame(rows + numbers, "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans if s.kind == "email_like"] for r in pii.find(docs, sample_rows=1_600).collect()}
    assert sum(bool(found[i]) for i in want) >= 0.4 * len(want) and not any(found[i] for i in never)


def test_all_candidates_are_learned_from_however_little_they_weigh(spark):
    rows, want, never = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans if s.kind not in pii.BASE] for r in pii.find(docs, sample_rows=40).collect()}
    assert sum(bool(found[i]) for i in want) >= 0.9 * len(want) and not any(found[i] for i in never)
