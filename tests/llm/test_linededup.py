import random
import re

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from rosterlake.llm import linededup


WORD = regex.compile(r"[\p{Han}]{1,2}|[^ \t-\r\p{Han}]+")


def brute(rows, run, long_words=20):
    low = -(1 << 63)
    cut = lambda t: [x for x in (t or "").split("\n") if not re.fullmatch(r"[ \t-\r]*", x)]
    first, out = {}, []

    def windows(w):
        alone = [(i, 1) for i, x in enumerate(w) if long_words and len(WORD.findall(x)) >= long_words]
        return [(i, run) for i in range(len(w) - run + 1)] + (alone if run > 1 else [])

    for doc, text in rows:
        w = cut(text)
        for i, n in windows(w):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, (1 << 63, 0)), (low if doc is None else doc, i))
    for doc, text in rows:
        w, gone = cut(text), set()
        for i, n in windows(w):
            if first[tuple(w[i : i + n])] < (low if doc is None else doc, i):
                gone |= set(range(i, i + n))
        out.append((len(w), len(gone), "\n".join(x for i, x in enumerate(w) if i not in gone) if gone else text))
    return out


def tables(seed):
    rng = random.Random(seed)
    pool = [f"line {i}" for i in range(25)] + ["License", "License", "  ", "", " \x0b", "word " * 20, "水" * 39, "水" * 38, " é" * 20, "\ta b"]
    rows = [(rng.randint(1, 60), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for _ in range(50)]
    rows += [(100 + i, "a\nb\nLicense\nc") for i in range(40)]  # copies
    return rows + [rows[2], rows[2], (None, "a\nb"), (None, None), (300, None), (301, ""), (302, "x\n" * 2_000), (303, "a\n\n \nb")]


def got(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_n": F.monotonically_increasing_id(), "runs": F.lit("clash"), "version": F.lit(1), "start": F.lit(2), "_id": F.lit(3), "_v": F.lit(4), "_of_id": F.lit(5), "_of_text": F.lit(6), "_in_lines": F.lit(7), "_version": F.lit(8)})
    return [(r.n_lines, r.n_removed, r.text) for r in linededup.drop_repeated_lines(docs, **kw).orderBy("_n").collect()]


@pytest.mark.parametrize("run", [1, 2, 4])
def test_equals_brute_force(spark, run):
    rows = tables(run)
    assert got(spark, rows, run=run) == brute(rows, run)


def test_empty_and_long(spark):
    assert got(spark, []) == []
    text = "\n".join(f"line {i}" for i in range(20_000))
    assert got(spark, [(1, text), (2, "head\n" + text)]) == [(20_000, 0, text), (20_001, 20_000, "head")]


def test_single_long_lines_that_occur_earlier_go(spark):
    long, other = " ".join(f"w{i}" for i in range(25)), " ".join(f"v{i}" for i in range(20))
    wide, short = "水" * 40, " ".join(f"u{i}" for i in range(19))
    rows = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{long}\nd\n{short}\ne"), (3, other), (4, other), (5, wide), (6, f"f\n{wide}"), (7, f"g\n{long}\n{long}\nh"), (8, f"x\ny\n{other}\nz\ny"), (9, f"q\nx\ny\n{other}")]
    assert [(n, t) for _, n, t in got(spark, rows)] == [
        (0, rows[0][1]), (1, f"c\nd\n{short}\ne"), (0, other), (1, ""), (0, wide), (1, "f"), (2, "g\nh"), (1, "x\ny\nz\ny"), (3, "q"),
    ]
    assert [n for _, n, _ in got(spark, rows, long_words=None)] == [0, 0, 0, 0, 0, 0, 0, 0, 3]


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb", 5, 6, 7)], "doc_id long, text string, _of_id int, _version int, _id int")
    found = linededup.drop_repeated_lines(docs)
    assert found.columns == ["doc_id", "text", "_of_id", "_version", "_id", "n_lines", "n_removed", "runs"]
    assert tuple(found.first())[2:5] == (5, 6, 7)


def test_only_selected_lines_leave_a_text(spark):
    """Of 5,000 different lines about two in three are selected by a window of two, each stands in one row."""
    docs = spark.createDataFrame([(1, 1, "\n".join(f"line {i}" for i in range(5_000)))], "doc_id long, version long, text string")
    rows = linededup.positions(docs, 2, "text", None).collect()
    assert len({r.place for r in rows}) == len(rows) and 0.6 * 5_000 < len(rows) < 0.73 * 5_000
    assert sorted(w.start for r in rows for w in r.windows) == list(range(4_999))
    assert all(w.start <= r.place < w.start + w["size"] for r in rows for w in r.windows)


def test_words_of_a_line_do_not_run_into_the_next_text():
    found = linededup.Lines(pa.array(["a b", "c d\ne", None, "f"]), 2)
    assert found.long.tolist() == [True, True, False, False] and found.number.tolist() == [0, 0, 1, 0]
