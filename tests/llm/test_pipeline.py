"""The stages against plain versions on a small corpus, and the contract of the module."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_near

KINDS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    words = {"en": "the house and water of morning with trees over hills".split(), "de": "das haus und wasser der morgen mit bäume über hügel".split()}
    line = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(8))
    shared = [line("en"), line("en"), line("en")]
    items = [(1, line("en") + " " + line("en")), (2, None)]
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        text = "\n".join(line(lang) for _ in range(rng.randint(1, 6)))
        if i % 9 == 0:
            text += "\n" + "\n".join(shared)
        if i % 10 == 3:
            text += "\n" + items[0][1]
        rows.append((i, text, lang))
    noise = " ".join("".join(rng.choice("qxzjkvwy") for _ in range(9)) for _ in range(300))
    long = " ".join(rng.choice(words["de"]) for _ in range(30))  # one line that is a passage of its own
    rows += [(210, noise, None), (211, "ende\n" + long, "de"), (212, "anfang\n" + long + "\nschluss", "de"), (213, "\n".join(line("en") for _ in range(4_000)), "en")]
    rows += [(214, rows[7][1], "de"), (214, rows[7][1], "de")]
    rows += [(100 + i, rows[5][1] + " End", "en") for i in range(5)] + [(200, None, "en"), (201, "123", None), (202, "", "de"), (None, line("de"), None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows], KINDS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages_call_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "tokens"]


def test_whole_pipeline_equals_plain_versions(spark, folder):
    path, rows, items = folder
    docs = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t) and i != 210]
    docs = [(i, out[2]) for (i, _), out in zip(docs, brute_lines(docs, 2))]
    near = {(d, kept) for d, _, _, kept in brute_near(docs, 5) if d is not None}
    docs = [(i, t) for i, t in docs if i is None or (i, True) in near]
    docs = [d for d, hit in zip(docs, brute_hits(docs, items)) if not hit[3]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = lambda t: np.array(library.encode_ordinary(t), dtype="<u4")
    want = sorted(((i, len(ids(t)), hashlib.sha256(ids(t).tobytes()).hexdigest(), True) for i, t in docs), key=str)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.intact) for r in corpus_pipeline.run(spark, path).collect()), key=str)
    assert got == want and 20 < len(got) < len(rows)


def test_all_but_the_last_return_the_columns_of_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_texts_stay_where_no_text_has_a_label(spark):
    rows = [(1, "clean text", None, "s", 10), (2, "123", None, "s", 3), (3, None, None, "s", 0), (4, "mehr Text", None, "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4]
