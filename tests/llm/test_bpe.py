import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rosterlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(PATH, public_tokenizers.PATTERN, bpe.CUT)


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_equals_the_library_on_random_texts(coder, library):
    rng = random.Random(1)
    parts = ["a", "b", "aa", "the", " ", "  ", "\n", "é", "漢", "😀", "1", "23", "...", "!", "'s", "'", "\x00", "ing", "tion", "Z", "\t", "ß", "\u3000", "\x1c"]
    for _ in range(5_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert ids(coder.encode(text)) == library.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()


def test_without_cuts_the_same(library):
    whole = bpe.Encoder(PATH, public_tokenizers.PATTERN, None)
    for text in ("a b  c\n d", " x", "", "don't 12 %%% stop"):
        assert ids(whole.encode(text)) == library.encode_ordinary(text)


def test_long_runs_take_linear_time(coder, library):
    assert ids(coder.encode("=" * 20_000)) == library.encode_ordinary("=" * 20_000)
    text = "ab" * 100_000
    assert coder.decode(coder.encode(text)) == text.encode()


def test_nulls_empty_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", "x"), (3, "Hello  world\n", "x"), (None, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN, decode=True).orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens").collect()
    assert [r.n_tokens for r in got] == [len(library.encode_ordinary(t)) for t in ("é", "", "", "Hello  world\n", "Hello  world\n")]
    assert [bytes(r.decoded).decode() for r in got] == ["é", "", "", "Hello  world\n", "Hello  world\n"]
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_a_match_that_is_a_token_is_not_searched(monkeypatch, coder, library):
    monkeypatch.setattr(coder, "automaton", None)
    for match in (" the", "a", "é"):
        assert [coder.encode_match(match)] == [library.encode_ordinary(match)]


def test_words_met_again_are_not_encoded_again(monkeypatch, library):
    """Words in steady use stay known while rare ones pass through a small memory."""
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    coder, met = bpe.Encoder(PATH, public_tokenizers.PATTERN), []
    searched = coder.encode_match
    monkeypatch.setattr(coder, "encode_match", lambda match: met.append(match) or searched(match))
    for i in range(100):
        text = f"x frequentword{' ' * (i % 3)} rare{'abcdefghij'[i % 10]}q{'klmnopqrst'[i // 10]}z,\n\nothers \n "
        assert ids(coder.encode(text)) == library.encode_ordinary(text)
        assert ids(coder.encode(f"a frequentword {'zq' * (i % 7 + 1)}{i}")) == library.encode_ordinary(f"a frequentword {'zq' * (i % 7 + 1)}{i}")
    assert met.count(" frequentword") <= 2
