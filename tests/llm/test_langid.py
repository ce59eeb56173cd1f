import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = {
    "en": "the house and water of morning with they are going over there under three thousand trees".split(),
    "de": "das haus und wasser der morgen mit sie gehen über dort unter drei tausend bäume strasse".split(),
    "fr": "la maison et eau du matin avec ils vont dessus là sous trois mille arbres chaussée".split(),
}


def corpus(seed, n=40):
    rng = random.Random(seed)
    out = []
    for lang, words in WORDS.items():
        out += [(" ".join(rng.choice(words) for _ in range(rng.randint(4, 30))), lang) for _ in range(n)]
    return [(i, t, lang) for i, (t, lang) in enumerate(out)]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(corpus(1), "doc_id long, text string, lang string")
    return langid.fit(docs, PATH, F.lit(True))


def test_forward_sums_all_segmentations(model):
    pieces = langid.vocabulary(PATH)
    for word in (b" the", b" water", " ü".encode()):
        total = np.zeros(len(model.languages))
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            parts = [pieces.index.get(word[a:b]) for a, b in zip(at, at[1:])]
            if None not in parts:
                total += np.prod([model.p[p] for p in parts], axis=0)
        assert np.allclose(pieces.log_words([word], model.p)[0], np.log(total))


def test_probabilities_sum_to_one_and_expected_counts_cover_words(model):
    assert np.allclose(model.p.sum(axis=0), 1) and (model.p[-1] == 0).all()
    pieces, words = langid.vocabulary(PATH), [b" the", b" water", b" of"]
    uses = pieces.expected(words, np.array([1.0, 2.0, 5.0]), model.p[:, :1])
    lengths = np.array([len(p) for p in pieces.pieces])
    assert math.isclose((uses * lengths).sum(), 4 + 2 * 6 + 5 * 3, rel_tol=1e-9)


def test_held_out_accuracy(spark, model):
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string, lang string")
    got = langid.predict(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ... !!"), (4, "the" * 50_000), (5, "über das wasser"), (5, "über das wasser"), (None, "la maison avec eau")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "_spoken": F.lit(3)})
    got = {(r.doc_id, r.lang_pred, r.score == 0) for r in langid.predict(docs, model).collect()}
    assert got == {(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (5, "de", False), (None, "fr", False)}
    assert langid.predict(docs.limit(0), model).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the house", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, PATH, F.lit(True))
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()] == [("und", 0.0)]
    assert langid.fit(docs.limit(0), PATH, F.lit(True)).languages == []


def test_accuracy_on_the_held_out_third(spark):
    from rosterlake.llm import catalog

    sf = "/root/testdata/sf0.001"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = catalog.queries()["op7_segmentation_marginalised_language"](spark, sf).filter("held_out").join(truth, "doc_id").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def plain_forward(word, probabilities):
    """Probability of a word summed over all cuts into pieces, piece by piece."""
    reach = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - langid.LONGEST), j):
            reach[j] += reach[i] * probabilities.get(word[i:j], 0.0)
    return reach[-1]


def test_whole_texts_equal_brute_force(spark, model):
    """Label and score of whole texts, from the piece probabilities alone."""
    pieces = langid.vocabulary(PATH)
    tables = [{piece: float(model.p[i, k]) for i, piece in enumerate(pieces.pieces)} for k in range(len(model.languages))]
    long = "straße " + "überallhin" * 30 + " the house"
    texts = [t for _, t, _ in corpus(7, 8)] + [long, "12 34", None, "", "a", "\t water\n\nof ", "日本 wasser", "é", "the " * 3_000]
    want = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            want.append(("und", 0.0))
            continue
        logs = []
        for table in tables:
            total, known = 0.0, {}
            for word in text.split():
                raw = b" " + word.encode()
                for part in [raw[i : i + langid.LONGEST] for i in range(0, len(raw), langid.LONGEST)]:
                    if part not in known:
                        known[part] = math.log(max(plain_forward(part, table), 1e-300))
                    total += known[part]
            logs.append(total)
        top = max(logs)
        want.append((model.languages[logs.index(top)], 1.0 / sum(math.exp(x - top) for x in logs)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.lang_pred, r.score) for r in langid.predict(docs, model).orderBy("doc_id").collect()]
    assert [g for g, _ in got] == [w for w, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-9)


def test_noise_of_letters_is_in_no_language(spark, model):
    rng = random.Random(9)
    noise = lambda n: " ".join("".join(rng.choice("qxzjkvwy") for _ in range(9)) for _ in range(n))
    texts = [t for _, t, _ in corpus(8, 20)] + ["ok", "a", "Zrx"] + [noise(60), noise(400)] + ["123", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.in_language for r in langid.predict(docs, model).orderBy("doc_id").collect()]
    assert got == [True] * 63 + [False] * 4
    nothing = langid.Model(PATH, [], np.zeros((1, 0)))
    assert [r.in_language for r in langid.predict(docs, nothing).orderBy("doc_id").collect()] == [True] * 65 + [False] * 2
