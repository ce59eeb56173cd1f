"""Registered queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import ann, bpe, decontam, fim, langid, linededup, neardup, pii, quality, resample, secrets, substring, urls
from rosterlake.llm.runtime import sha_hex
from rosterlake.llm.sql import SQL
from rosterlake.session import prepare, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query("op1_secret_ledger")
def op1(spark, sf_dir):
    """Secrets in every whole text, through a ledger of scanned blobs."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.find(docs, scratch_path(spark, "secret-ledger")).drop("text")
    kinds = [r.kind for r in secrets.RULES[:3]]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in kinds],
        sha_hex(secrets.listed(base)).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@query("op2_candidate_boosting_pii")
def op2(spark, sf_dir):
    """Personal data in every whole text: base spans and those that boosted trees add."""
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE],
        sha_hex(secrets.listed(F.col("base"))).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


@query("base_personal_data")
def base_personal_data(spark, sf_dir):
    """What op2 returns of the base patterns alone, which SQL can say."""
    found = pii.scanned(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE],
        sha_hex(secrets.listed(F.col("base"))).alias("base_sha256"),
    )


@query("op3_winnowed_line_dedup")
def op3(spark, sf_dir):
    """Every whole text without runs of lines, and single long lines, that occur earlier."""
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", sha_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


@query("op4_count_min_substring_dedup")
def op4(spark, sf_dir):
    """Every whole text without the words of windows that start earlier elsewhere."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", sha_hex("kept").alias("kept_sha256"))


@query("op5_weighted_url_vocabulary")
def op5(spark, sf_dir):
    """Every address judged by rule, else by vocabulary."""
    judged = urls.judge(table(spark, sf_dir, "pages", "page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op6_wu_manber_decontamination")
def op6(spark, sf_dir):
    """Benchmark windows in every whole text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontam.mark(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha_hex(F.array_join(ids, ",")).alias("items_sha256"), "contaminated",
    )


@query("op7_segmentation_marginalised_language")
def op7(spark, sf_dir):
    """Language of every whole text; a third of the documents is held out of the fit."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), ~F.col("held_out"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op8_multi_index_hamming_near_dedup")
def op8(spark, sf_dir):
    """Components of documents whose sets of four-word shingles are similar."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return neardup.near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


@query("op9_one_bit_codes")
def op9(spark, sf_dir):
    """Ten nearest neighbours of every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query("op10_backtracking_bpe")
def op10(spark, sf_dir):
    """Digests of ids and decoded bytes of every whole text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op11_radix_importance_resampling")
def op11(spark, sf_dir):
    """Weight, score and rank of every document in a draw that leans to the benchmark."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    drawn = resample.resample(docs, table(spark, sf_dir, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_piece_table_fill_in_middle")
def op12(spark, sf_dir):
    """Every whole text cut in three and arranged, and the text that its output gives back."""
    done = fim.transform(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text", "pieces")
    back = fim.restore(done, texts=False)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("op13_histogram_tree_quality")
def op13(spark, sf_dir):
    """Quality of every whole text; the labels of a quarter of the documents are held out of the fit."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    trees = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), ~quality.held_out())
    scored = quality.predict(docs, trees).withColumn("held_out", quality.held_out())
    return scored.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in QUERIES}
