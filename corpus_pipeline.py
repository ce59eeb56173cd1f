"""A corpus from raw documents to token ids: five stages, each over all rows that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. Texts that change get a new ``n_chars``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import bpe, decontam, langid, linededup, neardup
from rosterlake.llm.runtime import written
from rosterlake.session import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like no language of the corpus go: null texts, those without a letter, and noise of letters far less
    likely than any labelled text. Where no text has a label there is nothing to compare with, and every text with a letter stays."""
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), ~langid.held_out())
    return langid.predict(docs, model).filter("in_language").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines, and single long lines, that occur earlier go from the texts."""
    kept = linededup.drop_repeated_lines(docs)
    n_chars = F.when(F.size("runs") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id. Rows that share a doc_id stay or go together."""
    gone = neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.mark(docs, items).filter(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding them again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs.select(*COLUMNS), path, public_tokenizers.PATTERN, decode=True)
    intact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), intact.alias("intact"))


STAGES = [
    ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens),
]

#: Language scores and merges by rank can't be said in SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
