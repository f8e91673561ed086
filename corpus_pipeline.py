"""A corpus pipeline over `documents`: language, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm.decontaminate import find_leaks
from cloudloom.llm.exact_dedup import exact_dedup
from cloudloom.llm.language_id import MIN_MARGIN, fit_dictionaries, identify
from cloudloom.llm.ngram_join import ngram_jaccard_groups
from cloudloom.llm.sentencepiece_codec import encode_decode
from cloudloom.llm.tables import attach
from cloudloom.session import new_table_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. Those without a letter, or with a lead below the operator's own margin, go."""
    judged = identify(docs, fit_dictionaries(docs), min_margin=MIN_MARGIN)
    return judged.filter(~F.col("rejected")).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of equal texts."""
    return exact_dedup(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of similar texts."""
    groups = ngram_jaccard_groups(docs)
    gone = groups.filter("doc_id <> component_id").select("doc_id", F.lit(True).alias("gone")).distinct()
    gone.write.parquet(path := new_table_path(spark, "near-copies"))
    return attach(docs, spark.read.parquet(path), ["doc_id"]).filter("gone IS NULL").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("leaks") == 0).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and a digest of the text they decode to."""
    done = encode_decode(docs, public_tokenizers.path(TOKENIZER))
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("decontamination", decontaminate),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None  # compression and token ids are beyond SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
