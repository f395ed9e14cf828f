"""A corpus from raw documents to token ids: language, exact and near copies, mix of sources, tokens.

Each stage takes a session, the documents that the stage before it left, and the data directory, and
works on all of them; its result is written as Parquet and read again by the next.

Null and empty texts, and texts without a letter, have no language and go in the first stage. Repeated rows are equal texts,
of which the second stage keeps one: that with the largest id, a null id being last of all; of linked ones the third keeps
that with the smallest. Texts of any length are read whole. Null sources are a source, null labels teach nothing. Further
columns, whatever their names, are passed on up to the last stage. Empty tables pass through empty.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import exact_dedup, jaccard_join, langid, mixing, sentencepiece_codec
from siftwell.llm.common import importable, materialize

MODEL = os.environ.get("SIFTWELL_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MOST_PASSES = 1.25  # of a source, where the least passed one is taken once


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled rows teach; texts without letters go."""
    importable(spark)
    found = langid.annotate(docs, langid.learn(docs), label="__language", score="__score")
    kept = found.where(F.col("__language") != langid.UNDETERMINED)
    return kept.drop("__language", "__score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the document with the largest id."""
    importable(spark)
    return exact_dedup.deduplicated(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingle sets join, keeps the one with the smallest id."""
    importable(spark)
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document once, and those of small sources again until the mix is as even as the limit on passes lets it be."""
    importable(spark)
    return mixing.mixed(docs, budget="whole", repetition=MOST_PASSES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    importable(spark)
    model = sentencepiece_codec.read_model(spark, MODEL)
    found = sentencepiece_codec.annotate(docs, model, only=["doc_id", "lang", "source"], verify="round_trip")
    return found.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mix), ("sentencepiece", tokens)]

#: The network's decisions and the tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
