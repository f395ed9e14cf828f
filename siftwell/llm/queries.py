"""Registered queries of the operators: name → function of a session and a data directory."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import ann, exact_dedup, jaccard_join, langid, mixing, pii, prefix_trie, sentencepiece_codec, suffix_dedup, token_counts, toxicity, url_filter, whitening
from siftwell.llm.common import importable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The model file of the registered queries; executors get its bytes.
MODEL = os.environ.get("SIFTWELL_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op1_language_id(spark, sf_dir):
    """The language of every whole text, learnt from labelled rows that are not held out."""
    documents = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    return langid.annotate(documents, langid.learn(documents), only=["doc_id", "held_out"])


@query
def op2_exact_dedup(spark, sf_dir):
    """Exact copies among whole texts; the largest id stays."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")


@query
def op6_sentencepiece(spark, sf_dir):
    """Token ids of every whole text, and whether they decode to it."""
    return sentencepiece_codec.checked(table(spark, sf_dir, "documents"), sentencepiece_codec.read_model(spark, MODEL))


@query
def op7_token_counts(spark, sf_dir):
    """Unigram token counts of every whole text."""
    return token_counts.counts(table(spark, sf_dir, "documents"), sentencepiece_codec.read_model(spark, MODEL))


# The rules of the registered query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op9_url_filter(spark, sf_dir):
    """Verdict of every page's url under nested rules."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op5_mixing(spark, sf_dir):
    """The documents that a mix of all sources takes, no source being repeated more than 1.25 times over."""
    return mixing.realised(table(spark, sf_dir, "documents"), repetition=1.25)


@query
def op8_ann(spark, sf_dir):
    """The five nearest found for every fiftieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op4_pii(spark, sf_dir):
    """Personal data in every whole text, and the terms that reveal it."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op3_jaccard_join(spark, sf_dir):
    """Classes of documents that links of five-word shingles (0.75 or more) join."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark, sf_dir):
    """Passages of 50 bytes and more that stand in an earlier document, removed from whole texts."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark, sf_dir):
    """All embeddings on the four leading directions of their distinct vectors, with unit variance."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op12_prefix_trie(spark, sf_dir):
    """The prefix trie of all conversations, each rebuilt upon the head of its block of twenty."""
    found = prefix_trie.conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.keyed(prefix_trie.rebuilt(found)))


@query
def op13_toxicity(spark, sf_dir):
    """Toxicity of every whole text, learnt from labelled rows that are not held out."""
    documents = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.held_out("doc_id"))
    return toxicity.annotate(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")), only=["doc_id", "held_out"])
