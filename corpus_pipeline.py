"""A corpus pipeline: each stage turns the documents its predecessor kept into those it keeps.

Every stage is a function (spark, docs, sf_dir) -> DataFrame, written as Parquet and read
again as the next one's input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm import bpe, mixing, ngram_join, substring_dedup, toxicity
from convolake.llm.queries import TOXIC_FROM, severity_model
from convolake.llm.scratch import Scratch
from convolake.llm.tables import SMALL_BATCH, batches_of, read

NEAR = ngram_join.Rule(n=5, percent=80)
REPEATED_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the threshold."""
    scored = toxicity.score(docs, severity_model(spark, sf_dir))
    return scored.where(F.col("severity") < TOXIC_FROM).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of smallest id."""
    batches_of(spark, SMALL_BATCH)
    return ngram_join.keep_one_of_each(docs, NEAR)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty or more words that occur more than once, cut out of the texts."""
    batches_of(spark, SMALL_BATCH)
    return substring_dedup.remove_repeats(docs, window=REPEATED_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix of one and a half times all words; a document comes as often as it is taken."""
    batches_of(spark, SMALL_BATCH)
    return mixing.mix(docs, mixing.repeating_weights(5, 2, 1), share=1.5, most=2.0)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text of the mix."""
    batches_of(spark, SMALL_BATCH)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, known=50_000).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: The model, the draws and the ids are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir))
