"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chunked_bpe, collocations, divergence, language_id, mixing, mtree, near_vectors, ngram_join, substring_dedup, token_counts, toxicity
from .tables import SMALL_BATCH, read

Query = Callable[[SparkSession, str], DataFrame]


TOKENS_AT_MOST = 512
TOXIC_FROM = 0.3  # expected severity


def severity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Grades: clean, toxic, and toxic text of low quality."""
    documents, labels = (read(spark, sf_dir, name, SMALL_BATCH) for name in ("documents", "labels"))
    return toxicity.fit(documents, toxicity.grades(labels, F.col("toxic"), F.col("quality") == 0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is rejected."""
    scored = toxicity.score(read(spark, sf_dir, "documents").select("doc_id", "text"), severity_model(spark, sf_dir))
    return scored.select("doc_id", "severity", "any_severity", (F.col("severity") >= TOXIC_FROM).alias("toxic"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    documents = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = language_id.learn(documents.where(~held_out))
    predicted = language_id.predict(documents, model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text, there and back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts through a digest cache."""
    counted = token_counts.count_tokens_once(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKENS_AT_MOST)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of one and a half times all words, its sources weighted 5, 2, 1, repeating."""
    return mixing.mix_report(read(spark, sf_dir, "documents"), mixing.repeating_weights(5, 2, 1), share=1.5, most=2.0)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    kind = "conv_id long, turn long, role string, text string"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], kind)
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = chat.canonical_turns(chat.as_records(given.unionByName(own)), chat.PLAIN)
    return chat.conversation_digests(chat.format_turns(turns))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    return mtree.top_k(read(spark, sf_dir, "embeddings"), k=5, scale=256, every=50)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.98 or more."""
    return near_vectors.near_duplicates(read(spark, sf_dir, "embeddings"), least_cosine=0.98)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of Jaccard 0.9 or more on three-word shingles, as components."""
    return ngram_join.jaccard_groups(read(spark, sf_dir, "documents"), ngram_join.Rule(n=3, percent=90))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 words, removed."""
    return substring_dedup.removal_digests(read(spark, sf_dir, "documents"), window=35, start=18)


def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE with word ends of every text by chunks, there and back."""
    return chunked_bpe.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in terms that thirty documents share."""
    return divergence.divergence(read(spark, sf_dir, "documents"), least=30, report=50)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language whose words hold together best."""
    return collocations.collocations(read(spark, sf_dir, "documents"), least=30, absorbed=80, report=2000)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_toxicity, op2_byte_bpe, op3_language_id, op4_chat_format, op5_ngram_jaccard_join, op6_substring_dedup, op7_token_counts, op8_exact_top_k,
    op9_embedding_near_dedup, op10_mixing, op11_chunked_bpe, op12_source_divergence, op13_collocations,
)}
SQL: dict[str, str] = {op12_source_divergence.__name__: divergence.SQL, op13_collocations.__name__: collocations.SQL}
