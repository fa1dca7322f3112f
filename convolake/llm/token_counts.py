"""Token counts of texts through a cache keyed by content and tokenizer version.

The cache is a Parquet folder of ``version, digest, n_tokens``.  A run digests every
text, looks the digests up, encodes each distinct text that is missing once, appends the
new counts, and reads all counts from the cache.  Copies of a text are combined in each
task before anything moves, and never encoded twice in a run.

A tokenizer is a file: ``.json`` for the tokenizers library, ``.model`` for sentencepiece.
Its version is a digest of the file, the library and the library's version.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BATCH_BYTES = 1 << 19  # of text handed to the library at once
_CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {library_version(library)} {content}".encode()).hexdigest()


@lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts, with the library's defaults and no added special tokens."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share out
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]


def _portions(texts: pa.Array) -> Iterator[list[str]]:
    held, room = [], 0
    for text in texts:
        held.append(text.as_py())
        room += len(held[-1])
        if room >= BATCH_BYTES:
            yield held
            held, room = [], 0
    if held:
        yield held


def empty_as_text(text: Column) -> Column:
    """The default normalisation: null counts as the empty text, all else stays."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark, folder: str) -> DataFrame:
    """The cache in ``folder``; empty where nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHE)
    return spark.read.schema(_CACHE).parquet(folder)


def _stored(cache: DataFrame, version: str) -> DataFrame:
    # two runs at once may both have stored a digest
    return cache.where(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, normalise: Callable[[Column], Column] = empty_as_text) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs (doc_id, text, ...)``; fills ``cache``.

    ``normalise`` must not change the tokenizer's result; texts that it makes equal are
    encoded once.  Null and empty texts have no bytes and no tokens; repeated rows repeat.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    content = normalise(F.col("text"))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")

    def encode(batches):
        count = _counter(path)
        for batch in batches:
            counts = [n for texts in _portions(batch.column(1)) for n in count(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), batch.column(0), pa.array(counts, pa.int64())],
                ["version", "digest", "n_tokens"],
            )

    misses = (
        docs.select(digest, content.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
        .join(_stored(read_cache(spark, cache), version), "digest", "left_anti")
    )
    misses.mapInArrow(encode, _CACHE).write.mode("append").parquet(cache)
    rows = docs.select("doc_id", digest, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return rows.join(_stored(read_cache(spark, cache), version), "digest").select("doc_id", "n_bytes", "n_tokens")


def count_tokens_once(docs: DataFrame, path: str) -> DataFrame:
    """``count_tokens`` with a cache of its own, removed at the end."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(count_tokens(docs, path, scratch.path()))
