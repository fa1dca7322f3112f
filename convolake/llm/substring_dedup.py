"""Repeated word windows, found level by level, and their removal.

A window is ``window`` consecutive words of one document.  Counting all of them would move
every position of the corpus.  Instead windows of a shorter length are counted first and
only those that repeat are extended to twice the length, until ``window`` is reached (an
odd length is two windows that overlap by one word) or no candidates survive.

Below the full length not every position is counted either: of each window, only the
shorter one with the smallest hash.  Equal windows choose equal ones at equal places, so
a window that repeats always has a repeated one inside: nothing is lost.

``longest_repeats`` goes on beyond ``window`` by the same doubling until nothing survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

_KEY = ["doc", "tag"]
_MOST = np.uint64(2**64 - 1)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def lengths(window: int, start: int) -> list[int]:
    """The chain of lengths that ends in ``window`` and begins at ``start`` or less."""
    chain = [window]
    while chain[0] > max(1, start):
        chain.insert(0, (chain[0] + 1) // 2)
    return chain


class _Texts:
    """Word hashes of one run of texts, and the windows of one length over them."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int):
        starts, ends, self.first = W.spans(data, at)
        self.window, self.counts = window, np.diff(self.first)
        self.h = W.hashes(data, starts, ends)
        whole = max(0, len(self.h) - window + 1)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.text = text
        #: for every word, whether a full window begins there
        self.valid = np.arange(whole) + window <= self.first[text[:whole] + 1]

    def hashes(self, n: int) -> np.ndarray:
        return np.maximum(W.windows(self.h, n), np.uint64(1))

    def second(self, n: int) -> np.ndarray:
        """32 more bits for each window, from other word hashes."""
        return (W.windows(W.mix(self.h ^ _OTHER), n) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def least(self, values: np.ndarray, n: int) -> np.ndarray:
        """For each window, the smallest of the values of its ``n``-word windows."""
        return W.sliding(values, self.window - n + 1, np.minimum)

    def chosen(self, n: int, wanted: np.ndarray) -> np.ndarray:
        """Positions of the ``n``-word windows with the smallest hash of a wanted window."""
        h, span = self.hashes(n), self.window - n + 1
        low = np.where(wanted, self.least(h, n), np.uint64(0))
        pad = np.zeros(span - 1, np.uint64)
        high = W.sliding(np.concatenate([pad, low, pad]), span, np.maximum)
        return np.flatnonzero(high == h)

    def surviving(self, n: int, positions: np.ndarray) -> np.ndarray:
        """Windows whose smallest ``n``-word window is at one of ``positions``."""
        h = self.hashes(n)
        kept = np.full(len(h), _MOST)
        kept[positions] = h[positions]
        return self.valid & (self.least(kept, n) == self.least(h, n))

    def positions(self, lists: list) -> np.ndarray:
        """Positions within each text as positions in this run."""
        parts = [np.asarray(p, np.int64) + f for p, f in zip(lists, self.first) if p]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _emit(texts: _Texts, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in the run, hash, weight) of the windows of one level.

    At full length a window that repeats inside its own text is one row of weight 2:
    it needs no other text to be repeated, so its positions need not come back.
    """
    if n < texts.window:
        at = texts.chosen(n, wanted)
        return texts.text[at], at, texts.hashes(n)[at], np.ones(len(at), np.int32)
    at, h = np.flatnonzero(wanted), texts.hashes(n)[wanted]
    again, lead = _within(texts.text[at], h, texts.second(n)[at])
    kept = ~again | lead
    return texts.text[at][kept], at[kept], h[kept], np.where(lead, 2, 1).astype(np.int32)[kept]


def _within(text: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows repeat within their text, and the first of each such group."""
    order = np.lexsort((g, h, text))
    same = np.ones(max(0, len(h) - 1), bool)
    for part in (text[order], h[order], g[order]):
        same &= part[1:] == part[:-1]
    again, lead = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    begins = np.concatenate([same, [False]]) & ~np.concatenate([[False], same]) if len(h) else np.zeros(0, bool)
    lead[order[begins]] = True
    return again, lead


def _level(rows: DataFrame, n: int, window: int, before: int | None) -> DataFrame:
    """``h, g, doc, tag, pos, weight``: the windows of ``n`` words to count on this level.

    ``h`` and ``g`` are 96 bits of hash at full length.  On shorter levels ``g`` is 0: there
    two windows of one hash only make a candidate more.

    ``rows`` are ``doc, tag, text`` and, after the first level, ``at``: the positions that
    repeated on the level before.
    """
    def emit(batches):
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, end, data, at in W.chunks(batch.column(2)):
                texts = _Texts(data, at, window)
                if not len(texts.valid):
                    continue
                wanted = texts.valid
                if before is not None:
                    lists = batch.column(3).slice(row, end - row).to_pylist()
                    wanted = texts.surviving(before, texts.positions(lists))
                text, at_, h, weight = _emit(texts, n, wanted)
                g = texts.second(n)[at_] if n == window else np.zeros(len(h), np.int32)
                pos = np.where(weight > 1, -1, at_ - texts.first[text]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(g), pa.array(doc[row + text]), pa.array(tag[row + text]),
                     pa.array(pos), pa.array(weight)],
                    ["h", "g", "doc", "tag", "pos", "weight"],
                )

    columns = [*_KEY, "text"] + (["at"] if before is not None else [])
    return rows.select(*columns).mapInArrow(emit, "h long, g int, doc long, tag long, pos int, weight int")


def _repeated(level: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, tag, at``: positions of the windows that occur more than once.

    Only hashes move to be counted, combined in each task first.  The repeated ones are written
    down: the join back to the positions then has two plain sides, and AQE splits the side
    of a window that is everywhere.
    """
    several = scratch.table(level.groupBy("h", "g").agg(F.sum("weight").alias("n")).where("n > 1").select("h", "g"))
    return level.where("pos >= 0").select("h", "g", *_KEY, "pos").join(several, ["h", "g"]).groupBy(*_KEY).agg(F.collect_set("pos").alias("at"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, tag``, a key of every row, ``text``, and all other columns as ``row``.

    Rows equal in ``doc_id`` and text share the key and are cut alike.  The tag is a short hash
    of the text; where two texts of one ``doc_id`` share it, all rows take one of 64 bits.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    doc, short, long = F.coalesce("doc_id", F.xxhash64("text")).alias("doc"), F.hash("text").cast("long"), F.xxhash64("text")
    keys = docs.select(doc, short.alias("tag"), long.alias("full")).groupBy("doc", "tag").agg(F.min("full").alias("low"), F.max("full").alias("high"))
    tag = short if keys.where("low <> high").isEmpty() else long
    return docs.select(doc, tag.alias("tag"), "text", F.struct(*others).alias("row"))


def _removed(raw: bytes, at, window: int) -> np.ndarray:
    """For each word of a text whether a repeated window covers it."""
    texts = _Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), window)
    again, _ = _within(np.zeros(len(texts.valid), np.int64), texts.hashes(window), texts.second(window))
    starts = np.union1d(np.flatnonzero(again), np.asarray(at if at is not None else [], np.int64))
    edge = np.zeros(len(texts.h) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def cut_words(raw: bytes, removed: np.ndarray) -> bytes:
    """``raw`` without the removed words and the white space after them; all else stays."""
    starts, ends, _ = W.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    kept, done = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        kept.append(raw[done : starts[a]])
        done = starts[b] if b < len(starts) else ends[-1]
    return b"".join([*kept, raw[done:]])


def repeated_windows(docs: DataFrame, window: int, start: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents without candidates, candidate documents with ``at``).

    Both have ``text`` and, as ``row``, the other columns; ``at`` are the positions of windows that
    also occur in another row.  Texts are moved once.
    """
    rows, chain = _keyed(docs), lengths(window, start)
    columns = [*_KEY, "text", "row"]
    found = _repeated(_level(rows, chain[0], window, None), scratch)
    if len(chain) == 1:
        return rows.limit(0).select(columns), rows.join(found, _KEY, "left").select(*columns, "at")
    split = scratch.table(rows.join(found, _KEY, "left").select(*columns, "at"))
    quiet, loud = split.where("at is null"), split.where("at is not null")
    for before, n in zip(chain, chain[1:]):
        found = _repeated(_level(loud, n, window, before), scratch)
        last = loud.drop("at").join(found, _KEY, "left")
        if n == window:
            return quiet, last
        loud = scratch.table(last)
        quiet, loud = quiet.unionByName(loud.where("at is null")), loud.where("at is not null")
    raise AssertionError("unreachable")


def _digest(rows: DataFrame, window: int | None) -> DataFrame:
    def cut(batches):
        for batch in batches:
            n, gone, sha = [], [], []
            lists = batch.column(2).to_pylist() if window else [None] * batch.num_rows
            for text, at in zip(batch.column(1), lists):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = raw.split()  # bytes.split knows the same six separators
                removed = _removed(raw, at, window) if window else np.zeros(0, bool)
                n.append(len(words))
                gone.append(int(removed.sum()))
                kept = compress(words, ~removed) if gone[-1] else words
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    columns = ["row.doc_id", "text"] + (["at"] if window else [])
    return rows.select(*columns).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def removal_digests(docs: DataFrame, window: int = 50, start: int = 18) -> DataFrame:
    """Per row of ``docs (doc_id, text, ...)``: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes when a window that covers it also begins anywhere else, in the same text
    or another row's.  Windows are judged on the input.  Null and empty texts have no
    words; texts shorter than a window keep all; repeated rows repeat each other's windows.
    """
    with Scratch(docs.sparkSession) as scratch:
        quiet, loud = repeated_windows(docs.select("doc_id", "text"), window, start, scratch)
        return scratch.result(_digest(quiet, None).unionByName(_digest(loud, window)))


def remove_repeats(docs: DataFrame, window: int = 50, start: int = 18) -> DataFrame:
    """``docs`` with the words of repeated windows cut out of ``text``; all columns stay.

    Layout around the cuts is kept; ``n_chars``, where there is one, follows the new text.
    """
    def cut(batches):
        for batch in batches:
            out = []
            for text, at in zip(batch.column(0), batch.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes() if text.is_valid else None
                removed = _removed(raw, at, window) if raw else np.zeros(0, bool)
                out.append(cut_words(raw, removed).decode() if removed.any() else text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], ["text", "row"])

    with Scratch(docs.sparkSession) as scratch:
        quiet, loud = repeated_windows(docs, window, start, scratch)
        row = quiet.schema["row"].dataType.simpleString()
        cleaned = loud.select("text", "row", "at").mapInArrow(cut, f"text string, row {row}")

        def flat(rows: DataFrame, changed: bool) -> DataFrame:
            length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
            return rows.select(*(
                F.col("text") if c == "text" else length.alias(c) if changed and c == "n_chars" else F.col("row").getField(c).alias(c)
                for c in docs.columns))

        return scratch.result(flat(quiet, False).unionByName(flat(cleaned, True)))


def longest_repeats(docs: DataFrame, window: int = 50, start: int = 18) -> DataFrame:
    """``doc_id, longest`` of ``docs (doc_id, text, ...)``: the longest of window, 2 window, 4 window ... that repeats in a row's text.

    Rows without a repeated window are left out.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = _keyed(docs)
        found = _repeated(_level(rows, lengths(window, start)[0], window, None), scratch)
        if len(lengths(window, start)) > 1:
            level = _Plain.level(rows.join(found, _KEY), window)
        else:
            level = _Plain.level(rows, window)
        n, reached = window, None
        while True:
            several = level.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
            level = scratch.table(level.join(several, "h"))
            if level.isEmpty():
                break
            now = level.select(*_KEY, F.lit(n).alias("longest")).distinct()
            reached = now if reached is None else reached.unionByName(now)
            later = level.select(*_KEY, (F.col("pos") - n).alias("pos"), F.col("h").alias("next"))
            level = level.join(later, [*_KEY, "pos"]).select(F.xxhash64("h", "next").alias("h"), *_KEY, "pos")
            n *= 2
        if reached is None:
            return rows.select("row.doc_id", F.lit(0).alias("longest")).limit(0)
        most = reached.groupBy(*_KEY).agg(F.max("longest").alias("longest"))
        return scratch.result(rows.select("row.doc_id", *_KEY).join(most, _KEY).select("doc_id", "longest"))


class _Plain:
    """All full windows of candidate texts with their positions, for ``longest_repeats``."""

    @staticmethod
    def level(rows: DataFrame, window: int) -> DataFrame:
        def emit(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for row, _, data, at in W.chunks(batch.column(2)):
                    texts = _Texts(data, at, window)
                    pos = np.flatnonzero(texts.valid)
                    text = texts.text[pos]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(texts.hashes(window)[pos].view(np.int64) if len(pos) else np.zeros(0, np.int64)),
                         pa.array(doc[row + text]), pa.array(tag[row + text]), pa.array((pos - texts.first[text]).astype(np.int32))],
                        ["h", "doc", "tag", "pos"],
                    )

        return rows.select(*_KEY, "text").mapInArrow(emit, "h long, doc long, tag long, pos int")
