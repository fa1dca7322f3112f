"""BPE of a tokenizer file by reuse of content-defined chunks.

A rolling hash over the last ``REACH`` bytes cuts every text where its low bits are zero, so
equal passages are cut alike wherever they stand.  Chunks that occur more than once in the
corpus are encoded once; a text is put together from their ids and those of its own chunks.

A cut may fall inside a word, so the ids around a join are wrong.  They are repaired by
encoding the join again: the span grows, over as many chunks as it takes, until it begins
and ends at white space.  There both sides agree exactly with the encoding of the whole
text, because a tokenizer of this kind never looks across white space (``Coder`` probes it).

Texts without a shared chunk are encoded where they are read and never move.  Of the others
only ids and one copy of every shared chunk move.  Which chunks are shared is counted
exactly by their 128-bit digests; reading tasks ask a filter of fixed size, whose errors
make a chunk travel that need not (all of them would, in the largest corpora) and change
no result.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .key_filter import KeyFilter, key_filter
from .scratch import Scratch

REACH = 32  # bytes that decide a cut
MEAN, LEAST, MOST = 1 << 10, 1 << 8, 1 << 14  # bytes of a chunk
FILTER_BITS = 1 << 25  # of shared digests, 4 MB
KNOWN = 200_000  # words in each of the two generations that a worker remembers
PORTION = 1 << 22  # bytes of text encoded at a time

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ENCODED, _DECODED = "doc_id long, ids binary", "doc_id long, ids binary, decoded string"
_PART = "row long, doc_id long, at int, first long, second long, ids binary, head binary, tail binary, closed boolean, n_head int, n_tail int"


def _candidates(data: np.ndarray) -> np.ndarray:
    """Positions whose ``REACH`` bytes before have a hash that cuts, at starts of characters."""
    found = []
    for begin in range(0, len(data), W.CHUNK):
        part = data[max(0, begin - REACH) : begin + W.CHUNK]
        if len(part) <= REACH:
            continue
        up = W._power(W._BASE, "up", len(part))
        total = np.cumsum(W._BYTE[part] * up, dtype=np.uint64)
        reach = total[REACH - 1 : -1].copy()
        reach[1:] -= total[: len(reach) - 1]
        h = W.mix(reach * W._power(W._INVERSE, "down", len(part) + 1)[: len(reach)])
        at = np.flatnonzero((h & np.uint64(MEAN - 1)) == 0) + REACH
        found.append(at[(part[at] & 0xC0) != 0x80] + max(0, begin - REACH))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each text ``data[at[i]:at[i + 1]]`` the ends of its chunks, relative to its start."""
    where, out = _candidates(data), []
    bounds = np.searchsorted(where, at)
    for i in range(len(at) - 1):
        begin, end, last, ends = int(at[i]), int(at[i + 1]), 0, []
        for p in [*(where[bounds[i] : bounds[i + 1]] - begin).tolist(), end - begin]:
            while p - last > MOST:  # no cut for long: one after MOST bytes
                last += MOST
                while data[begin + last] & 0xC0 == 0x80:
                    last -= 1
                ends.append(last)
            if p - last >= LEAST:
                ends.append(p)
                last = p
        if end - begin > last:
            ends.append(end - begin)
        out.append(ends)
    return out


def digest(chunk: bytes) -> tuple[int, int]:
    """128 bits of a chunk."""
    both = blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


class Coder:
    """Ids of many words at once; remembers words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to share out
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        probe = ["It's", "x9,", "(é)", "日本", "é"]
        if self._ids([" \n".join(probe)])[0] != b"".join(self._ids(probe)):
            raise ValueError(f"{path} looks across white space; its texts cannot be encoded word by word")

    def _ids(self, texts: list[str]) -> list[bytes]:
        few = (texts[i : i + 500] for i in range(0, len(texts), 500))
        return [array("I", e.ids).tobytes() for part in few for e in self.library.encode_batch_fast(part, add_special_tokens=False)]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        again = [w for w, ids in zip(distinct, found) if ids is None]
        if again:
            if len(self.known) > KNOWN:  # words not met since the last change of generations go
                self.known, self.older, again = {}, self.known, distinct
            new = dict(zip(again, map(self.older.get, again)))
            missing = [w for w, ids in new.items() if ids is None]
            new.update(zip(missing, self._ids(missing)))
            self.known.update(new)
        lists = [self.known[w] for w in distinct] if again else found
        lengths = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        flat = np.frombuffer(b"".join(lists), np.uint32)
        word = coded.indices.to_numpy()
        counts = lengths[word]
        begins = (np.cumsum(lengths) - lengths)[word]
        ends = np.cumsum(counts)
        return flat[np.repeat(begins - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)], counts

    def spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, end of each word's ids, word starts, word ends, first word of each text) of texts side by side."""
        starts, ends, first = W.spans(data, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), starts, ends, first
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] = 1
        np.subtract.at(inside, ends, 1)
        letters = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)] if len(data) else data
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])
        ids, counts = self.words(words)
        return ids, np.concatenate([[0], np.cumsum(counts)]), starts, ends, first

    def text(self, raw: bytes) -> np.ndarray:
        return self.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    return Coder(path)


def shared_chunks(docs: DataFrame) -> KeyFilter:
    """The filter of the chunks that occur more than once in ``docs``.

    Digests are counted exactly, combined in each task first.
    """
    def digests(batches):
        for batch in batches:
            for _, _, data, at in W.chunks(batch.column(0), PORTION):
                found: dict[tuple[int, int], int] = {}
                for i, ends in enumerate(cuts(data, at)):
                    begin = last = int(at[i])
                    for end in ends:
                        key = digest(data[last : begin + end].tobytes())
                        found[key] = found.get(key, 0) + 1
                        last = begin + end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())],
                    ["first", "second", "n"])

    several = (
        docs.select("text").mapInArrow(digests, "first long, second long, n long")
        .groupBy("first", "second").agg(F.sum("n").alias("n")).where("n > 1")
    )
    return key_filter(several.select("first", "second"), FILTER_BITS)


def _layout(data: np.ndarray, at: np.ndarray, marked: KeyFilter) -> list[list[tuple[int, int, tuple[int, int] | None]]]:
    """For each text its parts: (start, end, digest) of a shared chunk, (start, end, None) of a run of others."""
    texts = []
    for i, ends in enumerate(cuts(data, at)):
        begin = last = int(at[i])
        parts: list[tuple[int, int, tuple[int, int] | None]] = []
        for end in ends:
            key = digest(data[last : begin + end].tobytes())
            if marked.has_one(*key):
                parts.append((last, begin + end, key))
            elif parts and parts[-1][2] is None:
                parts[-1] = (parts[-1][0], begin + end, None)
            else:
                parts.append((last, begin + end, None))
            last = begin + end
        texts.append(parts)
    return texts


def _edges(coded: tuple, i: int, begin: int, end: int, data: np.ndarray) -> tuple:
    """ids, head, tail, closed, n_head, n_tail of text ``i`` (``data[begin:end]``) of ``Coder.spans``.

    ``head`` are the bytes before the first white space, ``tail`` those after the last, with
    the number of ids each has here.  Without white space (not ``closed``) all is head.
    """
    ids, word_at, starts, ends, first = coded
    a, b = int(first[i]), int(first[i + 1])
    own = ids[word_at[a] : word_at[b]]
    if a == b:
        return own.tobytes(), b"", b"", end > begin, 0, 0
    starts_open, ends_open = starts[a] == begin, ends[b - 1] == end
    if b - a == 1 and starts_open and ends_open:
        return own.tobytes(), data[begin:end].tobytes(), b"", False, len(own), 0
    head = data[begin : ends[a]].tobytes() if starts_open else b""
    tail = data[starts[b - 1] : end].tobytes() if ends_open else b""
    return (own.tobytes(), head, tail, True,
            int(word_at[a + 1] - word_at[a]) if starts_open else 0, int(word_at[b] - word_at[b - 1]) if ends_open else 0)


def _columns(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


_PART_NAMES = ["row", "doc_id", "at", "first", "second", "ids", "head", "tail", "closed", "n_head", "n_tail"]
_PART_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.int32()]


class _Joiner:
    """Puts the ids of one text together from its parts in order."""

    def __init__(self, code: Coder):
        self.code, self.done, self.open = code, [], b""

    def add(self, ids: np.ndarray, head: bytes, tail: bytes, closed: bool, n_head: int, n_tail: int) -> None:
        if not closed:  # no white space yet: the span to encode again grows over this part
            self.open += head
            return
        if self.open and head:
            self.done.append(self.code.text(self.open + head))  # agrees with the whole text on both sides
            ids = ids[n_head:]
        elif self.open:
            self.done.append(self.code.text(self.open))
        self.done.append(ids[: len(ids) - n_tail])
        self.open = tail

    def ids(self) -> bytes:
        if self.open:
            self.done.append(self.code.text(self.open))
        return np.concatenate(self.done).tobytes() if self.done else b""


def _parts(docs: DataFrame, path: str, shared) -> DataFrame:
    """Parts of the texts that hold shared chunks: ids of their own runs, digests and text (as ``ids``) of the others.

    The text of a shared chunk comes with its first place in a portion only.
    """
    def split(batches):
        marked, code = shared.value, coder(path)
        for batch in batches:
            row, doc = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, _, data, at in W.chunks(batch.column(2), PORTION):
                out, seen = [], set()
                mixed = [(i, parts) for i, parts in enumerate(_layout(data, at, marked)) if any(key for _, _, key in parts)]
                runs = [(a, b) for _, parts in mixed for a, b, key in parts if key is None]
                joined = np.concatenate([data[a:b] for a, b in runs]) if runs else data[:0]
                edge = np.concatenate([[0], np.cumsum([b - a for a, b in runs])]).astype(np.int64)
                coded, n = code.spans(joined, edge), 0
                for i, parts in mixed:
                    for k, (a, b, key) in enumerate(parts):
                        if key is None:
                            out.append((row[begin + i], doc[begin + i], k, None, None, *_edges(coded, n, int(edge[n]), int(edge[n + 1]), joined)))
                            n += 1
                        else:
                            text = None if key in seen else data[a:b].tobytes()
                            seen.add(key)
                            out.append((row[begin + i], doc[begin + i], k, *key, text, None, None, None, None, None))
                if out:
                    yield _columns(out, _PART_NAMES, _PART_KINDS)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, _PART)


def _encoded_chunks(parts: DataFrame, path: str) -> DataFrame:
    """Every shared chunk encoded once: ``first, second, ids, head, tail, closed, n_head, n_tail``."""
    def encode(batches):
        code = coder(path)
        for batch in batches:
            first, second, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            texts = batch.column(2).cast(pa.large_binary()).view(pa.large_string())
            for begin, _, data, at in W.chunks(texts, PORTION):
                coded = code.spans(data, at)
                for i in range(len(at) - 1):
                    out.append((first[begin + i], second[begin + i], *_edges(coded, i, int(at[i]), int(at[i + 1]), data)))
            yield _columns(out, _PART_NAMES[3:], _PART_KINDS[3:])

    chunks = parts.where("first is not null and ids is not null").groupBy("first", "second").agg(F.first("ids").alias("text"))
    return chunks.mapInArrow(encode, _PART.split("at int, ")[1])


def _assembled(parts: DataFrame, path: str, decoded: bool) -> DataFrame:
    """``doc_id, ids`` (and ``decoded``) of texts from all their parts."""
    def join(batches):
        code, current, doc, joiner = coder(path), None, None, None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7, 8)]
            for row, doc_id, ids, *edges in zip(*columns):
                if row != current:
                    if joiner:
                        out.append((doc, joiner.ids()))
                    current, doc, joiner = row, doc_id, _Joiner(code)
                joiner.add(np.frombuffer(ids, np.uint32), *edges)
            yield _columns(out, ["doc_id", "ids"], [pa.int64(), pa.binary()])
        if joiner:
            yield _columns([(doc, joiner.ids())], ["doc_id", "ids"], [pa.int64(), pa.binary()])

    own = ["ids", "head", "tail", "closed", "n_head", "n_tail"]
    chunks = _encoded_chunks(parts, path)
    given = parts.where("first is not null").select("row", "doc_id", "at", "first", "second").join(chunks, ["first", "second"])
    whole = parts.where("first is null").select("row", "doc_id", "at", *own).unionByName(given.select("row", "doc_id", "at", *own))
    return whole.repartition("row").sortWithinPartitions("row", "at").mapInArrow(
        (lambda batches: _with_text(join(batches), path)) if decoded else join, _DECODED if decoded else _ENCODED)


def _unshared(docs: DataFrame, path: str, shared, decoded: bool) -> DataFrame:
    """``doc_id, ids`` (and ``decoded``) of the texts without a shared chunk."""
    def encode(batches):
        marked, code = shared.value, coder(path)
        for batch in batches:
            doc = batch.column(0).to_pylist()
            for begin, _, data, at in W.chunks(batch.column(1), PORTION):
                plain = [i for i, parts in enumerate(_layout(data, at, marked)) if not any(key for _, _, key in parts)]
                joined = np.concatenate([data[at[i] : at[i + 1]] for i in plain]) if plain else data[:0]
                edge = np.concatenate([[0], np.cumsum([at[i + 1] - at[i] for i in plain])]).astype(np.int64)
                ids, word_at, _, _, first = code.spans(joined, edge)
                yield _columns(
                    [(doc[begin + i], ids[word_at[first[n]] : word_at[first[n + 1]]].tobytes()) for n, i in enumerate(plain)],
                    ["doc_id", "ids"], [pa.int64(), pa.binary()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        (lambda batches: _with_text(encode(batches), path)) if decoded else encode, _DECODED if decoded else _ENCODED)


def encode(docs: DataFrame, path: str, scratch: Scratch, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` (and ``decoded``, see ``decode``) of every row of ``docs (doc_id, text, ...)``: little-endian unsigned 32-bit ids.

    As the tokenizers library encodes with the file at ``path``, without added special
    tokens.  Null and empty texts have no ids; repeated rows and ids repeat; other columns
    are not looked at.  The result reads tables of ``scratch``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs))  # FILTER_BITS / 8 bytes
    parts = scratch.table(_parts(docs, path, shared))
    return _unshared(docs, path, shared, decoded).unionByName(_assembled(parts, path, decoded))


@lru_cache(maxsize=1)
def _tokens(path: str) -> pa.Array | None:
    """Text of every id, or None where the file has a decoder of its own."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    if library.decoder is not None:
        return None
    return pa.array([library.id_to_token(i) for i in range(library.get_vocab_size())], pa.large_string())


def _with_text(batches, path: str):
    """Batches of ``doc_id, ids`` with the library's text as a third column."""
    tokens = _tokens(path)
    for batch in batches:
        raw = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        data, at = W.buffer(raw.view(pa.large_string()))
        for a in range(0, len(raw), 512):
            b = min(len(raw), a + 512)
            ids = np.frombuffer(data[at[a] : at[b]].tobytes(), np.uint32)
            edge = (at[a : b + 1] - at[a]) // 4
            if tokens is None:
                out = pa.array([coder(path).library.decode(ids[x:y].tolist(), skip_special_tokens=False) for x, y in zip(edge, edge[1:])], pa.string())
            else:
                known = ids < len(tokens)  # others have no text
                edge = np.concatenate([[0], np.cumsum(known)])[edge]
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), tokens.take(pa.array(ids[known])))
                out = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), out], ["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of ``doc_id, ids``: the library's text, special tokens included.

    Null ids have an empty text; ids that the file does not know have none.
    """
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _with_text(batches, path), _DECODED)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs (doc_id, text, ...)``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded
    text in UTF-8.
    """
    with Scratch(docs.sparkSession) as scratch:
        both = encode(docs, path, scratch, decoded=True)
        return scratch.result(both.select(
            "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")))
