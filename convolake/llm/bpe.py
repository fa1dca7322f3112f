"""Byte-level BPE by dynamic programming over prefixes, with exact appends and edits.

Every prefix of a byte string has exactly one encoding, so exactly one last token.  It is
the only token that ends there, encodes to itself, and forms a valid pair with the last
token of the prefix before it.  A list of these last tokens is all the state there is:

- an encoding is read backwards from the end of the list;
- appended bytes extend the list, nothing before them changes;
- after an edit the list is recomputed from the edit on, and only until as many last tokens
  in a row as the longest token has bytes agree with the old ones.

Vocabularies are rank files (``base64 rank`` per line); their path is a parameter and must
be readable on every executor.  Nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

KNOWN_PIECES = 250_000  # encoded pieces a task remembers
_NEVER = 1 << 62
_TAIL = 3  # pieces at the end of a text that appended text can change


class PrefixEncoder:
    """Encodes byte strings with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], known: int = KNOWN_PIECES):
        self.ranks, self.known = ranks, known
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._ends = ahocorasick.Automaton()  # finds the tokens that end at each byte
        for token, i in ranks.items():
            self._ends.add_word(token.decode("latin-1"), i)
        self._ends.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known_edges: dict[int, tuple[list, list] | None] = {}

    def merged(self, data: bytes) -> list[int]:
        """Encoding by the definition: merge the neighbours of least rank until none merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            known = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not known:
                break
            i = min(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list, list] | None:
        """What stands at the right and left edge of a token while it is being merged.

        Each entry is (bytes, rank at which it forms, rank at which it goes into the next
        larger one).  None if the token's own bytes encode to something else.
        """
        if token in self._known_edges:
            return self._known_edges[token]
        edges = None
        if self.merged(self.tokens[token]) == [token]:
            edges = [(self.tokens[token], token, _NEVER)], [(self.tokens[token], token, _NEVER)]
            if len(self.tokens[token]) > 1:
                left, right = self._halves(token)
                for side, half in enumerate((right, left)):
                    inner = self._edges(half)[side]
                    edges[side].extend([(inner[0][0], inner[0][1], token), *inner[1:]])
        self._known_edges[token] = edges
        return edges

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge joins."""
        data = self.tokens[token]
        for cut in range(1, len(data)):
            left, right = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
            if left is not None and right is not None and max(left, right) < token:
                if self._edges(left) and self._edges(right) and self._valid_pair(left, right, token):
                    return left, right
        raise ValueError("the vocabulary is not one of merges in the order of their ranks")

    def _valid_pair(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge across the border comes before both tokens are complete.

        ``below`` leaves merges of that rank and later out.
        """
        if below is None:
            known = self._pairs.get((left, right))
            if known is not None:
                return known
        valid = True
        for x, made_x, used_x in self._edges(left)[0]:
            for y, made_y, used_y in self._edges(right)[1]:
                rank = self.ranks.get(x + y)
                if rank is not None and (below is None or rank < below):
                    when = max(rank, made_x if len(x) > 1 else -1, made_y if len(y) > 1 else -1)
                    if when < used_x and when <= used_y:
                        valid = False
        if below is None:
            if len(self._pairs) >= self.known:
                self._pairs.clear()
            self._pairs[left, right] = valid
        return valid

    def extend(self, last: list[int], data: bytes, until: int | None = None) -> list[int]:
        """Add the last tokens of the prefixes of ``data`` that ``last`` does not cover yet."""
        pairs, done = self._pairs, len(last)
        stop = len(data) if until is None else until
        origin = max(0, done - self.longest)  # tokens that end later begin after it
        for at, token in self._ends.iter(data[origin:stop].decode("latin-1")):
            end = origin + at + 1
            if end != done + 1:
                continue  # found already
            begin = end - len(self.tokens[token])
            if begin:
                valid = pairs.get((last[begin - 1], token))
                if valid is None:
                    valid = self._edges(token) is not None and self._valid_pair(last[begin - 1], token)
            else:
                valid = self._edges(token) is not None
            if valid:
                last.append(token)
                done = end
        if done != stop:
            raise ValueError(f"the vocabulary has no token for byte {data[done]}")
        return last

    def read(self, last: list[int]) -> list[int]:
        """The token ids that a list of last tokens stands for."""
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def replace(self, last: list[int], data: bytes, start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """``data`` with ``[start:stop]`` replaced, its last tokens, and how many were recomputed."""
        edited, shift = data[:start] + new + data[stop:], len(new) - (stop - start)
        fresh, same = last[:start], 0
        while len(fresh) < len(edited):
            self.extend(fresh, edited, len(fresh) + 1)
            old = len(fresh) - 1 - shift
            same = same + 1 if old >= stop and fresh[-1] == last[old] else 0
            if same == self.longest:
                break
        done = len(fresh)
        return edited, fresh + last[done - shift :], done - start

    def encode(self, data: bytes) -> list[int]:
        return self.read(self.extend([], data))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """piece -> (token ids, their decimals joined by commas); the same pieces come again and again."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.encoder.encode(piece.encode()))
        found = ids, ",".join(map(str, ids))
        if len(piece) <= 64:
            if len(self) >= self.encoder.known:
                self.clear()
            self[piece] = found
        return found


class TextEncoder:
    """Encodes texts: each match of ``pattern`` is a piece of its own (None: no pieces)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None, known: int = KNOWN_PIECES):
        self.encoder = PrefixEncoder(ranks, known)
        self.split = regex.compile(pattern).findall if pattern else (lambda text: [text] if text else [])
        self.pieces = _Pieces(self.encoder)

    def encode(self, text: str) -> tuple[list[int], str]:
        """Token ids, and their decimals joined by commas."""
        found = list(map(self.pieces.__getitem__, self.split(text)))
        return list(chain.from_iterable(ids for ids, _ in found)), ",".join([said for _, said in found])

    def forget(self) -> None:
        """Give the memory of pieces and pairs back: a worker lives longer than its task."""
        self.pieces.clear()
        self.encoder._pairs.clear()

    def tail_tokens(self, text: str) -> int:
        """Tokens of the last pieces, which appended text can change."""
        return sum(len(self.pieces[p][0]) for p in self.split(text)[-_TAIL:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _text_encoder(path: str, pattern: str | None, known: int = KNOWN_PIECES) -> TextEncoder:
    """One for each worker process; tasks begin without remembered pieces."""
    return TextEncoder(read_ranks(path), pattern, known)


def _texts(column: pa.Array) -> Iterator[str]:
    return (t.as_py() if t.is_valid else "" for t in column)


def round_trip_digests(docs: DataFrame, path: str, pattern: str | None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs (doc_id, text, ...)``.

    The ids are hashed as decimals joined by commas, then decoded and hashed again.  A null
    text counts as empty (no tokens); repeated rows give repeated rows; no special tokens.
    """
    def run(batches):
        coder = _text_encoder(path, pattern)
        for batch in batches:
            n, said, back = [], [], []
            for text in _texts(batch.column(1)):
                ids, joined = coder.encode(text)
                n.append(len(ids))
                said.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(coder.encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str | None, known: int = KNOWN_PIECES) -> DataFrame:
    """``doc_id, n_tokens, ids, resume_tokens``: the encoding, and what later appends keep of it.

    ``known`` pieces are remembered; Python workers keep about that memory for later jobs.
    Null texts count as empty and have an empty list of ids.
    """
    def run(batches):
        coder = _text_encoder(path, pattern, known)
        for batch in batches:
            every, resume = [], []
            for text in _texts(batch.column(1)):
                every.append(np.array(coder.encode(text)[0], np.int32))
                resume.append(len(every[-1]) - coder.tail_tokens(text))
            sizes = np.array([len(e) for e in every], np.int64)
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *every])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), ids, pa.array(resume, pa.int64())], ["doc_id", "n_tokens", "ids", "resume_tokens"])
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, resume_tokens long")


def append(encoded: DataFrame, path: str, pattern: str | None) -> DataFrame:
    """Encodings of texts that grew: ``encoded`` has ``doc_id, ids, resume_tokens, addition``.

    Equal to encoding the whole new text, but only the last pieces are split again.
    """
    def run(batches):
        coder = _text_encoder(path, pattern)
        for batch in batches:
            every, resume = [], []
            for ids, kept, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _texts(batch.column(3))):
                tail = coder.encoder.decode(ids[kept:]).decode() + more
                every.append(ids[:kept] + coder.encode(tail)[0])
                resume.append(len(every[-1]) - coder.tail_tokens(tail))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, every)), pa.int64()), pa.array(every, pa.list_(pa.int32())),
                 pa.array(resume, pa.int64())], ["doc_id", "n_tokens", "ids", "resume_tokens"])
        coder.forget()

    return encoded.select("doc_id", "ids", "resume_tokens", "addition").mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, resume_tokens long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, ids``; ids that are no whole UTF-8 give null."""
    def run(batches):
        coder = _text_encoder(path, None).encoder
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                try:
                    texts.append(None if ids is None else coder.decode(ids).decode())
                except UnicodeDecodeError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
