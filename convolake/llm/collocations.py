"""Frequent phrases and how strongly their words hold together, after Toivonen.

A phrase can only be frequent when the two phrases that lack its first or its last word are.
A sample of the documents, mined with a lowered threshold, proposes phrases.  One pass over
all documents then counts every proposed phrase together with the negative border:
the phrases that were not proposed although both their shorter phrases were (single words
among them).  If a phrase of the border turns out frequent, the proposal was too small: it
grows by all frequent phrases found, and a further pass counts what this opens, until a pass
finds nothing new.  Nothing depends on the sample but the number of passes.

Whether a phrase is proposed, tasks learn from a filter of fixed size.  Its chance errors only
make a pass count a phrase more.  Passes count by 40 bits, which let a rare phrase pass for a
frequent one but miss none; as steps between sorted keys they take about three bytes.  What
may be frequent is then counted whole, by 128 bits, in one last pass that also reads it from
the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .groups import runs
from .key_filter import KeyFilter, key_filter
from .scratch import Scratch

LONGEST = 4  # words of a phrase
PORTION = 1 << 21  # bytes of text worked on at a time
ONE_IN = 8  # documents of the sample
SALTS = 64  # parts of a language that are ranked before the whole
SHORT = 40  # bits of a phrase's key that decide whether it may be frequent
BUCKET_BITS = 11  # of these, those that say where its numbers are added up
HELD = 1 << 22  # keys that a task holds before it sends them
PHRASES = 1 << 20  # that a task holds with their texts

_ENDS = np.zeros(256, bool)  # bytes that end a piece
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _ENDS.copy()  # bytes that part words
_OUTSIDE[[0x20, 0x09]] = True
_OTHER = np.uint64(0x5851F42D4C957F2D)


class _Phrases:
    """The words of a run of texts and keys of the phrases that begin at each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang: np.ndarray):
        self.data = data
        self.starts, self.ends, first = W.spans(data, at, _OUTSIDE)
        self.per_text = np.diff(first)
        self.text = np.repeat(np.arange(len(at) - 1), self.per_text)
        self.lang = lang[self.text]
        pieces = np.searchsorted(np.flatnonzero(_ENDS[data]), self.starts)
        #: of every word whether the next one stands in the same piece
        self.joined = np.zeros(len(self.starts), bool)
        self.joined[:-1] = (pieces[1:] == pieces[:-1]) & (self.text[1:] == self.text[:-1])
        self.hashes = W.hashes(data, self.starts, self.ends, lower=True)
        self.word = W.pair(self.lang, self.hashes)

    def open(self, known: KeyFilter, before: KeyFilter | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of words, first words, keys, whether known) of the open phrases, by their number of words.

        A phrase is open when both phrases that are one word shorter are known; words always
        are.  Those that ``before`` opened already are passed over.
        """
        rows, first, n_words = np.arange(len(self.word)), self.word, len(self.word)
        is_known = was_known = np.ones(n_words + 1, bool)
        for n in range(1, LONGEST + 1):
            if n > 1:
                opened = self.joined[rows + n - 2] & is_known[rows + 1]
                rows = rows[opened]
                first = W.pair(first[opened], self.word[rows + n - 1])
            known_now = known.has(*_tests(first))
            if before is None:
                yield n, rows, first, known_now
            else:
                was_open = was_known[rows] & (was_known[rows + 1] if n > 1 else True)
                yield n, rows[~was_open], first[~was_open], known_now[~was_open]
                old = np.flatnonzero(was_open)
                old = old[before.has(*_tests(first[old]))]
                was_known = np.zeros(n_words + 1, bool)
                was_known[rows[old]] = True
            rows, first = rows[known_now], first[known_now]
            is_known = np.zeros(n_words + 1, bool)
            is_known[rows] = True

    def second(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Second keys of phrases of ``n`` words; they begin with ``n``, in three bits."""
        def word(at):
            return W.mix(self.hashes[at] * W._RIGHT ^ self.lang[at] ^ (self.ends[at] - self.starts[at]).astype(np.uint64))

        second = word(rows)
        for k in range(1, n):
            second = W.mix(second * W._BASE + word(rows + k) ^ _OTHER)
        return second >> np.uint64(3) | np.uint64(n << 61)

    def said(self, row: int, n: int, lower: np.ndarray) -> bytes:
        return b" ".join([lower[self.starts[i] : self.ends[i]].tobytes() for i in range(row, row + n)])


def _tests(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands for a phrase in a filter: ``SHORT`` bits of its key, and a hash of them."""
    short = first >> np.uint64(64 - SHORT)
    return short, W.mix(short * W._BASE ^ _OTHER)


def _names(batch: pa.RecordBatch, column: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct values of a text column, each row's number, and a hash of each value."""
    coded = batch.column(column).dictionary_encode()
    data, at = W.buffer(coded.dictionary)
    hashes = W.mix(W.hashes(data, at[:-1], at[1:]) + np.diff(at).astype(np.uint64)) if len(coded.dictionary) else np.zeros(0, np.uint64)
    return coded.dictionary, coded.indices.to_numpy(), hashes


def _merged(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their numbers or the sums of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _packed(keys: np.ndarray, longest: bool, least: int) -> pa.RecordBatch:
    """One row for each bucket: its short keys as steps and their numbers, byte by byte, compressed.

    What a task sends for a phrase is about three bytes.  Numbers are cut at ``least``, which is
    all that is asked.
    """
    keys, n = _merged(keys)
    width = np.uint64(SHORT) - np.uint64(BUCKET_BITS)
    bucket = (keys >> width).astype(np.int64)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), bucket[1:] != bucket[:-1]]))
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[at] = keys[at] & ((np.uint64(1) << width) - np.uint64(1))
    steps, n = steps.astype("<u4").view(np.uint8).reshape(-1, 4), np.minimum(n, least).astype("<u4").view(np.uint8).reshape(-1, 4)
    ends = np.append(at[1:], len(keys)).tolist()
    raw = [pa.compress(steps[a:b].T.tobytes() + n[a:b].T.tobytes(), codec="zstd", asbytes=True) for a, b in zip(at.tolist(), ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[at] + (longest << BUCKET_BITS)), pa.array(np.diff(np.append(at, len(keys)))), pa.array(raw, pa.binary())], ["bucket", "n", "raw"])


def _pass(docs: DataFrame, known: KeyFilter, before: KeyFilter | None, least: int) -> DataFrame:
    """``first, second, longest``: what ``_tests`` gives for the phrases that may be frequent, of those that
    ``known`` opens and ``before`` did not; ``longest`` tells that no phrase is made of them.

    Counts are by short keys, so that a phrase may pass for another one; none that is frequent is missed.
    """
    def count(batches):
        held, n_held = ([], []), 0

        def send():
            for longest in (False, True):
                if held[longest]:
                    yield _packed(np.concatenate(held[longest]), longest, least)
                held[longest].clear()

        for batch in batches:
            _, which, hashes = _names(batch, 1)
            lang = hashes[which]
            for row, end, data, at in W.chunks(batch.column(0), PORTION):
                for n, _, first, _ in _Phrases(data, at, lang[row:end]).open(known, before):
                    held[n == LONGEST].append(_tests(first)[0])
                    n_held += len(first)
                if n_held > HELD:
                    yield from send()
                    n_held = 0
        yield from send()

    def add(batches):
        for (bucket,), table in runs(batches, 1):
            keys, counts = [], []
            for n, raw in zip(table["n"].to_pylist(), table["raw"]):
                both = np.frombuffer(pa.decompress(raw.as_buffer(), 8 * n, codec="zstd"), np.uint8).reshape(2, 4, n)
                steps, numbers = (np.ascontiguousarray(x.T).view("<u4").reshape(-1) for x in both)
                keys.append(np.cumsum(steps, dtype=np.uint64))
                counts.append(numbers.astype(np.int64))
            rest, total = _merged(np.concatenate(keys), np.concatenate(counts))
            longest, bucket = divmod(bucket, 1 << BUCKET_BITS)
            short = np.uint64(bucket << (SHORT - BUCKET_BITS)) | rest[total >= least]
            first, second = _tests(short << np.uint64(64 - SHORT))
            yield pa.RecordBatch.from_arrays(
                [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.full(len(first), bool(longest)))], ["first", "second", "longest"])

    return (
        docs.select("text", "lang").mapInArrow(count, "bucket long, n long, raw binary")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "first long, second long, longest boolean")
    )


def frequent(docs: DataFrame, least: int, scratch: Scratch, known: KeyFilter | None = None) -> tuple[DataFrame, KeyFilter]:
    """(``first, second`` of all phrases of ``docs`` that may occur ``least`` times, the filter of the shorter ones).

    ``known`` are proposed phrases.  Passes go on until the border holds no frequent phrase.
    """
    known, before, found = known or KeyFilter.empty(), None, None
    while True:
        rows = scratch.table(_pass(docs, known, before, least))
        found = rows if found is None else found.unionByName(rows)
        grown = known.united(key_filter(rows.where("not longest").select("first", "second")))
        if grown == known:
            return found.select("first", "second"), known
        known, before = grown, known


def _counts(docs: DataFrame, often: KeyFilter, least: int) -> DataFrame:
    """``lang, phrase, words, a`` of the frequent phrases in ``often``, and each language's number of words as a null phrase.

    Phrases are counted whole by 128 bits.  A task reads a phrase once from the texts and sends
    those of a language and bucket together, compressed.
    """
    kind = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("bytes", pa.int64()), ("raw", pa.binary())])

    def count(batches):
        none = np.zeros(0, np.uint64)
        first, second, place, n_words = none, none, np.zeros(0, np.int64), {}
        a, said = np.zeros(0, np.int64), []  # by place

        def send():
            langs = {lang: i for i, lang in enumerate(n_words)}
            lang = np.array([langs[x] for x, _ in said], np.int64)[place]
            order = np.lexsort((first, lang))
            lang, keys, other, at_ = lang[order], first[order], second[order], place[order]
            bucket = (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1])]))
            ends = np.append(new[1:], len(keys)).tolist()
            raw = [pa.compress(
                keys[i:j].tobytes() + other[i:j].tobytes() + a[at_[i:j]].tobytes() + b"\n".join([said[k][1] for k in at_[i:j].tolist()]),
                codec="zstd", asbytes=True) for i, j in zip(new.tolist(), ends)]
            lengths = [24 * (j - i) + sum(len(said[k][1]) + 1 for k in at_[i:j].tolist()) - 1 for i, j in zip(new.tolist(), ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[new]), pa.array(list(n_words), pa.string()).take(pa.array(lang[new])),
                 pa.array(np.diff(np.append(new, len(keys)))), pa.array(lengths, pa.int64()), pa.array(raw, pa.binary())], schema=kind)

        for batch in batches:
            names, which, hashes = _names(batch, 1)
            names = names.to_pylist()
            for row, end, data, at in W.chunks(batch.column(0), PORTION):
                phrases = _Phrases(data, at, hashes[which[row:end]])
                for i, n in enumerate(np.bincount(which[row:end], phrases.per_text, len(names)).astype(np.int64).tolist()):
                    n_words[names[i]] = n_words.get(names[i], 0) + n
                lower = W._LOWER[data]
                for n, rows, keys, now in phrases.open(often):
                    rows, keys = rows[now], keys[now]
                    other = phrases.second(rows, n)
                    order = np.argsort(keys)
                    same = keys[order[1:]] == keys[order[:-1]]
                    if (same & (other[order[1:]] != other[order[:-1]])).any():
                        order = np.lexsort((other, keys))  # two phrases share the first key
                        same = (keys[order[1:]] == keys[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
                    once = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), ~same]))
                    times, some = np.diff(np.append(once, len(keys))), order[once]
                    rows, keys, other = rows[some], keys[some], other[some]
                    hit = np.searchsorted(first, keys)
                    is_there = np.zeros(len(keys), bool)
                    inside = np.flatnonzero(hit < len(first))
                    is_there[inside] = (first[hit[inside]] == keys[inside]) & (second[hit[inside]] == other[inside])
                    a[place[hit[is_there]]] += times[is_there]
                    new = np.flatnonzero(~is_there)
                    if len(new):
                        place = np.concatenate([place, len(said) + np.arange(len(new))])
                        said.extend((names[which[row + phrases.text[i]]], phrases.said(i, n, lower)) for i in rows[new].tolist())
                        a = np.concatenate([a, times[new]])
                        first, second = np.concatenate([first, keys[new]]), np.concatenate([second, other[new]])
                        order = np.argsort(first)
                        first, second, place = first[order], second[order], place[order]
                if len(said) > PHRASES:
                    yield send()
                    first, second, place, a, said = none, none, np.zeros(0, np.int64), np.zeros(0, np.int64), []
        yield send()
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1] * len(n_words), pa.int64()), pa.array(list(n_words), pa.string()), pa.array(list(n_words.values()), pa.int64()),
             pa.nulls(len(n_words), pa.int64()), pa.nulls(len(n_words), pa.binary())], schema=kind)

    def add(batches):
        for (bucket,), table in runs(batches, 1):
            parts: dict[str, list] = {}
            for lang, size, n_bytes, raw in zip(*(table[c].to_pylist() for c in ("lang", "n", "bytes")), table["raw"]):
                parts.setdefault(lang, []).append((size, n_bytes, raw))
            for lang, of_lang in parts.items():
                if bucket < 0:
                    total, phrases = [sum(size for size, _, _ in of_lang)], [None]
                else:
                    keys, second, counts, said = [], [], [], []
                    for size, n_bytes, raw in of_lang:
                        whole = pa.decompress(raw.as_buffer(), n_bytes, codec="zstd", asbytes=True)
                        numbers = np.frombuffer(whole, np.uint64, 3 * size).reshape(3, size)
                        for into, row in zip((keys, second, counts), numbers):
                            into.append(row)
                        said += whole[24 * size :].split(b"\n")
                    keys, second, counts = (np.concatenate(x) for x in (keys, second, counts))
                    order = np.lexsort((second, keys))
                    keys, second = keys[order], second[order]
                    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (second[1:] != second[:-1])]))
                    total = np.add.reduceat(counts[order].astype(np.int64), at)
                    often_ = np.flatnonzero(total >= least)
                    total, phrases = total[often_], [said[i] for i in order[at[often_]].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                     pa.array([p and p.count(b" ") + 1 for p in phrases], pa.int32()), pa.array(total, pa.int64())], ["lang", "phrase", "words", "a"])

    return (
        docs.select("text", "lang").mapInArrow(count, "bucket long, lang string, n long, bytes long, raw binary")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "lang string, phrase string, words int, a long")
    )


def phrase_counts(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, words, a`` of all phrases of up to four words that occur ``least`` times, ``lang, n``)."""
    sample = scratch.table(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ONE_IN)) == 0).select("text", "lang"))
    _, proposed = frequent(sample, max(2, least // ONE_IN), scratch)
    found, _ = frequent(docs, least, scratch, proposed)
    rows = scratch.table(_counts(docs, key_filter(found), least))
    return rows.where("phrase is not null"), rows.where("phrase is null").select("lang", F.col("a").alias("n"))


def collocations(docs: DataFrame, least: int = 30, absorbed: int = 80, report: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of ``docs (doc_id, text, lang, ...)``: each language's best phrases.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its lowest-scoring cut, ``n`` all words
    of the language; ``score`` is ``floor(2000000 a / (l + r))``.  A phrase inside a longer one
    that occurs at least ``absorbed`` per cent as often is left out.  Null texts have no words, a
    null language is ``und``; repeated rows count again; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    with Scratch(docs.sparkSession) as scratch:
        counts, words = phrase_counts(docs, least, scratch)
        several = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
        cuts = several.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w").select(
            "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
            F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
        left = counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
        right = counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
        score = F.expr("cast(a as decimal(28,0)) * 2000000 div (cast(l as decimal(28,0)) + r)")
        lowest = (
            cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
            .groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
        )
        inside = several.where("words > 2").select(
            "lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")).select(
            "lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("from")).select(
            "lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase"), "a")
        longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        kept = lowest.join(longer, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (F.col("longer").cast("decimal(28,0)") * 100 < F.col("a").cast("decimal(28,0)") * absorbed))
        order = (F.desc("score"), F.desc("a"), "phrase")
        rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"))
        # a language is ranked in parts first
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
        best = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= report)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= report)
        return scratch.result(ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


#: The same for DuckDB over a view ``documents``.
SQL = r"""
with docs as (
  select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), pieces as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from docs
), listed as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), sizes as (
  select lang, sum(len(w))::bigint as n from listed group by lang
), placed as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from listed
), phrases as (
  select lang, array_to_string(w[i : i + k - 1], ' ') as phrase, k, count(*) as a
  from placed, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(w) group by all having count(*) >= 30
), cuts as (
  select lang, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, k)) as c from phrases where k > 1
), scored as (
  select c.lang, c.phrase, c.a, c.c, l.a as l, r.a as r, (2000000::hugeint * c.a // (l.a + r.a))::bigint as score
  from cuts c
  join phrases l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : c.c], ' ')
  join phrases r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.c + 1 : len(c.w)], ' ')
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
), parts as (
  select lang, a, w, size, unnest(range(1, len(w) - size + 2)) as i
  from (select lang, a, string_split(phrase, ' ') as w, unnest(range(2, k)) as size from phrases where k > 2)
), longer as (
  select lang, array_to_string(w[i : i + size - 1], ' ') as phrase, max(a) as most from parts group by all
)
select lang, rank, phrase, a, l, r, n, score from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
  from lowest left join longer using (lang, phrase) join sizes using (lang)
  where most is null or 100 * most < 80 * a
) where rank <= 2000
"""
