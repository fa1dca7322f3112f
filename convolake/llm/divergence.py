"""How the sources of a language differ in their terms: an audit by exact integer arithmetic.

A term is kept in a language when at least ``least`` of its documents hold it.  Counting every
term would move the whole vocabulary, most of it rare.  Instead byte prefixes are counted
level by level: a prefix in fewer than ``least`` documents has no kept term below it and is
discarded; only prefixes that stay are extended, to twice the length, until all terms below
them are complete.  Then their occurrences are counted by source.

Each level is one pass over the texts.  Tasks count for themselves before anything moves, and
learn which prefixes stayed from a filter of fixed size (its chance errors let a rare prefix
live one level longer; the last count is exact, by the terms themselves).

Kept terms are dealt into blocks; a block compares all sources of its language on its terms,
and the sums of the blocks are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .groups import runs
from .key_filter import KeyFilter, key_filter
from .scratch import Scratch

SCALE = 1_000_000_000
SMOOTH = 5
CELLS = 1 << 22  # of a block's matrix of sources by terms
TERMS = 1 << 12  # in a block at most
PORTION = 1 << 22  # bytes of text worked on at a time

_OUTSIDE = np.ones(256, bool)  # bytes that part terms: all of ASCII but letters
_OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_COMPLETE = np.uint64(0xA5A5F00D5EED1234)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _groups(batch: pa.RecordBatch, column: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct values of a text column, and for each row the number of its value."""
    coded = batch.column(column).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def _name_hashes(names: pa.Array) -> np.ndarray:
    """64-bit hash of every whole string."""
    data, at = W.buffer(names)
    return W.mix(W.hashes(data, at[:-1], at[1:]) + (at[1:] - at[:-1]).astype(np.uint64)) if len(names) else np.zeros(0, np.uint64)


class _Terms:
    """The terms of a run of texts: where they are, whose they are, and keys of their prefixes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang: np.ndarray):
        self.data = W._LOWER[data]
        self.starts, self.ends, first = W.spans(data, at, _OUTSIDE)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        self.lang = lang[self.text]

    def keep(self, which: np.ndarray) -> None:
        self.starts, self.ends, self.text, self.lang = (x[which] for x in (self.starts, self.ends, self.text, self.lang))

    def complete(self, length: int) -> np.ndarray:
        return self.ends - self.starts <= length

    def keys(self, length: int | None) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of language and prefix; those of a complete term differ from those of an equal prefix."""
        ends = self.ends if length is None else np.minimum(self.ends, self.starts + length)
        h = W.hashes(self.data, self.starts, ends)
        if length is None:
            h = h ^ _COMPLETE
        else:
            h = np.where(self.complete(length), h ^ _COMPLETE, h)
        first = W.pair(self.lang, h)
        return first, W.mix(first ^ _OTHER ^ (ends - self.starts).astype(np.uint64) * W._LEFT)


def _by_key(text: np.ndarray, n_texts: int, first: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """An order in which equal keys stand together, each key's rows by ``text``.

    One sort of numbers whose lowest bits are the text; where two keys agree in all other
    bits, they are sorted in full.
    """
    key = first if group is None else W.pair(group.astype(np.uint64), first)
    bits = np.uint64(max(1, (n_texts - 1).bit_length()))
    order = np.argsort((key >> bits << bits) | text.astype(np.uint64))
    key, sorted_first = key[order], first[order]
    differ = sorted_first[1:] != sorted_first[:-1]
    if group is not None:
        differ |= group[order[1:]] != group[order[:-1]]
    if (differ & ((key[1:] ^ key[:-1]) >> bits == 0)).any():
        return np.lexsort((text, first) if group is None else (text, first, group))
    return order


def _level(docs: DataFrame, before: tuple[int, KeyFilter] | None, length: int) -> DataFrame:
    """``first, second, docs, open`` of the prefixes of ``length`` bytes below those kept before."""
    def count(batches):
        for batch in batches:
            names, which = _groups(batch, 1)
            lang = _name_hashes(names)[which]
            for row, end, data, at in W.chunks(batch.column(0), PORTION):
                terms = _Terms(data, at, lang[row:end])
                if before is not None:
                    terms.keep(~terms.complete(before[0]))
                    terms.keep(before[1].has(*terms.keys(before[0])))
                first, second = terms.keys(length)
                # once for each document
                order = _by_key(terms.text, len(at) - 1, first)
                first, text = first[order], terms.text[order]
                new = np.ones(len(first), bool)
                new[1:] = first[1:] != first[:-1]
                once = new.copy()
                once[1:] |= text[1:] != text[:-1]
                at_ = np.flatnonzero(new)
                n = np.add.reduceat(once.astype(np.int64), at_) if len(at_) else np.zeros(0, np.int64)
                found = order[at_]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[at_].view(np.int64)), pa.array(second[found].view(np.int64)), pa.array(n), pa.array(~terms.complete(length)[found])],
                    ["first", "second", "docs", "open"])

    return (
        docs.select("text", "lang").mapInArrow(count, "first long, second long, docs long, open boolean")
        .groupBy("first", "second", "open").agg(F.sum("docs").alias("docs"))
    )


def _occurrences(docs: DataFrame, kept: list[tuple[int, KeyFilter]]) -> DataFrame:
    """``lang, source, term, docs, n`` of the complete terms whose prefixes stayed on their last level."""
    def count(batches):
        for batch in batches:
            langs, lang = _groups(batch, 1)
            sources, source = _groups(batch, 2)
            names = _name_hashes(langs)[lang]
            for row, end, data, at in W.chunks(batch.column(0), PORTION):
                terms = _Terms(data, at, names[row:end])
                first, second = terms.keys(None)  # a complete term has the same keys at every length
                stays, open_ = np.zeros(len(terms.starts), bool), np.ones(len(terms.starts), bool)
                for length, known in kept:
                    now = open_ & terms.complete(length)
                    rows = np.flatnonzero(now)
                    stays[rows] = known.has(first[rows], second[rows])
                    open_ &= ~now
                terms.keep(stays)
                first = first[stays]
                if not len(terms.starts):
                    continue
                group = lang[row + terms.text].astype(np.int64) * len(sources) + source[row + terms.text]
                order = _by_key(terms.text, len(at) - 1, first, group)
                first, group, text = first[order], group[order], terms.text[order]
                new = np.ones(len(first), bool)
                new[1:] = (first[1:] != first[:-1]) | (group[1:] != group[:-1])
                once = new.copy()
                once[1:] |= text[1:] != text[:-1]
                at_ = np.flatnonzero(new)
                n_docs, n = np.add.reduceat(once.astype(np.int64), at_), np.diff(np.append(at_, len(first)))
                together = np.argsort(group[at_], kind="stable")  # equal names in a row take less when they move
                at_, n_docs, n = at_[together], n_docs[together], n[together]
                found = order[at_]
                letters = [terms.data[a:b].tobytes() for a, b in zip(terms.starts[found].tolist(), terms.ends[found].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(group[at_] // len(sources))), sources.take(pa.array(group[at_] % len(sources))),
                     pa.array(letters, pa.binary()).cast(pa.string()), pa.array(n_docs),
                     pa.array(n)],
                    ["lang", "source", "term", "docs", "n"])

    return (
        docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, docs long, n long")
        .groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    )


def kept_terms(docs: DataFrame, least: int, scratch: Scratch, length: int = 6) -> DataFrame:
    """``lang, source, term, n`` of every kept term where it occurs; ``docs (text, lang, source, ...)`` has no nulls.

    A term counts as often as a document holds it, a document once for a term; repeated
    rows are documents of their own.
    """
    kept: list[tuple[int, KeyFilter]] = []
    while True:
        level = scratch.table(_level(docs, kept[-1] if kept else None, length).where(F.col("docs") >= least))
        kept.append((length, key_filter(level.select("first", "second"))))
        if level.where("open").isEmpty():
            break
        length *= 2
    counts = scratch.table(_occurrences(docs, kept))
    enough = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    return scratch.table(counts.join(enough, ["lang", "term"]).select("lang", "source", "term", "n"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms))`` by long division, exact below 9e15 words."""
    below = total + SMOOTH * terms
    out, rest = np.divmod(counts.astype(np.int64) + SMOOTH, below)
    for _ in range(3):  # SCALE is 1,000 three times
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def _compared(blocks: DataFrame, report: int) -> DataFrame:
    """Of every block of terms: sums of differences of its pairs of sources, and its foremost terms.

    ``blocks`` are ``lang_no, block, kind, lang, source, term, n, total, terms``: first, as kind 0, all
    sources of the language with their totals, '' as term; the language as a whole as kind 1;
    then, as kind 2, the counts above zero.
    """
    def compare(batches):
        for _, table in runs(batches, 2):
            kind = table["kind"].to_numpy()
            sources = {s: i for i, s in enumerate(sorted(table["source"].filter(pa.array(kind == 0)).to_pylist(), key=str.encode))}
            totals = dict(zip(table["source"].filter(pa.array(kind == 0)).to_pylist(), table["total"].filter(pa.array(kind == 0)).to_pylist()))
            whole = table["total"].filter(pa.array(kind == 1))[0].as_py()
            n_terms, lang = table["terms"][0].as_py(), table["lang"][0].as_py()
            cells = table.filter(pa.array(kind == 2))
            terms = sorted(set(cells["term"].to_pylist()), key=str.encode)
            place = {t: i for i, t in enumerate(terms)}
            counts = np.zeros((len(sources), len(terms)), np.int64)
            r = np.array([sources[s] for s in cells["source"].to_pylist()], np.int64)
            c = np.array([place[t] for t in cells["term"].to_pylist()], np.int64)
            counts[r, c] = cells["n"].to_numpy()
            names = list(sources)
            all_p = shares(counts.sum(0), whole, n_terms)
            p = np.stack([shares(counts[i], totals[s], n_terms) for s, i in sources.items()]) if names else counts
            for i, s in enumerate(names):
                over = np.where((counts[i] > 0) & (p[i] > all_p), p[i] - all_p, 0)
                top = np.lexsort((np.arange(len(terms)), -over))[:report]
                top = top[over[top] > 0]
                apart = np.abs(p - p[i]).sum(1)
                others = [j for j in range(len(names)) if j != i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(others) + len(top)), pa.string()), pa.array([s] * (len(others) + len(top)), pa.string()),
                     pa.array(["pair"] * len(others) + ["term"] * len(top), pa.string()),
                     pa.array([names[j] for j in others] + [terms[t] for t in top], pa.string()),
                     pa.array([*apart[others].tolist(), *over[top].tolist()], pa.int64())],
                    ["lang", "source", "part", "item", "value"])

    return blocks.mapInArrow(compare, "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, least: int = 30, report: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs (text, lang, source, ...)``.

    Part ``pair``: every other source of the language with the sum, over all kept terms, of
    the differences of their shares.  Part ``term``: the ``report`` terms of a source whose
    share exceeds the language's by most.  Null texts, languages and sources count as empty
    ones; a language without kept terms gives pairs of value 0; an empty table gives none.
    """
    spark, empty = docs.sparkSession, F.lit("")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("text", "lang", "source")))
    with Scratch(spark) as scratch:
        cells = kept_terms(docs, least, scratch)
        vocabulary = cells.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("n").alias("whole"))
        totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = scratch.table(
            docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
            .select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "terms", "whole"))))
        widths = groups.groupBy("lang").agg(F.first("terms").alias("terms"), F.first("whole").alias("whole"), F.count("*").alias("sources")).select(
            "lang", "terms", "whole",
            F.greatest(F.lit(1), F.ceil(F.col("terms") / F.least(F.lit(TERMS), F.greatest(F.lit(1), F.lit(CELLS) / F.col("sources"))))).cast("int").alias("blocks"))
        # every block learns all sources of its language
        heads = widths.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        columns = ["lang_no", "block", "kind", "lang", "source", "term", "n", "total", "terms"]

        def rows(df: DataFrame, kind: int, **given: Column) -> DataFrame:
            return df.withColumns({"lang_no": F.xxhash64("lang"), "kind": F.lit(kind), **given}).select(
                *(F.col(c).cast("long") if c in ("n", "total", "terms") else F.col(c) for c in columns))

        first = rows(groups.join(heads.select("lang", "block"), "lang"), 0, term=empty, n=F.lit(0))
        whole = rows(heads, 1, source=empty, term=empty, n=F.lit(0), total=F.col("whole"))
        counted = rows(
            cells.join(widths, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")), 2, total=F.lit(0))
        blocks = (
            first.unionByName(whole).unionByName(counted).repartition("lang_no", "block")
            .sortWithinPartitions("lang_no", "block", "lang")
        )
        parts = scratch.table(_compared(blocks, report))
        summed = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
        ranked = summed.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
        return scratch.result(ranked.where((F.col("part") == "pair") | (F.col("rank") <= report)))


#: The same for DuckDB over a view ``documents``.
SQL = r"""
with docs as (
  select row_number() over () as d, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents
), words as (
  select d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs
), kept as (
  select lang, term from words group by lang, term having count(distinct d) >= 30
), cells as (
  select lang, source, term, count(*) as n from words join kept using (lang, term) group by all
), sizes as (
  select lang, count(*) as v from kept group by lang
), groups as (
  select lang, source, coalesce(any_value(v), 0) as v, coalesce(any_value(t), 0) as t
  from docs left join sizes using (lang) left join (select lang, source, sum(n)::bigint as t from cells group by all) using (lang, source)
  group by lang, source
), dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.t + 5 * g.v) as p
  from groups g join kept k using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term
), whole as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n)::hugeint + 5)) // (any_value(t) + 5 * any_value(v)) as q
  from (select * from cells) join (select lang, sum(n)::bigint as t from cells group by lang) using (lang) join sizes using (lang)
  group by lang, term
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, sum(abs(a.p - b.p))::bigint as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
  union all
  select a.lang, a.source, 'pair', b.source, 0 from groups a join groups b on a.lang = b.lang and a.source <> b.source where a.v = 0
), terms as (
  select lang, source, 'term' as part, term as item, (p - q)::bigint as value from dense join whole using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, value, rank::int as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms)
) where part = 'pair' or rank <= 50
"""
