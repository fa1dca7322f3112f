"""Self-join of documents on the Jaccard similarity of their word n-grams.

The documents are the rows of a sparse 0/1 matrix, the n-grams its columns.  Overlaps
are entries of the matrix times its transpose, accumulated block by block, and size-derived
bounds keep the product small:

- documents with the same set of n-grams are one row of the matrix (a class);
- two sets of sizes m <= n can only link if ``m >= t n``;
- only each row's first ``n - ceil(t n) + k`` columns in one common order enter the
  product; linked rows share at least ``k`` of them, so a pair with a smaller
  accumulated count is discarded unseen (``k`` grows with the size);
- of two sets, the bits in which their parity bitmaps differ are no more than the n-grams
  in which they differ, so a pair with too many such bits is discarded as well;
- the common order puts frequent columns last.  Frequencies come from a table of counters
  of fixed size over all documents; being only an order, its errors cost time, not links;
- a column of one row makes no product.  Which columns have several rows is counted by 40 bits
  of each, as steps between sorted keys of about three bytes, and told to the tasks by a
  filter, so only rows of such columns, and only texts of such rows, are moved at all.

Only connections are wanted, so a column of m rows is not multiplied out: each column's
rows are first compared with one leader of the column, linked rows fall into components,
and the product is only formed between rows of different components.  Pairs that pass the
bounds are compared exactly on their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .groups import runs
from .key_filter import SLICE, KeyFilter, key_filter, marked, united
from .scratch import Scratch

PORTION = 1 << 18  # bytes of text whose n-grams are made at a time: their arrays take about 40 times as many
COUNTERS = 1 << 24  # of n-gram frequencies, for the order of the columns
SLICES = 64
PARITY = [f"s{i}" for i in range(8)]  # 512 bits for each set: how many of its n-grams fall on a bit, modulo 2
SOME = PARITY[:2]  # of the bits, for the leaders, whose rows travel once more
MEMBERS = 512  # rows compared with one leader in one block
LEADERS = 4  # of a column in one turn
SHORT = 40  # bits of an n-gram that decide whether its column may have several rows
BUCKET_BITS = 11  # of these, those that say where its rows are counted
HELD = 1 << 22  # n-grams that a task holds before it sends them
FILTER_BITS = range(20, 29)  # powers of two: the filter of columns has about a bit for each, 32 MB at most


@dataclass(frozen=True)
class Rule:
    """Link when ``100 * overlap >= percent * union``, on n-grams of ``n`` words."""

    n: int = 5
    percent: int = 80

    def prefix(self, size: int) -> int:
        return min(size, size - (self.percent * size + 99) // 100 + self.shared(size))

    def shared(self, size: int) -> int:
        """Columns that two linked rows must share within their prefixes."""
        return size // 40 + 1


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every text.

    Words are lower-cased A-Z.  A text with fewer than ``n`` words has its whole
    sequence as its only n-gram; one without words has none.
    """
    for row, _, data, at in W.chunks(texts, PORTION):
        starts, ends, first = W.spans(data, at)
        h = W.hashes(data, starts, ends, lower=True)
        grams = W.windows(h, n)
        for i in range(len(at) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= n:
                yield row + i, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield row + i, W.windows(h[a:b], b - a)
            else:
                yield row + i, h[:0]


def _bucket(grams: np.ndarray, n_counters: int) -> np.ndarray:
    return (grams % np.uint64(n_counters)).astype(np.int64)


def gram_counters(docs: DataFrame, rule: Rule, n_counters: int = COUNTERS) -> np.ndarray:
    """Document frequencies of all n-grams, added up in ``n_counters`` counters, as eighths of a doubling.

    One byte stands for a counter: frequencies are only compared.  What a task sends is
    compressed, so a task of few n-grams sends little.
    """
    width = n_counters // SLICES

    def packed(parts: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        rows = [(i, part.itemsize, pa.compress(part.tobytes(), codec="zstd", asbytes=True)) for i, part in parts]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["slice", "bytes", "counts"])

    def unpacked(n_bytes: int, raw: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(raw, n_bytes * width, codec="zstd"), np.uint8 if n_bytes == 1 else np.uint32)

    def count(batches):
        total, one = np.zeros(n_counters, np.uint32), np.uint32(1)
        for batch in batches:
            for _, grams in gram_sets(batch.column(0), rule.n):
                np.add.at(total, _bucket(grams, n_counters), one)
        # slices of little numbers take one byte a counter
        parts = ((i, p.astype(np.uint8) if p.max() < 256 else p) for i, p in enumerate(total.reshape(SLICES, width)) if p.any())
        yield packed(parts)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, n_bytes, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sums[i] = sums.get(i, 0) + unpacked(n_bytes, raw).astype(np.uint64)
        yield packed((i, np.minimum(8 * np.log2(1.0 + s), 255).astype(np.uint8)) for i, s in sums.items())

    kind = "slice int, bytes int, counts binary"
    slices = docs.select("text").mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind)
    levels = np.zeros((SLICES, width), np.uint8)
    for i, n_bytes, raw in slices.collect():  # SLICES rows, at most a byte for each counter
        levels[i] = unpacked(n_bytes, bytes(raw))
    return levels.reshape(-1)


def signatures(docs: DataFrame, rule: Rule, counters: np.ndarray) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, check, prefix`` and ``PARITY`` of every row.

    ``node`` and ``check`` are a 128-bit fingerprint of the set, null for an empty one
    (``_apart`` makes ``node`` alone stand for it); ``prefix`` holds the columns that enter
    the product.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counters)  # a byte for each counter

    def sign(batches):
        order = shared.value
        for batch in batches:
            n = batch.num_rows
            sizes, node, check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            prefix: list[bytes] = [b""] * n
            parity = np.zeros((n, 64), np.uint8)
            for row, grams in gram_sets(batch.column(2), rule.n):
                size = sizes[row] = len(grams)
                if not size:
                    continue
                node[row] = np.add.reduce(W.mix(grams))
                check[row] = np.bitwise_xor.reduce(W.mix(grams * W._BASE))
                parity[row] = np.packbits(np.bincount((W.mix(grams + W._LEFT) >> np.uint64(55)).astype(np.int64), minlength=512) & 1)
                # rare first; equal counts in the order of the hashes
                rank = (order[_bucket(grams, len(order))].astype(np.uint64) << np.uint64(32)) | (grams >> np.uint64(32))
                prefix[row] = grams[np.argsort(rank, kind="stable")[: rule.prefix(size)]].tobytes()
            none = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes),
                 pa.array(node.view(np.int64), mask=none), pa.array(check.view(np.int64), mask=none),
                 pa.array(prefix, pa.binary()), *map(pa.array, np.ascontiguousarray(parity.view(np.int64).T))],
                ["doc_id", "text_key", "n_shingles", "node", "check", "prefix", *PARITY],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        sign, "doc_id long, text_key long, n_shingles long, node long, check long, prefix binary, " + ", ".join(f"{s} long" for s in PARITY)
    )


def _apart(signed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(``signed`` with a ``node`` of its own for every pair of ``node`` and ``check``, the nodes of several rows).

    Only hashes move to find nodes that stand for several sets; where there are none, as
    nearly always, the rows stay as they are.
    """
    while True:
        repeated = scratch.table(
            signed.where("node is not null").groupBy("node")
            .agg(F.min("check").alias("low"), F.max("check").alias("high"), F.count("*").alias("rows")).where("rows > 1"))
        shared = repeated.where("low <> high").select("node", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return signed, repeated.select("node")
        other = F.when(F.col("shared"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        signed = scratch.table(signed.join(shared, "node", "left").select(
            *(other.alias(c) if c == "node" else F.col(c) for c in signed.columns)))


def _hash_keys(rows: DataFrame, column: Column | str) -> DataFrame:
    """The two keys of a filter from a column of 64-bit hashes."""
    return rows.select(F.col(column).alias("first") if isinstance(column, str) else column.alias("first")).withColumn(
        "second", F.shiftrightunsigned("first", 32))


def _has_hash(known: KeyFilter, hashes: np.ndarray) -> np.ndarray:
    return known.has(hashes, hashes.view(np.uint64) >> np.uint64(32))


def _short_keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands for an n-gram in a filter: ``SHORT`` bits of it, and a hash of them."""
    short = grams >> np.uint64(64 - SHORT)
    return short, W.mix(short * W._BASE ^ W._RIGHT)


@dataclass(frozen=True)
class _Classes:
    """One row for each set: ``node, size, prefix, rep_id, rep_key, alone`` and ``PARITY``.

    Rows that are ``alone`` are read where they were written; those of a node in ``repeated``
    are passed over there, because ``rows`` has one row of each such node besides.
    """

    rows: DataFrame
    repeated: Broadcast

    def map(self, columns: list[str], function, kind: str) -> DataFrame:
        """``function`` of the batches of ``columns`` of every class; ``node`` is the first of them."""
        repeated = self.repeated

        def only(batches):
            for batch in batches:
                node, alone = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, batch.num_columns - 1))
                yield batch.filter(pa.array(~alone | ~_has_hash(repeated.value, node)))

        return self.rows.select("node", *columns, "alone").mapInArrow(lambda batches: function(only(batches)), kind)


def _classes(signed: DataFrame, repeated: DataFrame, scratch: Scratch) -> _Classes:
    """The classes of the rows that take part; only rows of ``repeated`` nodes are moved."""
    known = key_filter(_hash_keys(repeated, "node"))
    shared = signed.sparkSession.sparkContext.broadcast(known)

    def copied(batches):
        for batch in batches:
            yield batch.filter(pa.array(_has_hash(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))

    rows = signed.where("node is not null and doc_id is not null").select(
        "node", F.col("n_shingles").cast("int").alias("size"), "prefix", F.col("doc_id").alias("rep_id"), F.col("text_key").alias("rep_key"), *PARITY)
    merged = rows.mapInArrow(copied, rows.schema).groupBy("node").agg(
        F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.min(F.struct("rep_id", "rep_key")).alias("rep"),
        *(F.min(s).alias(s) for s in PARITY))
    merged = scratch.table(merged.select("node", "size", "prefix", "rep.rep_id", "rep.rep_key", *PARITY))
    return _Classes(rows.withColumn("alone", F.lit(True)).unionByName(merged.withColumn("alone", F.lit(False))), shared)


def _grams(prefixes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all columns of a batch of prefixes, how many each row has)."""
    raw = [x.as_buffer() for x in prefixes]
    grams = np.concatenate([np.frombuffer(x, np.uint64) for x in raw]) if raw else np.zeros(0, np.uint64)
    return grams, np.array([x.size // 8 for x in raw], np.int64)


def _steps(short: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its short keys, each twice at most, as steps, byte by byte, compressed."""
    keys = np.sort(short)
    keys = keys[np.concatenate([np.ones(min(len(keys), 2), bool), keys[2:] != keys[:-2]])]
    width = np.uint64(SHORT - BUCKET_BITS)
    bucket = (keys >> width).astype(np.int64)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), bucket[1:] != bucket[:-1]]))
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[at] = keys[at] & ((np.uint64(1) << width) - np.uint64(1))
    steps, ends = steps.astype("<u4").view(np.uint8).reshape(-1, 4), np.append(at[1:], len(keys)).tolist()
    raw = [pa.compress(steps[a:b].T.tobytes(), codec="zstd", asbytes=True) for a, b in zip(at.tolist(), ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[at]), pa.array(np.diff(np.append(at, len(keys)))), pa.array(raw, pa.binary())], ["bucket", "n", "raw"])


def _met_columns(classes: _Classes, n_bits: int) -> KeyFilter:
    """A filter that has all columns of several rows, by ``_short_keys``."""
    def send(batches):
        held, n_held = [], 0
        for batch in batches:
            held.append(_grams(batch.column(1))[0] >> np.uint64(64 - SHORT))
            n_held += len(held[-1])
            if n_held > HELD:
                yield _steps(np.concatenate(held))
                held, n_held = [], 0
        if n_held:
            yield _steps(np.concatenate(held))

    def count(batches):
        for (bucket,), table in runs(batches, 1):
            keys = []
            for n, raw in zip(table["n"].to_pylist(), table["raw"]):
                steps = np.frombuffer(pa.decompress(raw.as_buffer(), 4 * n, codec="zstd"), np.uint8).reshape(4, n)
                keys.append(np.cumsum(np.ascontiguousarray(steps.T).view("<u4").reshape(-1), dtype=np.uint64))
            keys = np.sort(np.concatenate(keys))
            rest = np.unique(keys[1:][keys[1:] == keys[:-1]])
            yield _short_keys((np.uint64(bucket << (SHORT - BUCKET_BITS)) | rest) << np.uint64(64 - SHORT))

    sent = classes.map(["prefix"], send, "bucket long, n long, raw binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    # counted and marked by one function: two in a row would be two Python workers of each task, which stay
    return united(dealt.mapInArrow(lambda batches: marked(count(batches), n_bits), SLICE), n_bits)


def _index(classes: _Classes, rule: Rule, met: KeyFilter) -> DataFrame:
    """``gram, node, size, pos, columns`` and ``SOME`` of the columns in ``met``, ``pos`` in the common order.

    ``columns`` is how many of them a row has.  A row that shares too few columns with all
    others together links with none and has no rows here.
    """
    shared = classes.rows.sparkSession.sparkContext.broadcast(met)

    def split(batches):
        for batch in batches:
            grams, lengths = _grams(batch.column(2))
            size, row = batch.column(1).to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
            pos = (np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            at = np.flatnonzero(shared.value.has(*_short_keys(grams)))
            columns = np.bincount(row[at], minlength=len(lengths)).astype(np.int32)
            at = at[(columns >= size.astype(np.int64) * rule.percent // 4000 + 1)[row[at]]]
            fixed = [batch.column(0).to_numpy(), size, columns, *(batch.column(3 + i).to_numpy() for i in range(len(SOME)))]
            for begin in range(0, len(at), 1 << 16):  # many rows come of one
                part = at[begin : begin + (1 << 16)]
                node, sizes, n, *bits = (x[row[part]] for x in fixed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[part].view(np.int64)), pa.array(node), pa.array(sizes), pa.array(pos[part]), pa.array(n), *map(pa.array, bits)],
                    ["gram", "node", "size", "pos", "columns", *SOME])

    return classes.map(["size", "prefix", *SOME], split, "gram long, node long, size int, pos int, columns int, " + ", ".join(f"{s} long" for s in SOME))


def _able(classes: _Classes, index: DataFrame) -> DataFrame:
    """``node, rep_id, rep_key`` and ``PARITY`` of the classes in ``index``, and of a few more by chance."""
    shared = index.sparkSession.sparkContext.broadcast(key_filter(_hash_keys(index, "node")))
    names = ["node", "rep_id", "rep_key", *PARITY]

    def able(batches):
        for batch in batches:
            found = batch.filter(pa.array(_has_hash(shared.value, batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays(found.columns[:-1], names)

    return classes.map(names[1:], able, ", ".join(f"{c} long" for c in names))


def _texts(docs: DataFrame, able: DataFrame) -> DataFrame:
    """``node, text`` of every class in ``able``; other texts are not moved, but for a few by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(_hash_keys(able, F.xxhash64("rep_id", "rep_key"))))

    def wanted(batches):
        for batch in batches:
            found = batch.filter(pa.array(_has_hash(shared.value, batch.column(0).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays(found.columns[1:], ["rep_id", "rep_key", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep_id"), F.xxhash64("text").alias("rep_key"), "text")
    moved = rows.select(F.xxhash64("rep_id", "rep_key"), *rows.columns).mapInArrow(wanted, rows.schema)
    return moved.dropDuplicates(["rep_id", "rep_key"]).join(able.select("node", "rep_id", "rep_key"), ["rep_id", "rep_key"]).select("node", "text")


def _shared(a: Column, b: Column) -> Column:
    return F.floor(F.least(a, b) / 40) + 1


def _can_link(rule: Rule, parity: list[str]) -> Column:
    """Whether an entry of two rows counts: sizes ``a_size, b_size``, places ``a_pos, b_pos``, bits of ``parity``.

    Linked rows overlap in at least ``need`` columns, so of the first ``k`` shared ones none
    has more than ``size - need`` unshared columns before it.
    """
    a, b = F.col("a_size"), F.col("b_size")
    need = F.ceil((a + b) * rule.percent / (100 + rule.percent))
    k = _shared(a, b)
    differ = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in parity), F.lit(0))
    return (
        (F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent)
        & (F.col("a_pos") < a - need + k) & (F.col("b_pos") < b - need + k) & (differ <= a + b - 2 * need)
    )


def _verify(pairs: DataFrame, texts: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Pairs ``a, b`` that link, compared exactly on the texts of their classes.

    Members are compared in blocks of about ``MEMBERS`` with their leader ``a``, so a
    leader with very many members is spread over many tasks.
    """
    blocks = pairs.groupBy("a").agg((F.count("*") / MEMBERS).cast("int").alias("last"))
    split = scratch.table(pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("last") + 1).alias("block")))
    wanted = split.select("a", "block", F.col("b").alias("node"), F.lit(False).alias("leads")).unionByName(
        split.select("a", "block", F.col("a").alias("node"), F.lit(True).alias("leads")).distinct()
    )

    def compare(batches):
        leader, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, node, leads = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            block, linked = batch.column(1).to_pylist(), []
            for row, grams in gram_sets(batch.column(4), rule.n):
                if leads[row]:
                    leader, known = (a[row], block[row]), grams
                elif leader == (a[row], block[row]):
                    both = len(np.intersect1d(known, grams, assume_unique=True))
                    if 100 * both >= rule.percent * (len(known) + len(grams) - both):
                        linked.append((a[row], node[row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in linked], pa.int64()), pa.array([x for _, x in linked], pa.int64())], ["a", "b"]
            )

    return (
        wanted.join(texts, "node").select("a", "block", "node", "leads", "text")
        .repartition("a", "block").sortWithinPartitions("a", "block", F.desc("leads"))
        .mapInArrow(compare, "a long, b long")
    )


def _open_columns(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of the columns that hold more than one component, with each row's component."""
    rows = index if labels is None else index.join(labels, "node", "left")
    rows = rows.withColumn("component", F.col("node") if labels is None else F.coalesce("component", "node"))
    columns = rows.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return rows.join(columns.select("gram"), "gram")


_ROW = ("node", "size", "pos", "component")


def _side(rows: DataFrame, side: str, parity: list[str]) -> DataFrame:
    return rows.select("gram", *(F.col(c).alias(f"{side}_{c}") for c in (*_ROW, *parity)))


def _overlapping(entries: DataFrame) -> DataFrame:
    """Pairs with enough entries to link."""
    return (
        entries.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_size", "b_size").agg(F.count("*").alias("overlap"))
        .where(F.col("overlap") >= _shared(F.col("a_size"), F.col("b_size"))).select("a", "b")
    )


def _led(rows: DataFrame, rule: Rule, turn: int) -> DataFrame:
    """Pairs of the product between ``LEADERS`` rows of each column and all its rows.

    The first leader is the row with the most columns that others share, which a text without
    changes of its own has; the others are drawn, alike in all columns, anew each turn.
    """
    ranks = [F.struct(-F.col("columns"), F.xxhash64("node", F.lit(turn)))] + [
        F.struct(F.xxhash64("node", F.lit(turn * LEADERS + i)), F.lit(0)) for i in range(1, LEADERS)]
    heads = rows.groupBy(F.col("gram").alias("at")).agg(
        *(F.min(F.struct(rank.alias("rank"), F.struct(*_ROW, *SOME).alias("row")))["row"].alias(f"leader{i}") for i, rank in enumerate(ranks)))
    leaders = F.array_distinct(F.array(*(f"leader{i}" for i in range(LEADERS))))
    heads = heads.select("at", leaders.alias("leaders"), F.transform(leaders, lambda x: x["node"]).alias("nodes"))
    b = _side(rows, "b", SOME)
    met = b.join(heads, b["gram"] == heads["at"]).select(
        *(c for c in b.columns if c != "gram"), F.array_contains("nodes", F.col("b_node")).alias("leads"), F.explode("leaders").alias("a"))
    met = met.select(*(c for c in b.columns if c != "gram"), "leads", *(F.col(f"a.{c}").alias(f"a_{c}") for c in (*_ROW, *SOME)))
    once = ~F.col("leads") | (F.col("a_node") < F.col("b_node"))  # two leaders meet once
    return _overlapping(met.where((F.col("a_component") != F.col("b_component")) & once & _can_link(rule, SOME)))


def _product(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of the product between rows of different components, above the diagonal."""
    a, b = _side(rows, "a", PARITY), _side(rows, "b", PARITY)
    return _overlapping(a.join(
        b, (a["gram"] == b["gram"]) & (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & _can_link(rule, PARITY)))


def link_components(docs: DataFrame, rule: Rule, scratch: Scratch, leader_turns: int = 1) -> tuple[DataFrame, DataFrame]:
    """(signature rows of all documents, ``node, component`` of the nodes that have links).

    Rows without ``doc_id`` take no part in links.
    """
    signed, repeated = _apart(scratch.table(signatures(docs, rule, gram_counters(docs, rule))), scratch)
    classes = _classes(signed, repeated, scratch)
    n_columns = signed.agg(F.sum(F.col("n_shingles") * (1025 - 10 * rule.percent) / 1000 + 1)).head()[0] or 0  # about
    n_bits = 1 << min(max(int(n_columns).bit_length(), FILTER_BITS[0]), FILTER_BITS[-1])
    index = scratch.table(_index(classes, rule, _met_columns(classes, n_bits)))
    able = scratch.table(_able(classes, index))
    texts = scratch.table(_texts(docs, able))

    labels = None
    for turn in [*range(leader_turns), None]:
        if turn is None:  # all bits of the rows that are left
            rows = _open_columns(index.drop(*SOME), labels).join(able.select("node", *PARITY), "node")
        else:
            rows = _open_columns(index, labels)
        pairs = scratch.table(_product(rows, rule) if turn is None else _led(rows, rule, turn))
        found = scratch.table(_verify(pairs, texts, rule, scratch))
        if turn is None or turn == 0 or not found.isEmpty():
            labels = _relabelled(labels, found, scratch)
    return signed, labels


def _relabelled(labels: DataFrame | None, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after ``found`` links more: only the components that these join are worked on."""
    if labels is None:
        return scratch.table(components(found, scratch))
    named = found
    for side in ("a", "b"):
        names = labels.select(F.col("node").alias(side), F.col("component").alias("to"))
        named = named.join(names, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    joined = components(scratch.table(named.where("a <> b").distinct()), scratch)
    grown = labels.unionByName(
        joined.select("node", F.col("node").alias("component")).join(labels.select("node"), "node", "left_anti"))
    top = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return scratch.table(grown.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def jaccard_groups(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs (doc_id, text, ...)``.

    ``component_id`` is the smallest ``doc_id`` that links reach, itself included.  Null
    and word-less texts have no n-grams and link with nothing; equal sets link; rows that
    repeat a ``doc_id`` are documents of their own.  A row without ``doc_id`` has no
    component.  An empty table gives an empty result.
    """
    return _grouped(docs, rule).drop("text_key", "component")


def _grouped(docs: DataFrame, rule: Rule) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        signed, reached = link_components(docs, rule, scratch)
        own = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        named = own.join(reached, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
        groups = named.groupBy("component").agg(F.min("least").alias("component_id"))
        by_node = named.join(groups, "component").select("node", "component", "component_id")
        rows = signed.select("doc_id", "text_key", "n_shingles", "node").join(by_node, "node", "left")
        return scratch.result(rows.select(
            "doc_id", "text_key", "n_shingles", "component",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def keep_one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row of every group of linked rows of ``docs``: that of smallest ``doc_id``.

    Rows without ``doc_id`` come after all others; of rows that repeat the kept one, a single one
    stays.  Null and word-less texts link with nothing and all stay.
    """
    text_key = F.xxhash64("text")
    own = F.coalesce(F.col("doc_id").cast("long"), F.pmod(text_key, F.lit(1 << 61)) + F.lit(1 << 62))
    grouped = _grouped(docs.select(own.alias("doc_id"), "text"), rule).where("component is not null")
    first = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"), F.count("*").alias("rows")).where("rows > 1")
    is_kept = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key"))
    own_id, own_key = (f"{name}_{uuid.uuid4().hex}" for name in ("id", "key"))  # no column of docs has these names
    members = (
        grouped.join(first, "component").groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
        .agg(F.count("*").alias("rows"), F.first(is_kept).alias("kept"))
    )
    dropped = members.where("not kept").select(own_id, own_key)
    repeated = members.where("kept and rows > 1").select(own_id, own_key)
    same = (own == F.col(own_id)) & (text_key == F.col(own_key))
    left = docs.join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return left
    copies = left.join(repeated, same, "left_semi").withColumns({own_id: own, own_key: text_key})
    return left.join(repeated, same, "left_anti").unionByName(copies.dropDuplicates([own_id, own_key]).drop(own_id, own_key))
