"""Rules learned per project: adding, clearing, and keeping duplicates out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import RULES, conform
from ..session import pin, write_down
from .filters import like_filter

NEAR_CHARS = 50  # a rule whose first characters occur inside another one repeats it
_FILTER_BITS = 26  # the filter of wanted starts has 2 ** 26 bits, 8 MB, whatever their number
_SLICES = 64
_BLOCK = 1 << 18  # characters looked at in one step
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


def _codes(raw: bytes) -> np.ndarray:
    text = raw.decode("utf-8", "surrogateescape")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hashes of all stretches of that length, by place."""
    power = {1 << k: np.uint64(pow(_BASE, 1 << k, 1 << 64)) for k in range(NEAR_CHARS.bit_length())}
    whole = {1: (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)}
    for k in range(1, NEAR_CHARS.bit_length()):
        width, half = 1 << k, 1 << (k - 1)
        n = max(len(codes) - width + 1, 0)
        whole[width] = whole[half][:n] * power[half] + whole[half][half:half + n]
    for length in lengths:
        n, at, got = len(codes) - length + 1, 0, None
        if n <= 0:
            continue
        for k in reversed(range(length.bit_length())):
            if length >> k & 1:
                piece = whole[1 << k][at:at + n]
                got = piece if got is None else got * power[1 << k] + piece
                at += 1 << k
        yield length, got


def _place(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes mixed once more, their places in the filter)."""
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(_BASE)
    return mixed, mixed >> np.uint64(64 - _FILTER_BITS)


def _start_filter(wanted: DataFrame) -> bytes:
    """Bits for all wanted starts: tasks fill filters of their own, which are united by slices."""
    size = (1 << _FILTER_BITS) // 8
    schema = "slice int, bits binary"

    def rows(slices: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(slices), pa.int32()), pa.array([x.tobytes() for x in slices.values()], pa.binary())], ["slice", "bits"])

    def fill(batches):
        marked = np.zeros(size, np.uint8)
        for batch in batches:
            for project, raw in zip(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_pylist()):
                codes = _codes(raw)
                for _, got in _hashes(codes, [len(codes)]):
                    mixed = (got ^ project) * np.uint64(_MIX)
                    for _ in range(4):
                        mixed, at = _place(mixed)
                        marked[at >> np.uint64(3)] |= np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
        parts = marked.reshape(_SLICES, -1)
        yield rows({i: parts[i] for i in range(_SLICES) if parts[i].any()})

    def unite(batches):
        joined: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                joined[i] = joined.get(i, 0) | np.frombuffer(raw.as_buffer(), np.uint8)
        yield rows(joined)

    keys = wanted.where(F.col("project_path").isNotNull()).select(F.xxhash64("project_path"), F.col("start").cast("binary"))
    slices = keys.mapInArrow(fill, schema).repartition("slice").mapInArrow(unite, schema)
    bits, width = bytearray(size), size // _SLICES
    for i, raw in slices.collect():
        bits[i * width:(i + 1) * width] = raw
    return bytes(bits)


def _candidates(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``rules`` once for each ``start`` that they contain and that is probably wanted.

    Each task hashes every stretch of its texts that is as long as some start, and goes on
    with those in the filter: no row for each character leaves it.
    """
    lengths = sorted(r[0] for r in wanted.select(F.length("start")).distinct().collect() if r[0])  # at most 50
    bits = _start_filter(wanted)
    keep = [c for c in rules.columns if c != "folded"]
    texts = rules.where(F.col("project_path").isNotNull() & F.col("folded").isNotNull()).select(
        *keep, F.xxhash64("project_path").alias("_project"), F.col("folded").cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema if f.name in keep)

    def probable(hashes: np.ndarray, project: np.ndarray) -> np.ndarray:
        known = np.frombuffer(bits, np.uint8)
        left = np.arange(len(hashes))
        mixed = (hashes ^ project) * np.uint64(_MIX)
        for _ in range(4):
            mixed, at = _place(mixed)
            some = (known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left, mixed = left[some], mixed[some]
        return left

    def stretches(batch):
        """Stretches of texts, overlapping by one start: (row, codes)."""
        for row, raw in enumerate(batch.column(len(keep) + 1).to_pylist()):
            codes = _codes(raw)
            for low in range(0, max(len(codes), 1), _BLOCK):
                yield row, codes[low:low + _BLOCK + NEAR_CHARS - 1]

    def find(batches):
        for batch in batches:
            projects = batch.column(len(keep)).to_numpy().view(np.uint64)
            found: set[tuple[int, bytes]] = set()
            block: list[tuple[int, np.ndarray]] = []

            def look():
                codes = np.concatenate([c for _, c in block])
                sizes = [len(c) for _, c in block]
                of = np.repeat([row for row, _ in block], sizes)
                end = np.repeat(np.cumsum(sizes), sizes)
                for length, got in _hashes(codes, lengths):
                    n = len(got)
                    for at in probable(got, projects[of[:n]]).tolist():
                        if at + length <= end[at]:
                            piece = codes[at:at + length].tobytes().decode("utf-32-le", "surrogatepass")
                            found.add((int(of[at]), piece.encode("utf-8", "surrogateescape")))
                block.clear()

            for one in stretches(batch):
                block.append(one)
                if sum(len(c) for _, c in block) >= _BLOCK:
                    look()
            if block:
                look()
            rows = sorted(found)
            taken = batch.select(list(range(len(keep)))).take(pa.array([r for r, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([p for _, p in rows], pa.binary())], [*keep, "start"])

    return texts.mapInArrow(find, f"{schema}, start binary").withColumn("start", F.col("start").cast("string"))


def _containing(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``rules`` (with ``folded``) once for each wanted ``start`` they contain.

    Tasks pick the stretches of their texts that a filter of fixed size takes for starts; an
    equality join keeps those that are.  The work grows with the text, the rows that move
    with the starts that occur.
    """
    return _candidates(rules, wanted).join(wanted, ["project_path", "start"], "left_semi").distinct()


def dedup_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` to add, taken in ``rule_seq`` order within each project.

    A rule is refused when, ignoring case and outer white space, it equals a stored
    or already accepted rule, or when its first 50 characters occur inside one.  A
    refused rule refuses nobody.  Rules without an earlier undecided rival are
    settled together, round by round; each round is one aggregate per start and key.
    """
    fold = F.lower("rule_text")
    offered = (
        new.where(F.coalesce("rule_text", F.lit("")) != "")
        .withColumn("folded", fold)
        # same text again: whatever happens to the first one, the later ones are refused
        .groupBy("project_path", "folded")
        .agg(F.min("rule_seq").alias("rule_seq"), F.min_by("rule_text", "rule_seq").alias("rule_text"))
        .withColumn("start", F.substring("folded", 1, NEAR_CHARS))
        .withColumn("same", strip(F.col("folded")))
    )
    offered = write_down(offered)
    stored = rules.select("project_path", fold.alias("folded"))
    stored_same = stored.select("project_path", strip(F.col("folded")).alias("same")).distinct()
    wanted = write_down(offered.select("project_path", "start").distinct())
    stored_starts = _containing(stored, wanted).select("project_path", "start").distinct()
    open_rules = pin(
        offered.join(stored_same, ["project_path", "same"], "left_anti")
        .join(stored_starts, ["project_path", "start"], "left_anti")
    )
    holders = pin(_containing(
        open_rules.select("project_path", "rule_seq", "folded"),
        write_down(open_rules.select("project_path", "start").distinct()),
    ))
    state = open_rules.select("project_path", "rule_seq", "start", "same",
                              F.lit(None).cast("boolean").alias("accepted"))
    while True:
        state = pin(_settle_round(state, holders))
        if state.where(F.col("accepted").isNull()).isEmpty():
            break
    accepted = state.where("accepted").select("project_path", "rule_seq")
    return open_rules.join(accepted, ["project_path", "rule_seq"], "left_semi").select(
        "project_path", "rule_text", "rule_seq")


def _settle_round(state: DataFrame, holders: DataFrame) -> DataFrame:
    def earliest(rows: DataFrame, by: str) -> DataFrame:
        """Per start or key: the first accepted rule and the first undecided one."""
        return rows.groupBy("project_path", by).agg(
            F.min(F.when(F.col("accepted"), F.col("rule_seq"))).alias(f"{by}_accepted"),
            F.min(F.when(F.col("accepted").isNull(), F.col("rule_seq"))).alias(f"{by}_open"))

    outcome = state.select("project_path", "rule_seq", "accepted")
    by_start = earliest(holders.join(outcome, ["project_path", "rule_seq"]), "start")
    by_same = earliest(state, "same")
    seq = F.col("rule_seq")
    blocked = F.coalesce(F.least("start_accepted", "same_accepted") < seq, F.lit(False))
    waiting = F.coalesce(F.least("start_open", "same_open") < seq, F.lit(False))
    decided = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(
        blocked, F.lit(False)).when(~waiting, F.lit(True))
    return (
        state.join(by_start, ["project_path", "start"], "left")
        .join(by_same, ["project_path", "same"], "left")
        .select("project_path", "rule_seq", "start", "same", decided.alias("accepted"))
    )


def add_rules(rules: DataFrame, accepted: DataFrame, source: str = "review",
              as_of: Column | None = None) -> DataFrame:
    """Stored rules plus accepted ones, which come after the stored ones in order."""
    as_of = F.current_timestamp() if as_of is None else as_of
    rules = conform(rules, RULES)
    last = rules.groupBy("project_path").agg(F.max("rule_seq").alias("_last"))
    rows = (
        accepted.join(last, "project_path", "left")
        .withColumn("rule_seq", F.col("rule_seq") + 1 + F.coalesce("_last", F.lit(0)))
        .withColumn("source", F.lit(source)).withColumn("created_at", as_of)
    )
    return rules.unionByName(conform(rows, RULES))


def add_rule(rules: DataFrame, sessions: DataFrame, project: str, text: str,
             as_of: Column | None = None) -> DataFrame:
    """Add a rule by hand to the first project matching ``project``."""
    target = (
        like_filter(sessions.where(F.col("project_path").isNotNull()), "project_path", project)
        .select("project_path").distinct().orderBy("project_path").limit(1)
    )
    row = target.select("project_path", F.lit(text).alias("rule_text"), F.lit(0).cast("long").alias("rule_seq"))
    return add_rules(rules, row, "manual", as_of)


def clear_rules(rules: DataFrame, project: str | None = None) -> DataFrame:
    """Rules left after clearing all of them, or those of matching projects."""
    if project is None:
        return rules.limit(0)
    gone = like_filter(rules.select("project_path").distinct(), "project_path", project)
    return rules.join(gone, "project_path", "left_anti")
