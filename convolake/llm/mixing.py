"""Mixing sources to target weights by balanced sampling with the cube method.

A source of ``size`` words has a target of words.  Each of its documents is taken
``floor(target / size)`` times whole, and once more with a probability equal to the rest.
These last copies are drawn by the cube method: the vector of inclusion probabilities moves
along the null space of the balancing constraints (words of the source, documents of the
source) until all but a few probabilities are 0 or 1, so both totals stay what they were on
average.  What is left, at most two documents of a source, is landed by giving up
the constraint on words, then the one on documents.

Documents fly in blocks of bounded size; what a block leaves open flies on with what the
source's other blocks leave open, until one block holds a source's rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 20_000  # documents that fly together
_ROW_BITS = 33
_ZERO = 1e-9


def _direction(sizes: list[float]) -> list[float] | None:
    """A vector that keeps the count and the words of the (two or three) documents."""
    if len(sizes) == 3:
        a, b, c = sizes
        if a != b or b != c:
            return [c - b, a - c, b - a]
        return [1.0, -1.0, 0.0]
    return [1.0, -1.0] if sizes[0] == sizes[1] else None


def _move(p: list[float], u: list[float], draw: float) -> list[float]:
    """Go along ``u`` or against it until a probability is 0 or 1, keeping all means."""
    ahead = min((1 - x) / v if v > 0 else -x / v for x, v in zip(p, u) if v)
    back = min(x / v if v > 0 else (x - 1) / v for x, v in zip(p, u) if v)
    step = ahead if draw * (ahead + back) < back else -back
    moved = [x + step * v for x, v in zip(p, u)]
    return [0.0 if x < _ZERO else 1.0 if x > 1 - _ZERO else x for x in moved]


def fly(p: np.ndarray, sizes: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """The probabilities after the flight; with ``land`` all of them are 0 or 1."""
    p, random = p.astype(np.float64).copy(), np.random.Generator(np.random.PCG64(seed))
    p[p < _ZERO], p[p > 1 - _ZERO] = 0.0, 1.0
    waiting = iter(np.flatnonzero((p > 0) & (p < 1)).tolist())
    draws = iter(random.random(2 * len(p) + 8).tolist())
    held: list[int] = []
    while True:
        for i in waiting:
            held.append(i)
            if len(held) == 3:
                break
        if len(held) < 2:
            break
        u = _direction([float(sizes[i]) for i in held])
        if u is None:
            if not land:
                break
            u = [1.0, -1.0]  # gives the words up
        moved = _move([float(p[i]) for i in held], u, next(draws))
        p[held] = moved
        held = [i for i, x in zip(held, moved) if 0 < x < 1]
    if land and held:
        p[held[0]] = float(next(draws) < p[held[0]])
    return p


def targets(sizes: DataFrame, weights: Column, share: float, most: float, scratch: Scratch) -> DataFrame:
    """``source, source_size, documents, target`` of ``sizes (source, size)``.

    ``weights`` is an expression over ``place``, the source's 0-based rank by code point,
    null last.  The targets share ``share`` times all words by weight; none exceeds ``most``
    times its source, and the excess is shared again.  Only sums reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranked = _positions(sources, [F.col("source").asc_nulls_last()], "place", scratch)
    open_ = scratch.table(ranked.select("source", "source_size", "documents", weights.cast("double").alias("weight"), F.lit(None).cast("double").alias("target")))
    total = open_.agg(F.sum("source_size")).head()[0] or 0
    while True:
        free = F.col("target").isNull()
        given, weight = open_.agg(
            F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0))).head()
        part = F.col("weight") * F.lit((share * total - given) / weight if weight else 0.0)
        over = free & (part > most * F.col("source_size"))
        if not weight or open_.where(over).isEmpty():
            return open_.withColumn("target", F.coalesce("target", part)).drop("weight")
        open_ = scratch.table(open_.withColumn("target", F.when(over, most * F.col("source_size")).otherwise(F.col("target"))))


def _positions(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """Adds the dense 0-based position in a total order; no task sees all rows."""
    rows = scratch.table(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each sorted part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_offset") + within).drop("_part", "_at", "_offset")


def _flight(units: DataFrame, seed: int, turn: int, land: bool) -> DataFrame:
    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable", ignore_index=True)
        draw = zlib.crc32(repr((seed, turn, *key)).encode())
        return rows.assign(p=fly(rows["p"].to_numpy(), rows["size"].to_numpy(), draw, land))

    return units.groupBy("source", "block").applyInPandas(one, units.schema)


def draw_copies(docs: DataFrame, weights: Column, share: float = 1.5, most: float = 2.0, seed: int = 1, *, scratch: Scratch) -> DataFrame:
    """``doc_id, tag, size, source_size, target, copies`` of every row of ``docs (doc_id, text, source)``.

    ``copies`` is how often the mix takes the row (0, 1 or 2 with ``most`` = 2), ``tag`` a
    hash of its text.  Null and word-less texts have size 0 and are drawn like others; a null
    source is a source of its own; rows that repeat are drawn one by one; an empty table
    gives an empty result.  Reruns agree: draws follow from the rows, not from their layout.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.table(docs.select("doc_id", F.xxhash64("text").alias("tag"), "source", size.alias("size")))
    aims = scratch.table(targets(sized, weights, share, most, scratch))
    mixed = F.xxhash64("doc_id", "tag")
    placed = _positions(sized, [F.col("source"), mixed, F.col("doc_id"), F.col("tag"), F.monotonically_increasing_id()], "at", scratch)
    firsts = placed.groupBy("source").agg(F.min("at").alias("first"))
    known = aims.join(firsts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = placed.join(known.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "tag", "source", "size", "source_size", "target", F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("p"), (F.col("at") - F.col("first")).alias("place"))
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    turn, decided = 0, None
    flying = units.withColumn("block", F.floor(F.col("place") / BLOCK))
    while True:
        landing = flying.where("block > 0").isEmpty()
        flown = scratch.table(_flight(flying, seed, turn, landing))
        done = flown if landing else flown.where(~undecided)
        decided = done if decided is None else decided.unionByName(done)
        if landing:
            break
        # 2 of BLOCK documents of a block are left: the next turn is that much smaller
        flying = flown.where(undecided).withColumn("block", F.floor(F.col("block") / (BLOCK // 2)))
        turn += 1
    return decided.select("doc_id", "tag", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def repeating_weights(*weights: float) -> Column:
    """Weights for ``place`` 0, 1, 2 ... that begin again after the last."""
    return F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))


def mix_report(docs: DataFrame, weights: Column, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words each row gives to the mix."""
    with Scratch(docs.sparkSession) as scratch:
        drawn = draw_copies(docs, weights, share, most, scratch=scratch)
        return scratch.result(drawn.select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")))


def mix(docs: DataFrame, weights: Column, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of the mix: those of ``docs``, each as often as it was taken."""
    with Scratch(docs.sparkSession) as scratch:
        drawn = scratch.table(draw_copies(docs, weights, share, most, scratch=scratch))
        totals = drawn.groupBy(F.coalesce("doc_id", "tag").alias("key"), "tag").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
        marked = docs.select(
            F.coalesce("doc_id", F.xxhash64("text")).alias("key"), F.xxhash64("text").alias("tag"),
            F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        met = marked.join(totals.where("copies > 0"), ["key", "tag"])
        # equal rows share their copies out among themselves
        order = F.row_number().over(Window.partitionBy("key", "tag").orderBy(F.lit(1))) - 1
        own = (F.floor(F.col("copies") / F.col("rows")) + (F.col("n") < F.col("copies") % F.col("rows")).cast("int")).alias("copies")
        single = met.where("rows = 1").select("row", "copies")
        several = met.where("rows > 1").withColumn("n", order).select("row", own)
        taken = single.unionByName(several).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
        return scratch.result(taken.select("row.*"))
