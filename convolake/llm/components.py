"""Connected components by alternating stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).head()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for every node of ``edges`` (two long columns ``a, b``).

    ``component`` is the smallest node id that can be reached.  Every round hangs each
    node's larger neighbours on its smallest one (large star), then each node and its
    smaller neighbours (small star); rounds grow with the logarithm of the nodes.  A node
    with very many neighbours is only ever one row of an aggregate that tasks combine
    first, and the skewed side of a join that AQE splits.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    known = scratch.table(
        edges.where("a <> b").select(larger.alias("u"), smaller.alias("v")).distinct()
    )
    before = _state(known)
    while before[0]:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        after_rows = scratch.table(small)
        after = _state(after_rows)
        scratch.drop(known)
        known = after_rows
        if after == before:
            break
        before = after
    roots = known.select(F.col("v").alias("node")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
