"""Near-duplicate vectors of one label by randomised-rotation binary codes.

A unit vector is rotated by a fixed random rotation; its code is the signs of the result and
its correction factor ``f`` the inner product of the vector with its own code (scaled to unit
length).  For another rotated unit vector ``q``, ``(q . code) / f`` is an unbiased estimate
of the cosine with a known error: beyond ``BOUND * sqrt((1 - f^2) / f^2) / sqrt(d - 1)`` it is
as good as never.  Pairs whose upper bound stays below the threshold are discarded; all
others are computed exactly, in double precision, and only these make links.

Pairs meet in bands: a few code bits of further rotations.  The bits of a band follow the size
of the largest label and the number of bands follows from the bits, so that a pair at the
threshold is missed with probability ``MISS`` at most.  Large buckets are split into
blocks, compared block by block.  A pair that meets in several bands counts in the first.
Pairs never leave their task: what does are counts of links and a forest that connects linked
vectors.  Equal vectors are one vector with a multiplicity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import matrix, runs
from .scratch import Scratch

BOUND = 5.0  # standard errors
MISS = 1e-4
BLOCK = 1024  # vectors on a side of a block
ROOM = 256  # vectors of a label for each value of a band


def rotation(d: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    gauss = np.random.Generator(np.random.PCG64([d, number, 977])).standard_normal((d, d))
    q, r = np.linalg.qr(gauss)
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, their signs, correction factors) of unit vectors."""
    turned = unit @ rotation(unit.shape[1], 0).T
    signs = np.where(turned >= 0, 1.0, -1.0)
    return turned, signs, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def upper_bounds(turned: np.ndarray, signs: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the cosines of all rows of ``turned`` with all codes."""
    d = turned.shape[1]
    estimate = turned @ signs.T / (math.sqrt(d) * factors[None, :])
    error = BOUND * np.sqrt(np.maximum(1 - factors**2, 0)) / (factors * math.sqrt(max(1, d - 1)))
    return estimate + error[None, :]


def bands(least_cosine: float, largest: int) -> tuple[int, int]:
    """(bits, number) of the bands for labels of up to ``largest`` vectors."""
    bits = min(24, max(8, math.ceil(math.log2(max(2, largest / ROOM)))))
    agree = (1 - math.acos(least_cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def _keys(unit: np.ndarray, bits: int, number: int) -> np.ndarray:
    """The value of every band, from the signs under rotations of their own."""
    d = unit.shape[1]
    signs = [unit @ rotation(d, 1 + r).T >= 0 for r in range(math.ceil(bits * number / d))]
    flat = np.hstack(signs)[:, : bits * number].reshape(len(unit), number, bits)
    return flat @ (1 << np.arange(bits, dtype=np.int64))


def _linked(rows: np.ndarray, others: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose exact cosine reaches the threshold, bounds first."""
    norms, other_norms = np.linalg.norm(rows, axis=1), np.linalg.norm(others, axis=1)
    turned, _, _ = codes(rows / norms[:, None])
    _, signs, factors = codes(others / other_norms[:, None])
    i, j = np.nonzero(upper_bounds(turned, signs, factors) >= least_cosine)
    found = []
    for at in range(0, len(i), 1 << 15):  # a piece at a time: most pairs of a block may be close
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        cosine = np.einsum("nd,nd->n", rows[a], others[b]) / (norms[a] * other_norms[b])
        found.append(cosine >= least_cosine)
    close = np.concatenate(found) if found else np.zeros(0, bool)
    return i[close], j[close]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, one fewer than nodes in each component."""
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        s, t = top(x), top(y)
        if s != t:
            root[max(s, t)] = min(s, t)
            kept.append((x, y))
    return kept


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors (vec_id, embedding, label)``.

    Vectors link within a label.  Rows link with nothing if ``vec_id``, label or vector is
    null, the vector is empty, zero or has a null or non-finite component, or is of another
    length than the other.  ``n_links`` counts rows, so copies count one by one.
    """
    with Scratch(vectors.sparkSession) as scratch:
        whole = F.transform("embedding", lambda x: x.cast("double"))
        fine = (
            F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
        node = F.when(F.coalesce(fine, F.lit(False)), F.xxhash64("label", "embedding"))
        rows = vectors.select("vec_id", node.alias("node"), "label", whole.alias("v"))
        classes = scratch.table(
            rows.where("node is not null").groupBy("node").agg(
                F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("label").cast("long").alias("label"), F.first("v").alias("v"))
            .withColumn("d", F.size("v")))
        largest = classes.groupBy("label", "d").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
        bits, number = bands(least_cosine, largest)

        def meet(batches):
            for batch in batches:
                for (d,), part in runs([batch.select(["d", "node", "many", "label", "v"])], 1):
                    unit = matrix(part.column("v"), np.float64)
                    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
                    values = _keys(unit, bits, number)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), number).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("d", "label", "node", "many", "v")), lists], ["d", "label", "node", "many", "v", "keys"])

        keyed = scratch.table(classes.sortWithinPartitions("d").mapInArrow(meet, "d int, label long, node long, many long, v array<double>, keys array<long>"))
        met = keyed.select("*", F.posexplode("keys").alias("band", "key"))
        blocks = met.groupBy("d", "label", "band", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("last", F.floor((F.col("n") - 1) / BLOCK).cast("int"))
        placed = met.join(blocks, ["d", "label", "band", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
        dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
            "d", "label", "band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "many", "v", "keys")

        def compare(batches):
            for (_, _, band, _, low, high), part in runs(batches, 6):
                own, node, many = (part.column(c).to_numpy() for c in ("own", "node", "many"))
                v, keys = matrix(part.column("v"), np.float64), matrix(part.column("keys"), np.int64)
                x, y = np.flatnonzero(own == low), np.flatnonzero(own == high)
                i, j = _linked(v[x], v[y], least_cosine)
                i, j = x[i], y[j]
                if low == high:
                    i, j = i[i < j], j[i < j]
                new = ~(keys[i, :band] == keys[j, :band]).any(1) if band else np.ones(len(i), bool)
                i, j = i[new], j[new]
                links = np.bincount(i, many[j], len(node)) + np.bincount(j, many[i], len(node))
                some = np.flatnonzero(links)
                tree = _forest(node[i], node[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*node[some].tolist(), *(a for a, _ in tree)], pa.int64()),
                     pa.array([None] * len(some) + [b for _, b in tree], pa.int64()),
                     pa.array([*links[some].astype(np.int64).tolist(), *([0] * len(tree))], pa.int64())], ["a", "b", "links"])

        found = scratch.table(
            dealt.repartition("d", "label", "band", "key", "low", "high").sortWithinPartitions("d", "label", "band", "key", "low", "high")
            .mapInArrow(compare, "a long, b long, links long"))
        reached = scratch.table(components(found.where("b is not null").select("a", "b"), scratch))
        links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        named = classes.select("node", "least", "many").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
        groups = named.groupBy("component").agg(F.min("least").alias("component_id"))
        by_node = named.join(groups, "component").join(links, "node", "left").select(
            "node", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
        component_id = F.coalesce("component_id", "vec_id")
        return scratch.result(rows.select("vec_id", "node").join(by_node, "node", "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
            F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept")))
