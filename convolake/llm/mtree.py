"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances: with ``R`` the largest norm, each vector gets one more
coordinate ``sqrt(R^2 - |v|^2)`` and each query a zero, so ``dist^2 = |q|^2 + R^2 - 2 q.v`` and
the nearest is the one with the highest score.

The vectors are dealt to trees by their nearest of a few roots; a tree holds a bounded number
of vectors, and a root with more has several.  A tree is stored as pages: a page has a
routing vector, a covering radius, its distance from the tree's root, and for each entry the
distance from the routing vector.  A search visits pages by their lower bounds and uses the
stored distances to leave out pages and entries whose distance need not be computed: by
the triangle inequality they cannot be among the k nearest.

Queries go in blocks: first to the tree that is nearest, then, with the k-th distance
found there, to those other trees whose ball reaches into it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import matrix
from .scratch import Scratch

ROOTS = 64  # at most; taken by hash, their number follows the table's size
TREE = 8_192  # vectors of a tree
PAGE = 128  # entries of a page, about
QUERIES = 512  # of a block
_SLACK = 1e-7  # relative; distances are rounded, so bounds give way a little


def whole_numbers(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, null where one is null or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _lift(v: np.ndarray, square: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the same norm."""
    rest = np.maximum(square - np.einsum("nd,nd->n", v, v), 0)
    return np.hstack([v, np.sqrt(rest)[:, None]])


def _distances(point: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - point) ** 2).sum(1), 0))


def build_pages(ids: np.ndarray, v: np.ndarray, root: np.ndarray, square: float) -> list[dict]:
    """The pages of one tree: entries go to the nearest of evenly spread routing vectors."""
    points = _lift(v, square)
    order = np.argsort(_distances(root, points), kind="stable")
    routing = points[order[:: PAGE]]
    near = np.argmin(
        (points**2).sum(1)[:, None] - 2 * points @ routing.T + (routing**2).sum(1)[None, :], axis=1)
    pages = []
    for r in range(len(routing)):
        own = np.flatnonzero(near == r)
        for part in np.array_split(own, max(1, math.ceil(len(own) / (2 * PAGE)))):
            if len(part):
                away = _distances(routing[r], points[part])
                pages.append({
                    "routing": routing[r], "radius": float(away.max()), "from_root": float(_distances(root, routing[r : r + 1])[0]),
                    "ids": ids[part], "vectors": v[part], "away": away})
    return pages


def search(pages: list[dict], root: np.ndarray, query: np.ndarray, own: int, k: int, square: float, reach: float) -> tuple[list[tuple[int, int]], int]:
    """(the k best (score, id) of one tree within ``reach``, distances computed)."""
    point, norm = np.append(query, 0.0), float(query @ query)
    to_root = float(_distances(point, root[None, :])[0])
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst is on top
    computed, slack = 0, _SLACK * (1 + math.sqrt(norm + square))
    # lower bounds of the pages from the stored distances alone
    queue = [(abs(to_root - p["from_root"]) - p["radius"], False, i) for i, p in enumerate(pages)]
    heapq.heapify(queue)
    while queue:
        bound, exact, i = heapq.heappop(queue)
        if bound > reach + slack:
            break
        page = pages[i]
        if not exact:  # now the true distance to the routing vector, and a better bound
            to_page = float(_distances(point, page["routing"][None, :])[0])
            computed += 1
            page_bound = to_page - page["radius"]
            if queue and page_bound > queue[0][0]:
                heapq.heappush(queue, (page_bound, True, i))
                continue
        else:
            to_page = bound + page["radius"]
        if to_page - page["radius"] > reach + slack:
            continue
        near = np.flatnonzero(np.abs(to_page - page["away"]) <= reach + slack)
        if not len(near):
            continue
        computed += len(near)
        scores = page["vectors"][near] @ query
        for score, vec in zip(scores.tolist(), page["ids"][near].tolist()):
            if vec == own:
                continue
            item = (int(score), -vec)
            if len(best) < k:
                heapq.heappush(best, item)
            elif item > best[0]:
                heapq.heapreplace(best, item)
        if len(best) == k:
            reach = min(reach, math.sqrt(max(norm + square - 2 * best[0][0], 0)))
    return [(s, -v) for s, v in best], computed


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    Queries are the rows of ``vectors (vec_id, embedding)`` whose id is divisible by
    ``every``; candidates are all rows with another id.  Components are floor(scale * x).
    Rows without id, and vectors that are null, empty or hold null or non-finite components
    take no part; vectors of different length never meet.  Equal scores go to the smaller
    id, and rows that repeat are candidates each.  Exact while scores stay below 2**53.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        fine = scratch.table(
            vectors.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v")).where("vec_id is not null and size(v) > 0")
            .withColumn("d", F.size("v")))
        square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
        shape = fine.groupBy("d").agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()  # a row for each length
        largest = {r["d"]: float(r["square"]) for r in shape}
        total = sum(r["n"] for r in shape)
        wanted = max(1, min(ROOTS, math.isqrt(total // PAGE + 1)))
        roots: dict[int, np.ndarray] = {}
        for d in largest:
            chosen = fine.where(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).select("v").collect()
            roots[d] = _lift(np.array([r[0] for r in chosen], np.float64), largest[d])

        def deal(batches):
            for batch in batches:
                d = batch.column(2).to_numpy()
                near, away = np.zeros(len(d), np.int32), np.zeros(len(d))
                for size in np.unique(d):
                    own = np.flatnonzero(d == size)
                    points = _lift(matrix(pa.chunked_array([batch.column(1).take(pa.array(own))]), np.float64), largest[int(size)])
                    table = np.stack([_distances(r, points) for r in roots[int(size)]], 1)
                    near[own], away[own] = table.argmin(1), table.min(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near), pa.array(away)], ["vec_id", "v", "d", "root", "away"])

        dealt = scratch.table(fine.mapInArrow(deal, "vec_id long, v array<long>, d int, root int, away double"))
        sizes = dealt.groupBy("d", "root").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        sizes = sizes.withColumn("last", F.floor((F.col("n") - 1) / TREE).cast("int")).drop("n")
        balls = {(r["d"], r["root"]): r["radius"] for r in sizes.collect()}  # at most ROOTS for each length

        def build(key, rows: pd.DataFrame) -> pd.DataFrame:
            d, root = int(key[0]), int(key[1])
            pages = build_pages(rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(np.float64), roots[d][root], largest[d])
            return pd.DataFrame({
                "d": d, "root": root, "tree": int(key[2]), "routing": [p["routing"] for p in pages], "radius": [p["radius"] for p in pages],
                "from_root": [p["from_root"] for p in pages], "ids": [p["ids"] for p in pages],
                "vectors": [p["vectors"].reshape(-1) for p in pages], "away": [p["away"] for p in pages]})

        index = scratch.table(
            dealt.join(sizes.select("d", "root", "last"), ["d", "root"])
            .withColumn("tree", F.pmod(F.xxhash64("vec_id", "v"), F.col("last") + 1).cast("int"))
            .groupBy("d", "root", "tree").applyInPandas(build, (
                "d int, root int, tree int, routing array<double>, radius double, from_root double, ids array<long>, "
                "vectors array<double>, away array<double>")))
        queries = dealt.where(F.col("vec_id") % every == 0).select("vec_id", "v", "d", "root").dropDuplicates(["vec_id", "v"])

        def answer(key, pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if pages.empty or asked.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            d, root = int(key[0]), int(key[1])
            tree = [{
                "routing": np.asarray(p.routing), "radius": p.radius, "from_root": p.from_root, "ids": np.asarray(p.ids),
                "vectors": np.asarray(p.vectors).reshape(-1, d), "away": np.asarray(p.away)} for p in pages.itertuples()]
            out = []
            for q in asked.itertuples():
                found, _ = search(tree, roots[d][root], np.asarray(q.v, np.float64), q.vec_id, k, largest[d], q.reach)
                out.extend((q.vec_id, v, s) for s, v in found)
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

        trees = sizes.select("d", "root", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("tree"))
        block_count = max(1, math.ceil(queries.count() / QUERIES))
        blocked_pages = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(block_count - 1))))

        def asked_of(asked: DataFrame) -> DataFrame:
            block = F.pmod(F.xxhash64("vec_id"), F.lit(block_count)).cast("int")
            sent = asked.join(trees, ["d", "root"]).withColumn("block", block)
            key = ["d", "root", "tree", "block"]
            return blocked_pages.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(answer, "query_id long, vec_id long, score long")

        def best_of(found: DataFrame) -> DataFrame:
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        first = scratch.table(best_of(asked_of(queries.withColumn("reach", F.lit(float("inf"))))))
        worst = first.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)

        def others(batches):
            for batch in batches:
                out: list[tuple] = []
                for vec, v, d, home, score in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    point = np.append(np.array(v, np.float64), 0.0)
                    norm = float(point @ point)
                    reach = math.sqrt(max(norm + largest[d] - 2 * score, 0)) if score is not None else float("inf")
                    away = _distances(point, roots[d])
                    out.extend((vec, v, d, r, reach) for r in range(len(roots[d])) if r != home and (d, r) in balls
                               and away[r] - balls[d, r] <= reach + _SLACK * (1 + reach))
                    if len(out) > 2000:
                        yield _sent(out)
                        out = []
                yield _sent(out)

        rest = queries.join(worst.select(F.col("query_id").alias("vec_id"), "score"), "vec_id", "left").select("vec_id", "v", "d", "root", "score")
        second = asked_of(rest.mapInArrow(others, "vec_id long, v array<long>, d int, root int, reach double"))
        found = first.select("query_id", "vec_id", "score").unionByName(second)
        return scratch.result(best_of(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["vec_id", "v", "d", "root", "reach"])
