"""Severity grades of texts by cumulative-link ordinal regression on sparse features.

A text's features are its words and their first four to eight bytes, which inflected
forms share, counted in a fixed number of hash buckets; a feature's value is ``log(1 + count)``.  The model has one
weight for each kept bucket, shared by all thresholds:

    P(grade > k) = 1 / (1 + exp(theta_k - w x)),   theta_0 <= theta_1 <= ...

and gives the expected grade, the sum of these probabilities.  It is fitted on at most
``max_rows`` labelled rows: the buckets that differ most between grade 0 and the others
are kept, and the likelihood is maximised by gradient steps on the driver, on a matrix of
at most ``max_rows`` rows and ``max_features`` columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)  # bytes
PORTION = 1 << 18  # bytes of text worked on at a time: a task's arrays take about 50 times as many


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted, of the kept features
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row for each score."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each feature, bucket) of runs of lower-cased texts."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for row, end, data, at in W.chunks(lowered, PORTION):
        starts, ends, first = W.spans(data, at)
        if not len(starts):
            yield row, end, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        text = np.repeat(np.arange(row, end), np.diff(first))
        whole = W.hashes(data, starts, ends)
        every, rows, packed = [whole], [text], np.zeros(len(starts), np.uint64)
        for i in range(max(PREFIXES)):
            long = np.flatnonzero(ends - starts > i)
            packed[long] = (packed[long] << np.uint64(8)) | data[starts[long] + i].astype(np.uint64)
            if i + 1 in PREFIXES:
                every.append(W.mix(packed[long] + np.uint64(0x9E37_79B9 * (i + 1))))
                rows.append(text[long])
        yield row, end, np.concatenate(rows), (np.concatenate(every) >> np.uint64(44)).astype(np.int64)


def _counted(texts: pa.Array, kept: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, index among ``kept``, log(1 + count)) of the features that are kept."""
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    for row, end, text, bucket in features(texts):
        index = place[bucket]
        hit = index >= 0
        key, count = np.unique(text[hit] * np.int64(len(kept)) + index[hit], return_counts=True)
        yield row, end, key // max(1, len(kept)), key % max(1, len(kept)), np.log1p(count)


def _select(sample: DataFrame, max_features: int, least: int) -> np.ndarray:
    """Buckets whose presence differs most between grade 0 and higher grades."""
    def presence(batches):
        seen = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            high = (batch.column(1).to_numpy() > 0).astype(np.int64)
            for _, _, text, bucket in features(batch.column(0)):
                each = np.unique(text * np.int64(BUCKETS) + bucket)
                np.add.at(seen, (high[each // BUCKETS], each % BUCKETS), 1)
        some = np.flatnonzero(seen.sum(0))
        for part in np.array_split(some, max(1, len(some) >> 16)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part]), pa.array(seen[1, part])], ["bucket", "low", "high"])

    low, high = F.sum("low"), F.sum("high")
    sizes = sample.agg(F.count(F.when(F.col("grade") == 0, 1)), F.count(F.when(F.col("grade") > 0, 1))).head()
    n0, n1 = max(1, sizes[0]), max(1, sizes[1])
    apart = F.abs(F.log((high + 0.5) / n1) - F.log((low + 0.5) / n0)) * F.sqrt(high + low)
    best = (
        sample.select("text", "grade").mapInArrow(presence, "bucket long, low int, high int")
        .groupBy("bucket").agg(low.alias("low"), high.alias("high"), apart.alias("apart"))
        .where(F.col("low") + F.col("high") >= least).orderBy(F.desc("apart"), "bucket").limit(max_features)
    )
    return np.array(sorted(r[0] for r in best.select("bucket").collect()), np.int64)  # max_features numbers


def fit(documents: DataFrame, graded: DataFrame, max_rows: int = 20_000, max_features: int = 2048, least: int = 5,
        steps: int = 300) -> Model:
    """A model from ``documents (doc_id, text, ...)`` and ``graded (doc_id, grade)``.

    Of more than ``max_rows`` graded ids those with the smallest hashes are taken.  Grades
    and ids that are null are left out, as are ids without a document.  Without rows of at
    least two grades, every text gets the lowest grade.
    """
    chosen = (
        graded.where("grade is not null and doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rows)
    )
    with Scratch(documents.sparkSession) as scratch:
        # at most max_rows pairs of numbers, so texts of other documents never move; copies of one
        # text would make its chance words look telling.  Written once: all documents are read for it
        sample = scratch.table(
            documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("grade").alias("grade")))
        return _learned(sample, max_features, least, steps)


def _learned(sample: DataFrame, max_features: int, least: int, steps: int) -> Model:
    """A model from different texts and their grades."""
    bound = sample.agg(F.max("grade"), F.min("grade")).head()
    if bound[0] is None or bound[0] == bound[1]:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(1, np.inf))
    kept = _select(sample, max_features, least)

    def rows(batches):
        for batch in batches:
            grade = batch.column(1).to_pylist()
            for row, end, text, index, value in _counted(batch.column(0), kept):
                at = np.searchsorted(text, np.arange(row, end + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grade[row:end], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(index.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.astype(np.float32)))],
                    ["grade", "index", "value"])

    matrix = sample.select("text", "grade").mapInArrow(rows, "grade int, index array<int>, value array<float>").toArrow()
    matrix = matrix.combine_chunks()  # at most max_rows sparse rows of max_features columns
    index, value = (pc.list_flatten(matrix.column(c)).to_numpy() for c in ("index", "value"))
    length = pc.list_value_length(matrix.column("index")).to_numpy()
    return _maximise(matrix.column("grade").to_numpy().astype(np.int64), np.repeat(np.arange(len(length)), length), index, value, kept, int(bound[0]), steps)


def _maximise(grade, row, index, value, kept, highest: int, steps: int, ridge: float = 1e-4) -> Model:
    """Maximum of the mean log likelihood less ``ridge`` |w|^2 / 2, by Adam steps on the whole matrix."""
    n, m = len(grade), len(kept)
    share = np.array([np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(highest)])
    start = -np.log(share / (1 - share))
    # thresholds as a first one and the logarithms of the gaps, which keeps them in order
    point = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second, rate = np.zeros_like(point), np.zeros_like(point), 0.1
    for step in range(1, steps + 1):
        weights, gaps = point[:m], np.exp(np.clip(point[m + 1 :], -20, 20))
        theta = point[m] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, weights[index] * value, n)
        above = _logistic(score[:, None] - theta[None, :])
        padded = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])  # P(grade >= k)
        slope = padded * (1 - padded)
        here = np.arange(n)
        mass = np.maximum(padded[here, grade] - padded[here, grade + 1], 1e-12)
        by_score = (slope[here, grade] - slope[here, grade + 1]) / mass
        by_theta = np.zeros((n, highest))
        low, high = grade > 0, grade < highest
        by_theta[here[low], grade[low] - 1] -= (slope[here, grade] / mass)[low]
        by_theta[here[high], grade[high]] += (slope[here, grade + 1] / mass)[high]
        by_theta = by_theta.mean(0)
        later = np.cumsum(by_theta[::-1])[::-1]
        gradient = np.concatenate([
            np.bincount(index, by_score[row] * value, m) / n - ridge * weights, [by_theta.sum()], later[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        point = point + rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(np.clip(point[m + 1 :], -20, 20))
    return Model(kept, point[:m], point[m] + np.concatenate([[0], np.cumsum(gaps)]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``severity`` (expected grade) and ``any_severity`` (probability of a grade above 0).

    Null, empty and word-less texts are scored as texts without features.  Columns of these
    two names in ``docs`` are replaced.
    """
    docs = docs.drop("severity", "any_severity")
    names = docs.columns

    def run(batches):
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for row, end, text, index, value in _counted(batch.column(batch.schema.get_field_index("text")), model.buckets):
                total[row:end] = np.bincount(text - row, model.weights[index] * value, end - row)
            above = model.above(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(1)), pa.array(above[:, 0])], [*names, "severity", "any_severity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, severity double, any_severity double")


def grades(labels: DataFrame, toxic: Column, worse: Column) -> DataFrame:
    """``doc_id, grade`` of labelled ids: 0 where ``toxic`` is 0, 1 where it is 1, 2 where ``worse`` holds as well.

    Of several labels of one id the highest grade counts.
    """
    graded = labels.where(toxic.isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.when(toxic == 0, 0).when(F.coalesce(worse, F.lit(False)), 2).otherwise(1).alias("grade"))
    return graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
