"""A filter of fixed size for sets of keys that must not grow in tasks or on the driver.

A key is a pair of longs that are already well mixed.  A key that was put in is always
found; another one is found by chance as often as both its bits are taken.  Use it only
where such a chance costs work, never a result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 1 << 26  # 8 MB
SLICES = 64


@dataclass(frozen=True)
class KeyFilter:
    bits: bytes  # a power of two of them, times eight

    @classmethod
    def empty(cls, n_bits: int = BITS) -> KeyFilter:
        return cls(bytes(n_bits // 8))

    def has_one(self, first: int, second: int) -> bool:
        n = len(self.bits) * 8 - 1
        a, b = first & n, second & n
        return bool(self.bits[a >> 3] >> (a & 7) & self.bits[b >> 3] >> (b & 7) & 1)

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of every key whether it may be in the set."""
        bits, n = np.frombuffer(self.bits, np.uint8), np.int64(len(self.bits) * 8 - 1)
        found = np.ones(len(first), np.uint8)
        for part in (first, second):
            at = part.view(np.int64) & n
            found &= bits[at >> 3] >> (at & 7).astype(np.uint8)
        return (found & 1).astype(bool)

    def united(self, other: KeyFilter) -> KeyFilter:
        return KeyFilter((np.frombuffer(self.bits, np.uint8) | np.frombuffer(other.bits, np.uint8)).tobytes())


SLICE = "slice int, bits binary"


def _rows(slices: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(slices), pa.int32()), pa.array([x.tobytes() for x in slices.values()], pa.binary())], ["slice", "bits"])


def marked(keys: Iterable[tuple[np.ndarray, np.ndarray]], n_bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """The slices, as ``SLICE`` rows, of a task's filter of ``keys``."""
    bits = np.zeros(n_bits // 8, np.uint8)
    for pair in keys:
        for part in pair:
            at = part.view(np.int64) & np.int64(n_bits - 1)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    parts = bits.reshape(SLICES, -1)
    yield _rows({i: parts[i] for i in range(SLICES) if parts[i].any()})


def united(slices: DataFrame, n_bits: int = BITS) -> KeyFilter:
    """The filter of all tasks' ``SLICE`` rows, which are united slice by slice."""
    def unite(batches):
        joined: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                joined[i] = joined.get(i, 0) | np.frombuffer(raw.as_buffer(), np.uint8)
        yield _rows(joined)

    width, whole = n_bits // 8 // SLICES, bytearray(n_bits // 8)
    for i, raw in slices.repartition("slice").mapInArrow(unite, SLICE).collect():
        whole[i * width : (i + 1) * width] = raw
    return KeyFilter(bytes(whole))


def key_filter(keys: DataFrame, n_bits: int = BITS) -> KeyFilter:
    """The filter of all rows of ``keys`` (two long columns).

    Tasks fill filters of their own, which are united slice by slice; ``SLICES`` rows of
    together ``n_bits`` bits come to the driver.
    """
    def fill(batches):
        return marked(((batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches), n_bits)

    return united(keys.mapInArrow(fill, SLICE), n_bits)
