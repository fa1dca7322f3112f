"""Groups of sorted rows, streamed out of Arrow batches inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of consecutive rows that agree in the first ``keys`` (numeric) columns."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a].item() for c in columns)
            if current is not None and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if current is not None:
        yield current, pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    rows = column.combine_chunks()
    rows = rows if not isinstance(rows, pa.ChunkedArray) else rows.chunk(0)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(rows), -1)
