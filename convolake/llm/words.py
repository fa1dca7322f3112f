"""Words of texts as arrays: boundaries and 64-bit hashes for a whole Arrow batch at once.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text.  Everything works on the bytes of
the batch's text buffer, so no Python object is made per word.  Temporary memory
follows ``CHUNK`` (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text worked on at a time

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20_240_229))  # fixed: hashes must agree on every executor
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2 ** 64, kept for the next call."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, CHUNK), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 4 * CHUNK:
            _powers[name] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(32))) * _LEFT
    h = (h ^ (h >> np.uint64(29))) * _RIGHT
    return h ^ (h >> np.uint64(32))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring hashes, in order."""
    return mix(left * _BASE + mix(right + _LEFT))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry for the end); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes."""
    data, at = buffer(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(data: np.ndarray, at: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per text the index of its first word.

    ``separator`` tells of each byte value whether it parts words.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~separator[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word; ``lower`` folds A-Z first."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, "right")))
        origin = starts[first]
        part = data[origin : ends[last - 1]]
        values = _BYTE[_LOWER[part] if lower else part] * _power(_BASE, "up", len(part))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        s, e = starts[first:last] - origin, ends[first:last] - origin
        out[first:last] = mix((total[e] - total[s]) * _power(_INVERSE, "down", len(part) + 1)[s])
        first = last
    return out


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` neighbouring word hashes, built by doubling."""
    if n == 1:
        return h
    half = (n + 1) // 2
    inner = windows(h, half)
    return pair(inner[: len(inner) - (n - half)], inner[n - half :]) if len(h) >= n else h[:0]


def sliding(values: np.ndarray, n: int, ufunc: np.ufunc) -> np.ndarray:
    """``ufunc`` (minimum or maximum) over every ``n`` neighbouring values."""
    width, out = 1, values
    while width < n:
        step = min(width, n - width)
        out = ufunc(out[:-step], out[step:])
        width += step
    return out
