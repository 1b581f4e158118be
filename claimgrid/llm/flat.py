"""Numpy helpers over the text column of an Arrow batch: words, rolling hashes, window minima.

A batch is worked on in slices of whole documents of a few MB, so that memory is bounded by the slice and the
longest single document. Hashes are polynomials modulo 2**64 with odd bases: the hash of any stretch comes from
two prefix sums. They are the same in every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
BASE, BASE2, BYTE_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(4096, n + n // 8)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        have = _POWERS[base] = (made[0], made[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """P[j] = sum of values[i] * base**i for i < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(base, len(values))[0], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], wherever it stands."""
    return mix((prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batch with about ``limit`` bytes of text each: rows, bytes, and the offsets of each text."""
    at = batch.schema.get_field_index(column)
    text = pc.fill_null(batch.column(at).cast(pa.string()), "")
    if len(text) == 0:
        return
    off = np.frombuffer(text.buffers()[1], np.int32)[text.offset: text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(off, off[low] + limit, side="right")) - 1)
        yield batch.slice(low, high - low), data[off[low]: off[high]], off[low: high + 1] - off[low]
        low = high


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def words(data: np.ndarray, off: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or of runs of ``solid`` bytes), and for each document the
    index of its first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13))) if solid is None else solid
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = off[(off > 0) & (off < len(data))]
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word; equal words have equal hashes."""
    prefix = prefix_hash(data.astype(np.uint16) + np.uint16(1), BYTE_BASE)
    return stretch_hash(prefix, starts, ends, BYTE_BASE)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[p : p + width] for every p; at most three passes whatever the width."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


def inside(doc_first: np.ndarray, n: int, width: int) -> np.ndarray:
    """True for every position p < n - width + 1 whose window of ``width`` stays within one document."""
    ok = np.zeros(max(0, n - width + 1), bool)
    lo, hi = doc_first[:-1], doc_first[1:] - width + 1
    keep = hi > lo
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, lo[keep], 1)
    np.add.at(edge, hi[keep], -1)
    return np.cumsum(edge)[: len(ok)] > 0


def doc_of(doc_first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(doc_first, at, side="right") - 1
