"""Numpy kernels over whole columns of text, shared by the operators here.

They run inside Spark tasks on one Arrow batch at a time.  A batch is worked
through in chunks of about ``CHUNK`` bytes, cut between documents, so memory
follows the longest document and not the batch.  Words are the maximal runs of
bytes other than space and U+0009..U+000D; spans are compared by a 64-bit
polynomial hash with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, kept by the worker."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 2 * CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class SpanHash:
    """64-bit hashes of any spans [start, end) of a byte or code array."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = powers(n + 1)
        if codes.dtype == np.uint8:
            terms = _SYMBOL[codes]
        else:
            terms = mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        terms *= up[:n]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64))


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = pc.fill_null(column, empty)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if large else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of documents with at most ``limit`` bytes, or one document."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def split_spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that stay within a document.

    Returns starts, ends and, per document boundary, the index of its first run.
    """
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge[offs] = True
    starts = np.flatnonzero(inside & edge[:-1])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def split_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return split_spans(~SEPARATOR[buf], offs)


def per_document(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each document."""
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive items; shorter input gives none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out)


def windows_within(word_offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of ``size`` words inside a document, and their document."""
    n_words = np.diff(word_offs)
    n = np.maximum(n_words - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(len(doc)) - first[doc] + word_offs[:-1][doc], doc


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the key occurs elsewhere too; the key occurred at a smaller index."""
    n = len(keys)
    again, later = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:]] = same
        again[order[1:]] = same
        again[order[:-1]] |= same
    return again, later


def keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that also tell documents of one chunk apart."""
    return mix(hashes ^ mix((doc.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)))
