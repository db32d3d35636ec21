"""Whole texts as byte arrays: the numeric base of the operators that work inside Arrow batches.

Texts of a batch are read as slices of one UTF-8 buffer, cut at text ends into pieces of
about a megabyte, so that the arrays of a task stay small whatever a batch holds. Only a
text longer than a piece makes its piece longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
U64 = np.uint64
#: An odd number, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def utf8(column: pa.Array, lower: bool = False, pad: tuple[bytes, bytes] | None = None) -> pa.Array:
    """The texts as binary, null as empty, letters in lower case and padded if asked."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    texts = texts.cast(pa.large_binary())
    if pad:
        kind = pa.large_binary()
        before, after, none = (pa.scalar(x, kind) for x in (*pad, b""))
        texts = pc.binary_join_element_wise(before, texts, after, none)
    return texts


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of rows with their bytes and the offsets of the texts in these bytes."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(n, max(stop, start + 1))
        low, high = int(offsets[start]), int(offsets[stop])
        yield slice(start, stop), data[low:high], (offsets[start : stop + 1] - low).astype(np.int64)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 on an array of its own."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        out = np.full(size, base, U64)
        out[:1] = 1
        return np.cumprod(out, dtype=U64)

    return up(BASE), up(INVERSE)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of them."""
    return _powers(1 << max(20, int(size).bit_length()))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of ``codes[i] * BASE**i``, one more than there are codes, for hashes of any stretch."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches; equal stretches have equal hashes wherever they start."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(BASE))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal word stretches, none across texts, and the words before each text."""
    n = len(is_word)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | edge[1:n]
    finishes = is_word.copy()
    finishes[:-1] &= ~is_word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lists(values, counts, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values per row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
