"""Words of UTF-8 text as numpy arrays, hashed without Python loops.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; no byte of a
multi-byte character is among those, so bytes and characters agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CHUNK = 1 << 21


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply, xor-shift; three rounds)."""
    with np.errstate(over="ignore"):
        x = x.astype(_U) + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
        return x ^ (x >> _U(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, and the n + 1 offsets of the rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the n + 1 word offsets of the rows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a word ends with its row
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


def _windows(values: np.ndarray, starts: np.ndarray, lengths, base: int) -> np.ndarray:
    """Polynomial hash of values[start : start + length], modulo 2**64."""
    inverse = pow(base, -1, 2**64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(values * _powers(base, len(values)), dtype=_U)])
        return (sums[starts + lengths] - sums[starts]) * _powers(inverse, len(values) + 1)[starts]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length.

    Bytes are taken in chunks of whole words, so memory stays a few times the chunk.
    """
    out, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + _CHUNK, side="right")))
        part = raw[low : ends[stop - 1]].astype(_U) + _U(1)
        size = ends[at:stop] - starts[at:stop]
        out[at:stop] = mix(_windows(part, starts[at:stop] - low, size, _BASES[seed % 2]) + mix(size, seed + 7), seed)
        at = stop
    return out


def window_hashes(words: np.ndarray, starts: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of ``length`` words; windows must lie within ``words``."""
    return mix(_windows(words, starts, length, _BASES[(seed + 1) % 2]), seed + 13)


def window_starts(word_offsets: np.ndarray, length: int) -> np.ndarray:
    """Where windows of ``length`` words that don't cross a row's end begin."""
    counts = np.maximum(np.diff(word_offsets) - length + 1, 0)
    first = np.repeat(word_offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return first + np.arange(counts.sum())


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20):
    """``batch`` in slices of about ``limit`` text bytes, whole rows each."""
    col = batch.column(column)
    size = np.zeros(len(col), np.int64) if not len(col) else np.diff(buffers(col)[1])
    group = np.cumsum(size) // max(1, limit)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(col)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
