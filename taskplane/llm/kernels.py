"""Vectorised text kernels over the bytes of Arrow string columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``, which in UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` on
code points. Words, lines and windows get 64-bit hashes; two different words share one with probability 2**-64, two
windows with 2**-60 at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word up to which it is hashed eight at a time; longer ones (they are few) go through xxh3, whatever their length.
_VECTOR = 64
_TAIL = (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - np.arange(9, dtype=np.uint64)) * np.uint64(8) % np.uint64(64))).astype(np.uint64)
_TAIL[0] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offsets: np.ndarray, most: int = 1 << 21):
    """Ranges (i, j) of documents with about ``most`` bytes in all; a longer document comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20):
    """The batch in runs of rows with about ``most`` bytes of text, so that what is made from one run stays small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    for i, j in pieces(offsets, most):
        yield batch.slice(i, j - i)


def spans(is_in: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set bytes; a run never crosses documents."""
    if not is_in.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    first, last = is_in.copy(), is_in.copy()
    first[1:] &= ~is_in[:-1]
    first[filled] = is_in[filled]
    last[:-1] &= ~is_in[1:]
    tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[tails] = is_in[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end]. Eight bytes at a time go through ``mix``, so that no arithmetic of one modulus lets different
    words meet by their structure."""
    length = ends - starts
    out = mix(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    if not starts.size:
        return out
    if lower:
        data = LOWER[data]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(data.size + 1, dtype="<u8", buffer=padded, strides=(1,))
    rest = np.flatnonzero((length > 0) & (length <= _VECTOR))
    at, left, h = starts[rest], length[rest], out[rest]
    while rest.size:
        h = mix(h ^ (eight[at] & _TAIL[np.minimum(left, 8)])) + U64(0xC2B2AE3D27D4EB4F)
        done = left <= 8
        out[rest[done]] = h[done]
        more = ~done
        rest, at, left, h = rest[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(length > _VECTOR).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data, 20240229)
    return mix(out)


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags over each document's bytes."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values; len(h) - n + 1 of them, across documents too."""
    m = max(0, h.size - n + 1)
    out = np.zeros(m, dtype=U64)
    for k in range(n):
        out = out * U64(0xC2B2AE3D27D4EB4F) + h[k : k + m]
    return mix(out)


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each document; the whole sequence is one shingle where it is shorter."""
    full, out, empty = windows(h, n), [], np.zeros(0, U64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            s = np.sort(full[a : b - n + 1])
            keep = np.empty(s.size, dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(windows(h[a:b], b - a) ^ U64(b - a) if b > a else empty)
    return out
