"""Bytes, words and hashes of a batch of texts as numpy arrays.

A batch is one uint8 array and the offsets of its documents. Work goes in blocks of a few MB, so
memory stays bounded by `BLOCK` or by the longest single document. Hashes are polynomials modulo
2^64 over a table of random 64-bit byte values, finished by an avalanche step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
STRETCH = 1 << 16  # bytes whose words are hashed at once
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NOT_BLANK = ~BLANK
ALNUM = np.zeros(256, bool)  # digits, letters and every byte above ASCII
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LETTER = ALNUM.copy()
LETTER[0x30:0x3A] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n + 4096, STRETCH + 4096, min(2 * len(_powers[0]), BLOCK + 4096))
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mix(h + np.uint64((salt * 0xD1342543DE82EF95) & (2**64 - 1)))


def batch_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK):
    """(first, last) document ranges of at most `size` bytes, or of one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the first word of each document (n + 1 values)."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(before):
        before[0] = False
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, n + 1 values; spans are read with `span_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order that do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STRETCH, "right")))
        lo, hi = starts[first], ends[last - 1]
        out[first:last] = span_hash(prefix_hash(data[lo:hi]), starts[first:last] - lo, ends[first:last] - lo)
        first = last
    return mix(out + (ends - starts).astype(np.uint64))


def beginning_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]):
    """(size, spans longer than that, their first bytes as `span_hash` reads them) for ascending `sizes`."""
    long, found, done = np.arange(len(starts)), np.zeros(len(starts), np.uint64), 0
    for size in sizes:
        keep = ends[long] - starts[long] > size
        long, found = long[keep], found[keep]
        for i in range(done, size):
            found += BYTE_VALUE[data[starts[long] + i]] * np.uint64(pow(BASE, i, 1 << 64))
        done = size
        yield size, long, found


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words per document; a document of fewer words, but not none,
    has one shingle of them all. Returns hashes and the first shingle of each document."""
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(n_words.dtype))
    at = np.concatenate([[0], np.cumsum(n)])
    full = max(len(words) - size + 1, 0)
    rolled = np.zeros(full, np.uint64)
    factor = 1
    for j in range(size):
        rolled += words[j : j + full] * np.uint64(factor)
        factor = factor * BASE & (2**64 - 1)
    out = np.empty(at[-1], np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    start = first[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc])
    long = n_words[doc] >= size
    out[long] = mix(rolled[start[long]])
    for length in range(1, size):
        here = n_words[doc] == length
        if here.any():
            h = np.zeros(int(here.sum()), np.uint64)
            factor = 1
            for j in range(length):
                h += words[start[here] + j] * np.uint64(factor)
                factor = factor * BASE & (2**64 - 1)
            out[here] = salted(h, length)
    return out, at


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpacked(blob, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(blob or b"", kind)
