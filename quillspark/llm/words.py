"""Vectorised text kernel: words, lines and n-grams of whole Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Everything works on the batch's UTF-8
buffer with numpy, so no Python object is made per word. Hashes are 64 bits wide, equal in every task
and on every machine.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Spans longer than this are hashed by BLAKE2b; shorter ones by a polynomial over tables of this length.
SPAN = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_lower = _byte.copy()
_lower[65:91] = _byte[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: list[np.ndarray] = []


def _pows() -> list[np.ndarray]:
    if not _tables:
        base = 0xD6E8FEB86659FD93
        _tables.extend((_powers(base, SPAN), _powers(pow(base, -1, 1 << 64), SPAN)))
    return _tables


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; spans ascend and don't overlap. lower: A-Z count as a-z."""
    table, (up, down) = (_lower if lower else _byte), _pows()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + SPAN, "right"))
        if j <= i:
            raw = data[base : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(raw.translate(_LOWER) if lower else raw, digest_size=8).digest(), "little")
            i += 1
            continue
        part = data[base : ends[j - 1]]
        run = np.empty(len(part) + 1, np.uint64)
        run[0] = 0
        np.cumsum(table[part] * up[: len(part)], out=run[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((run[b] - run[a]) * down[np.minimum(a, SPAN - 1)] + (b - a).astype(np.uint64))
        i = j
    return out


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass
class Batch:
    """data: UTF-8 bytes of all texts; off: each text's bounds; starts, ends: the words; at: each text's bounds in them."""

    data: np.ndarray
    off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.n_words)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the bounds of a string column's values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    if not len(column) or what is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(what, np.uint8)[off[0] : off[-1]], off - off[0]


def split(column: pa.Array | pa.ChunkedArray) -> Batch:
    data, off = buffers(column)
    space = IS_SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    full = off[1:] > off[:-1]
    first[off[:-1][full]] = True
    last[off[1:][full] - 1] = True
    inside = ~space
    starts, ends = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
    return Batch(data, off, starts, ends, np.searchsorted(starts, off))


def grams(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each place on, for every place whose n words lie in one text; and those places."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keep = np.ones(m, bool)
    for back in range(1, n):  # places less than n words before a text's end
        late = at[1:] - back
        keep[late[(late >= 0) & (late < m) & (late >= at[:-1])]] = False
    out = np.zeros(m, np.uint64)
    seed = _ODD
    for j in range(n):
        out += words[j : j + m] * np.uint64(seed)
        seed = seed * 0xD1342543DE82EF95 % (1 << 64) | 1
    places = np.flatnonzero(keep)
    return mix(out[places]), places


def texts_in_parts(column: pa.Array, most: int = 1 << 21):
    """Bounds (first, last + 1) of runs of texts of about `most` bytes, so that temporaries stay small."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def spread(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values over each text's words."""
    run = np.concatenate(([0], np.cumsum(values)))
    return run[at[1:]] - run[at[:-1]]
