"""Words of an Arrow text column as flat numpy arrays.

A word is a maximal run of bytes outside a separator set. Every word gets a 64-bit hash (a polynomial over
random byte values, finished with a bit mixer), worked out for a whole block of texts at once, so that no
Python object is made per word. Blocks hold about ``BLOCK`` bytes of whole texts; a longer text is a block of
its own, so memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
BLOCK = 1 << 21

SPACES = b" \t\n\x0b\x0c\r"
#: ASCII other than letters and digits; bytes of multi-byte characters are part of words.
MARKS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finishing step of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit values that depend on the seed only."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed)) | np.uint64(1)


_RATIO = np.uint64(0xD1342543DE82EF95)
_RATIO_INVERSE = np.uint64(pow(int(_RATIO), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, BLOCK)
        for i, r in enumerate((_RATIO, _RATIO_INVERSE)):
            t = np.full(m, r, np.uint64)
            t[0] = 1
            _powers[i] = np.cumprod(t, dtype=np.uint64)
    return _powers[0], _powers[1]


def _byte_values(seed: int, fold: bool) -> np.ndarray:
    v = constants(256, seed)
    if fold:
        v[65:91] = v[97:123]
    return v


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(batch: pa.RecordBatch, text: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each."""
    if batch.num_rows == 0:
        return
    _, at = text_bytes(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = int(max(lo + 1, np.searchsorted(at, at[lo] + size, "right") - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Words:
    """The words of some texts: ``hash`` per word, ``doc`` (position of its text), ``first`` (per text, the
    number of words before it; one more entry than texts), ``start`` and ``end`` (byte positions). ``fold``:
    hash A-Z as a-z. ``lower``: hash all letters as lower-case ones (this never adds or removes a word)."""

    def __init__(self, column: pa.Array, separators: bytes = SPACES, fold: bool = True, seed: int = 1, lower: bool = False):
        data, at = text_bytes(column)
        n, docs = len(data), len(at) - 1
        if n == 0:
            self.hash, self.doc = np.empty(0, np.uint64), np.empty(0, np.int64)
            self.start = self.end = np.empty(0, np.int64)
            self.first = np.zeros(docs + 1, np.int64)
            return
        inside = np.ones(256, bool)
        inside[np.frombuffer(separators, np.uint8)] = False
        kept = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, kept[:-1]
        self.start = np.flatnonzero(kept & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, kept[1:]
        self.end = np.flatnonzero(kept & (~after | edge[1:])) + 1
        power, inverse = _power_tables(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_byte_values(seed, fold)[data] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))
        if lower and (data >= 128).any():
            self.hash = Words(pc.utf8_lower(column), separators, True, seed).hash

    def grams(self, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words of one text and the position of each one's first word."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.zeros(m, np.uint64)
        for i, c in enumerate(constants(n, seed)):
            total += self.hash[i : i + m] * c
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(total[at]), at


def int64(x: np.ndarray) -> np.ndarray:
    """The same bits as signed values, which is what Spark stores."""
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per pair of neighbouring bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def id_column(column: pa.Array) -> np.ndarray:
    """Ids as int64; a missing one counts as the smallest."""
    return column.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
