"""Words of many texts at once: positions, hashes and n-gram hashes as arrays.

Texts are UTF-8 bytes of an Arrow string column.  Both word definitions used here
split at ASCII bytes only, so bytes decide as well as characters do.  A word's
hash is a polynomial of its lower-cased (A-Z) bytes modulo 2^64, finished by a
mixing step; equal words have equal hashes in every batch, task and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; bounds the scratch arrays however long a text is, and keeps them in a core's cache.
PIECE = 1 << 16
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWERED = _lower_table()
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[LOWERED]
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64)
                      for b in (_BASE, inverse)]
    return _powers


#: Words are maximal runs of anything but space, \t, \n, \v, \f and \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """Words of a column: ``start``, ``end`` (bytes), ``hash``, and ``first`` (per text, one more at the end)."""

    def __init__(self, column: pa.Array, kind: np.ndarray):
        self.data, self.offsets = text_bytes(column)
        inside = kind[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.first[-1] = len(self.start)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            at = self.start[i]
            power, inverse = _power_tables(int(self.end[j - 1] - at))
            values = _VALUES[self.data[at:self.end[j - 1]]]
            values *= power[:len(values)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
            a, b = self.start[i:j] - at, self.end[i:j] - at
            out[i:j] = mixed((sums[b] - sums[a]) * inverse[a])
            i = j
        return out

    def text(self, i: int) -> bytes:
        """The ``i``-th word, lower-cased."""
        return LOWERED[self.data[self.start[i]:self.end[i]]].tobytes()

    def owner(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, text borders ignored; one per possible start."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = (out + hashes[k:k + size]) * np.uint64(0x9E3779B97F4A7C15 | 1)
        out ^= out >> np.uint64(29)
    return mixed(out + np.uint64(n))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-grams of each text, and how many each text has; a shorter, non-empty text is one gram."""
    counts = np.diff(words.first)
    has = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(has.sum()), np.uint64)
    at = np.concatenate([[0], np.cumsum(has)])
    long = np.flatnonzero(counts >= n)
    if len(long):
        lengths = has[long]
        steps = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(at[long], lengths) + steps] = gram_hashes(words.hash, n)[np.repeat(words.first[long], lengths) + steps]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        part = words.hash[words.first[i]:words.first[i + 1]]
        out[at[i]] = gram_hashes(part, len(part))[0]
    return out, has
