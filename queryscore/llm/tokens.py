"""Words of Arrow text batches as numpy hash arrays.

Texts are cut and hashed byte-wise over the column's UTF-8 buffer, a few documents at a time,
so no Python object is made per word and memory follows ``CHUNK_BYTES`` (or the one text that is
longer than that).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_GRAM_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of normalised words: every ASCII byte that is neither a letter nor a digit.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(b).isalnum() for b in range(128)]

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base, inverse) -> np.ndarray:
    """Polynomial hash of every ``values[start:end]``, from one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(inverse, len(values) + 1)[starts])


@dataclass
class Words:
    """Hashes of the words of some documents; document ``i`` owns ``offsets[i]:offsets[i + 1]``."""

    hashes: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position) of every run of ``n`` words that lies in one document."""
        if len(self.hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(len(self.hashes) - n + 1)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        at = at[doc[at] == doc[at + n - 1]]
        return _span_sums(self.hashes, at, at + n, _GRAM, _GRAM_INVERSE), at


def words_of(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Words of the documents ``data[bounds[i]:bounds[i + 1]]``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    # A document border ends a word as a separator does.
    new = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    borders = bounds[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    new[borders] |= inside[borders + 1]
    last[borders - 1] |= inside[borders]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    hashes = _span_sums(data.astype(np.uint64) + np.uint64(1), starts, ends, _BASE, _BASE_INVERSE)
    return Words(hashes, np.searchsorted(starts, bounds), data, starts, ends)


def chunks(text: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, bounds) of runs of rows; a null is an empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        behind = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        behind = min(max(behind, first + 1), len(text))
        bounds = offsets[first : behind + 1]
        yield first, behind, data[bounds[0] : bounds[-1]], bounds - bounds[0]
        first = behind
