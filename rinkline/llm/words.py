"""Words and word shingles of whole Arrow batches as 64-bit hashes, without a loop over words.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, with A-Z lowered. Its hash is a polynomial over the
bytes modulo 2**64, taken from running sums over the whole batch, then mixed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """Words of a batch: ``first[d]`` to ``first[d + 1]`` are those of row ``d``."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row_start: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (three xor-shifts and two odd products)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def words_of(texts: pa.Array) -> Words:
    """Words of every text; byte positions are within the row's own text."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    inside = ~SPACE[data]
    opens = np.ones(n + 1, dtype=bool)
    opens[1:n] = ~inside[:-1]
    opens[offsets] = True
    start = np.flatnonzero(inside & opens[:n])
    shut = np.ones(n, dtype=bool)
    shut[: n - 1] = ~inside[1:]
    ends = offsets[1:] - 1
    shut[ends[ends >= 0]] = True
    end = np.flatnonzero(inside & shut) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    row_start = np.repeat(offsets[:-1], np.diff(first))
    return Words(first, start - row_start, end - row_start, hashes, row_start)


def shingles_of(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``k``-word shingle and the first shingle of each row (one entry more than rows).

    A row with fewer words, but at least one, has one shingle of all its words.
    """
    n = len(words.hash)
    per_row = np.diff(words.first)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        full += words.hash[j : j + len(full)] * factors[j]
    full = mix(full)
    counts = np.where(per_row >= k, per_row - k + 1, np.minimum(per_row, 1))
    first = np.zeros(len(per_row) + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    out = np.zeros(first[-1], dtype=np.uint64)
    rows = np.repeat(np.arange(len(per_row)), counts)
    place = np.arange(first[-1]) - first[rows] + words.first[rows]
    long = per_row[rows] >= k
    out[long] = full[place[long]]
    for d in np.flatnonzero((per_row > 0) & (per_row < k)):
        own = words.hash[words.first[d] : words.first[d + 1]]
        total = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
        out[first[d]] = mix(np.array([total], dtype=np.uint64))[0]
    return out, first
