"""Words and word shingles of whole Arrow columns as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .text_units import mix, span_hashes

_ODD = np.random.default_rng(20242).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: [^\x20\x09-\x0D]+, and A-Z lower-cased
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and all that isn't ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows (A-Z lower-cased), and the n + 1 offsets of the rows in them."""
    inside = np.concatenate([[False], kind[data], [False]])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    border = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a word doesn't go on in the next row
    begins[border] |= inside[1:-1][border]
    ends[border - 1] |= inside[1:-1][border - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hashes(LOWER[data], start, end), np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of all rows in order, and the n + 1 offsets of the rows in them.

    ``short``: a row of fewer words, but one at least, has one window, all its words.
    """
    size = np.diff(at)
    count = np.maximum(size - n + 1, 0)
    if len(hashes) >= n:
        width = len(hashes) - n + 1
        key = np.zeros(width, dtype=np.uint64)
        for i in range(n):
            key += hashes[i : i + width] * _ODD[i]
    else:
        key = np.empty(0, dtype=np.uint64)
    done = np.concatenate([[0], np.cumsum(count)])
    own = key[np.repeat(at[:-1] - done[:-1], count) + np.arange(done[-1])] if done[-1] else np.empty(0, dtype=np.uint64)
    if short and (few := np.flatnonzero((size > 0) & (size < n))).size:
        added = [int((hashes[at[i] : at[i + 1]] * _ODD[: size[i]]).sum(dtype=np.uint64)) ^ int(size[i]) for i in few]
        own = np.insert(own, done[few], np.array(added, dtype=np.uint64))
        count[few] = 1
        done = np.concatenate([[0], np.cumsum(count)])
    return mix(own), done
