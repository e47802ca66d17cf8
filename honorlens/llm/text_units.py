"""Exact tokenizer ids for whole Arrow batches, encoding every distinct text unit once.

A text is cut into *units* before every ASCII white space that follows something
else, and between an ASCII letter and an ASCII digit or mark. Both vocabularies
split their input so that no pre-token crosses such a place, and neither looks
ahead across it (white space runs are kept whole), so the ids of a text are the
ids of its units in order. A cut is only made behind a character that is certainly
no white space. Units are recognised by a 64-bit hash of their bytes;
those not seen before go through the ``tokenizers`` library, the others come from
a bounded table in the Python worker.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread per task: Spark deals out the cores

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20241).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
# kinds of bytes: 0 ASCII white space, 1 ASCII letter, 2 other ASCII (sure to be no white space), 3 the rest
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[0x1C, 0x1D, 0x1E, 0x1F, *range(128, 256)]] = 3
_CUT = np.zeros(16, dtype=bool)  # by kind before * 4 + kind behind
_CUT[[1 * 4, 2 * 4, 3 * 4, 1 * 4 + 2]] = True
_UNSURE = np.zeros(256, dtype=bool)  # lead bytes of the characters that Unicode counts as white space
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = (int(n) // 65536 + 1) * 65536
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.empty(size, dtype=np.uint64)
            p[0], have, step = 1, 1, int(base)
            while have < size:
                p[have : 2 * have] = p[: min(have, size - have)] * _U(step)
                step, have = step * step % (1 << 64), 2 * have
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end) of ``data``."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.multiply(_BYTE[data], up[: len(data)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20, rows: int = 4096):
    """Consecutive ranges of at most ``rows`` rows and ``most`` bytes each (a longer row is a range of its own)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def unit_starts(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Sorted start positions of the units of all rows; the rows' own starts are among them.

    No cut is made inside an occurrence of one of the strings in ``whole`` (the added tokens)."""
    if not len(data):
        return np.empty(0, dtype=np.int64)
    kind = _KIND[data]
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = _CUT[kind[:-1] * 4 + kind[1:]]
    odd = np.flatnonzero((kind[:-1] == 3) & cut[1:]) + 1  # behind a byte that may end a white-space character
    if len(odd):
        bad = data[odd - 1] < 0x80
        bad |= (odd >= 2) & _UNSURE[data[np.maximum(odd - 2, 0)]]
        bad |= (odd >= 3) & _UNSURE[data[np.maximum(odd - 3, 0)]]
        cut[odd[bad]] = False
    if whole:
        raw = data.tobytes()
        for word in whole:
            at = raw.find(word)
            while at >= 0:
                cut[at + 1 : at + len(word)] = False
                at = raw.find(word, at + 1)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    """``encode`` gives what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives, for whole batches.

    ``max_units`` bounds the table; when it is full it starts afresh, results don't change.
    """

    def __init__(self, path: str, max_units: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.max_units = max_units
        self._clear()

    def _clear(self) -> None:
        self._slots = 1 << 17
        self._keys = np.zeros(self._slots, dtype=np.uint64)
        self._rows = np.full(self._slots, -1, dtype=np.int32)
        self._n, self._n_ids = 0, 0
        self._off = np.zeros(1 << 16, dtype=np.int64)
        self._ids = np.empty(1 << 18, dtype=np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is unknown."""
        out = np.full(len(keys), -1, dtype=np.int32)
        left = np.arange(len(keys))
        slot = (keys & _U(self._slots - 1)).astype(np.int64)
        while len(left):
            row, key = self._rows[slot], self._keys[slot]
            hit = (row >= 0) & (key == keys[left])
            out[left[hit]] = row[hit]
            go = (row >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & (self._slots - 1)
        return out

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        left = np.arange(len(keys))
        slot = (keys & _U(self._slots - 1)).astype(np.int64)
        while len(left):
            free = self._rows[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self._rows[at], self._keys[at] = rows[left[won]], keys[left[won]]
            stay = np.ones(len(left), dtype=bool)
            stay[won] = False
            left, slot = left[stay], (slot[stay] + 1) & (self._slots - 1)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(lengths.sum()))
        n, m = self._n + len(keys), self._n_ids + len(flat)
        if n + 1 > len(self._off):
            self._off = np.concatenate([self._off, np.zeros(max(len(self._off), n + 1), dtype=np.int64)])
        if m > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty(max(len(self._ids), m), dtype=np.uint32)])
        self._ids[self._n_ids : m] = flat
        self._off[self._n + 1 : n + 1] = self._n_ids + np.cumsum(lengths)
        rows = np.arange(self._n, n, dtype=np.int32)
        if 2 * n > self._slots:
            old = self._rows >= 0
            all_keys, all_rows = np.concatenate([self._keys[old], keys]), np.concatenate([self._rows[old], rows])
            while 2 * n > self._slots:
                self._slots *= 2
            self._keys, self._rows = np.zeros(self._slots, dtype=np.uint64), np.full(self._slots, -1, dtype=np.int32)
            self._place(all_keys, all_rows)
        else:
            self._place(keys, rows)
        self._n, self._n_ids = n, m

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all rows one after the other, and the n + 1 offsets of the rows in them."""
        starts = unit_starts(data, offsets, self.added)
        if not len(starts):
            return np.empty(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends)
        rows = self._find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if self._n + len(fresh) > self.max_units and self._n:
                self._clear()
                return self.encode(data, offsets)
            first = new[first]
            raw = data.tobytes()
            for lo in range(0, len(fresh), 50_000):
                some = first[lo : lo + 50_000]
                self._learn(fresh[lo : lo + 50_000], [raw[a:b].decode("utf-8") for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            rows[new] = self._find(keys[new])
        begin = self._off[rows]
        counts = self._off[rows + 1] - begin
        done = np.concatenate([[0], np.cumsum(counts)])
        ids = self._ids[np.repeat(begin - done[:-1], counts) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, offsets, "left")]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; it stays for later batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
