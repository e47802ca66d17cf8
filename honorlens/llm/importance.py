"""Importance resampling towards a target: hashed n-gram features, log-ratio gains, Gumbel draws.

A batch's n-grams are interned in an open-addressed table of NumPy arrays: a key is the
XXH64 of an n-gram's bytes, a hit counts only when the bytes agree, and two n-grams with
one key get two slots. A slot holds the n-gram's bucket (CRC-32 of its bytes, computed once
for each n-gram of the batch) and how often it occurs, and every occurrence keeps the
number of its slot. Bucket counts are then sums over slots, and a document's weight is a
gather of the gains by the slots of its occurrences.

The corpus is read twice: for the counts of all buckets (a sum of ``buckets`` numbers
comes from each task), and for the weights. The draw needs no sort of the corpus: scores
are whole numbers, their histogram says from which score on rows are drawn, and only those
rows are put in order, by ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import ordinal
from ..session import ship_package
from .common import staged

_U = np.uint64
# fixed values: the five primes of XXH64
P1, P2, P3, P4, P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Places of a new table; it grows when half of them are taken.
FIRST_SLOTS = 1 << 14


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to ``longest`` words, buckets, percent of the rows of ``least_words`` words or more to draw, seed."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _lanes(data: np.ndarray) -> np.ndarray:
    """By position: the eight bytes from there as a number (``data`` has eight more bytes than are asked for)."""
    return np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data, strides=(1,))


def xxhash64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each span of ``data``, which ends with eight spare bytes."""
    lanes = _lanes(data)
    out = sizes.astype(np.uint64) + P5
    left = np.flatnonzero(sizes < 32)
    at, rest = starts[left].copy(), sizes[left].copy()
    h = out[left]
    for _ in range(3):
        go = np.flatnonzero(rest >= 8)
        if not len(go):
            break
        h[go] = _turn(h[go] ^ (_turn(lanes[at[go]] * P2, 31) * P1), 27) * P1 + P4
        at[go] += 8
        rest[go] -= 8
    go = np.flatnonzero(rest >= 4)
    h[go] = _turn(h[go] ^ ((lanes[at[go]] & _U(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[go] += 4
    rest[go] -= 4
    for _ in range(3):
        go = np.flatnonzero(rest > 0)
        h[go] = _turn(h[go] ^ (data[at[go]].astype(np.uint64) * P5), 11) * P1
        at[go] += 1
        rest[go] -= 1
    h = (h ^ (h >> _U(33))) * P2
    h = (h ^ (h >> _U(29))) * P3
    out[left] = h ^ (h >> _U(32))
    long = np.flatnonzero(sizes >= 32)
    if len(long):
        from xxhash import xxh64_intdigest

        raw = memoryview(data)
        out[long] = np.fromiter((xxh64_intdigest(raw[a : a + n]) for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)), dtype=np.uint64, count=len(long))
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of ``sizes`` bytes at a and b hold the same bytes, eight at a time."""
    lanes, same = _lanes(data), np.ones(len(a), dtype=bool)
    go, done = np.flatnonzero(a != b), 0
    while len(go):
        bits = np.minimum(sizes[go] - done, 8).astype(np.uint64) * _U(8)
        differ = (lanes[a[go] + done] ^ lanes[b[go] + done]) << (_U(64) - bits)
        same[go[differ != 0]] = False
        done += 8
        go = go[(differ == 0) & (sizes[go] > done)]
    return same


class Interned:
    """The distinct n-grams of a block: ``slot`` of each occurrence, ``bucket`` and ``count`` of each slot."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, buckets: int):
        self.data, self.places = data, FIRST_SLOTS
        keys = xxhash64(data, starts, sizes)
        self.table = np.full(self.places, -1, dtype=np.int64)  # by place: a slot
        self.key, self.start, self.size = (np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int64))
        self.slot = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        place = (keys & _U(self.places - 1)).astype(np.int64)
        while len(left):
            found = self.table[place]
            empty = np.flatnonzero(found < 0)
            if len(empty):  # of several that want an empty place the first gets it, the others look again
                at, first = np.unique(place[empty], return_index=True)
                won = left[empty[first]]
                self.table[at] = np.arange(len(self.key), len(self.key) + len(at))
                self.key = np.concatenate([self.key, keys[won]])
                self.start = np.concatenate([self.start, starts[won]])
                self.size = np.concatenate([self.size, sizes[won]])
                if 2 * len(self.key) > self.places:
                    self._grow()
                    place = (keys[left] & _U(self.places - 1)).astype(np.int64)
                    continue
                found = self.table[place]
            hit = (self.key[found] == keys[left]) & (self.size[found] == sizes[left])
            some = np.flatnonzero(hit)
            hit[some] = _same(data, self.start[found[some]], starts[left[some]], sizes[left[some]])
            self.slot[left[hit]] = found[hit]
            left, place = left[~hit], (place[~hit] + 1) & (self.places - 1)
        self.count = np.bincount(self.slot, minlength=len(self.key))
        raw = memoryview(data)
        spans = zip(self.start.tolist(), self.size.tolist(), strict=True)
        self.bucket = np.fromiter((zlib.crc32(raw[a : a + n]) % buckets for a, n in spans), dtype=np.int64, count=len(self.key))

    def _grow(self) -> None:
        """Four times the places; the slots keep their numbers."""
        self.places *= 4
        self.table = np.full(self.places, -1, dtype=np.int64)
        left = np.arange(len(self.key))
        place = (self.key & _U(self.places - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.table[place] < 0)
            at, first = np.unique(place[free], return_index=True)
            self.table[at] = left[free[first]]
            stay = np.ones(len(left), dtype=bool)
            stay[free[first]] = False
            left, place = left[stay], (place[stay] + 1) & (self.places - 1)


def features(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of a block of texts: a buffer, start and size of each, offsets of the rows in them, words of each row.

    The buffer has the words of all rows, A-Z lower-cased, with one space behind each, so an n-gram is a span of it.
    """
    from .text_words import ALNUM, LOWER

    inside = ALNUM[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    border = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a word doesn't go on in the next row
    begin[border] |= inside[border]
    end[border - 1] |= inside[border - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    size = last - first + 1
    at = np.searchsorted(first, offsets)
    start = np.concatenate([[0], np.cumsum(size + 1)])
    buffer = np.full(int(start[-1]) + 8, 32, dtype=np.uint8)
    text = LOWER[data[inside]]
    buffer[np.arange(len(text)) + np.repeat(np.arange(len(size)), size)] = text
    words = np.diff(at)
    starts, sizes, rows = [start[:-1]], [size], [np.repeat(np.arange(len(words)), words)]
    for n in range(2, longest + 1):
        behind = np.arange(len(size) - n + 1)
        behind = behind[rows[0][behind] == rows[0][behind + n - 1]] if len(behind) else behind
        starts.append(start[behind])
        sizes.append(start[behind + n] - 1 - start[behind])
        rows.append(rows[0][behind])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable") if longest > 1 else slice(None)
    counts = np.bincount(row, minlength=len(words))
    return buffer, np.concatenate(starts)[order], np.concatenate(sizes)[order], np.concatenate([[0], np.cumsum(counts)]), words


def _interned(column: pa.Array, plan: Resampling) -> Iterator[tuple[int, int, Interned, np.ndarray, np.ndarray]]:
    from .text_units import blocks, utf8

    data, offsets = utf8(column)
    for lo, hi in blocks(offsets):
        buffer, starts, sizes, at, words = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], plan.longest)
        yield lo, hi, Interned(buffer, starts, sizes, plan.buckets), at, words


def bucket_counts(texts: DataFrame, plan: Resampling) -> np.ndarray:
    """How many features of all rows of ``texts`` fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.buckets, dtype=np.int64)
        for batch in batches:
            for _, _, grams, _, _ in _interned(batch.column(0), plan):
                np.add.at(total, grams.bucket, grams.count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(total[some])})

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(plan.buckets, dtype=np.int64)
    for r in found.collect():  # a row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: floor(1000 ln) of its smoothed share in the target by that in the corpus."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, plan: Resampling) -> DataFrame:
    """doc_id, n_features, n_words, weight of every row: the floored mean of the gains of its features (none: 0)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, grams, at, words in _interned(batch.column("text"), plan):
                sums = np.concatenate([[0], np.cumsum(sent.value[grams.bucket][grams.slot])])
                n = np.diff(at)
                mean = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), "n_features": pa.array(n), "n_words": pa.array(words), "weight": pa.array(mean)})

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel draw, floored, from sha256("seed:doc_id"); a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _least_score(scored: DataFrame, k: int) -> int | None:
    """The score of the k-th best row. A row a score comes here: a score is a whole number, a gain and noise of a few ten thousand."""
    left = k
    for r in scored.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.col("score").desc()).collect():
        left -= r["n"]
        if left <= 0:
            return r["score"]
    return None


def resampled(docs: DataFrame, target: DataFrame, plan: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank 1, 2, 3, ... of the drawn, else null.

    ``target`` is a frame with a text column. Words are runs of ASCII letters and digits and
    of any other characters outside of ASCII, A-Z lower-cased. Null and empty texts have no
    features and weight 0; texts of any length are read whole; an empty target or corpus
    counts nothing. Drawn are floor(percent * N / 100) of the N rows with ``least_words``
    words or more: the highest scores, of equal ones the smaller doc_id (null last; rows
    with one id and one score in any order). Rows with one id share their noise; repeated
    rows stay rows; other columns aren't read; no rows give no rows.
    """
    ship_package(docs.sparkSession)
    gain = gains(bucket_counts(docs, plan), bucket_counts(target, plan))
    scored = weights(docs, gain, plan).withColumn("score", F.col("weight") + noise(F.col("doc_id"), plan.seed))
    scored = staged(scored, "scored")
    eligible = F.col("n_words") >= plan.least_words
    k = plan.percent * scored.filter(eligible).count() // 100
    least = _least_score(scored.filter(eligible), k) if k else None
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = eligible & (F.col("score") >= least)
    ranked = ordinal(scored.filter(near).withColumn("_down", -F.col("score")), ["_down", "doc_id"], "rank")
    rank = F.when(F.col("rank") <= k, F.col("rank")).cast("long")
    rest = scored.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).unionByName(rest)
