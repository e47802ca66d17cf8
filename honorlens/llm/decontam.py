"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Seeds are word pairs: two words of a test item that follow each other, or with one word
between them, looked up in the text in both forms too. Of M matched words and E errors
(0.5 each) a copy of an item of m words has M - E/2 >= m/2, so at most M - m/2 of its M - 1
steps from match to match hold two errors or more: at least ceil(m/2) - 1 of them are seeds
with places of their own, whatever the edits. Half of as many places may therefore be left
out; a pass over the corpus counts documents, and the most frequent ones go.
The other half is demanded as support within the 2 m words that a copy can take up. Which
places are left out changes the work, never the result. Where there is support, the passage
that any such copy lies in is aligned with the item's words (local alignment, all passages
of a block at once). Documents aren't shuffled: both passes are maps, and what is gathered
are counts by seed. Items go out to the tasks in blocks of at most ``BLOCK_BYTES``; a larger
benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .text_words import _ODD

#: Seed hits looked at together; blocks and texts of more are taken in halves.
MOST_HITS = 1 << 22
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Alignment score against that of a perfect copy, from which a passage counts as a copy.
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
#: Passages aligned at once, and their cells in a step.
LANES, CELLS = 512, 1 << 18
HITS = "array<struct<item_id:long,score:double,first_word:int,n_words:int>>"


@dataclass(frozen=True)
class Items:
    """Test items of a block: ids, words one after the other, and seeds sorted by hash."""

    ids: list[int | None]
    words: np.ndarray
    at: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    support: np.ndarray  # by item, seeds that a copy has at least

    def only(self, keep: np.ndarray, support: np.ndarray) -> Items:
        return Items(self.ids, self.words, self.at, self.seed[keep], self.item[keep], self.place[keep], support)


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from .text_units import utf8
    from .text_words import ALNUM, words

    data, offsets = utf8(pc.utf8_lower(text.cast(pa.large_string()).fill_null("")))
    return words(data, offsets, ALNUM)


def _seeds(hashes: np.ndarray, at: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words next to each other or with one between them, and of the words ``alone``; where their first words are."""
    from .text_units import mix

    end = np.repeat(at[1:], np.diff(at))
    key, begin = [mix(hashes[alone] * _ODD[2])], [alone]
    for step in (1, 2):
        first = np.flatnonzero(np.arange(len(hashes)) + step < end)
        key.append(mix(hashes[first] * _ODD[0] + hashes[first + step] * _ODD[1]))
        begin.append(first)
    return np.concatenate(key), np.concatenate(begin)


def _maybe(known: np.ndarray) -> np.ndarray:
    """By the top bits of a hash: whether one of the sorted hashes ``known`` has them."""
    bits = min(24, max(16, int(len(known) * 16).bit_length()))
    out = np.zeros(1 << bits, dtype=bool)
    out[known >> np.uint64(64 - bits)] = True
    return out


def _passing(maybe: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(maybe[keys >> np.uint64(65 - len(maybe).bit_length())])


def _spans(text: pa.Array) -> Iterator[tuple[int, int]]:
    from .text_units import blocks, utf8

    return blocks(utf8(text)[1])


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The items, a block at a time; those without a word (or text) can't leak and are left out."""

    def ready(rows: list[tuple[int, str]]) -> Items:
        hashes, at = _words(pa.array([t for _, t in rows], pa.large_string()))
        size = np.diff(at)
        seed, begin = _seeds(hashes, at, at[:-1][size == 1])
        item = np.searchsorted(at, begin, "right") - 1
        place = begin - at[item]
        order = np.lexsort((place, item, seed))
        sure = np.maximum(1, np.ceil(THRESHOLD * size).astype(np.int64) - 1)
        return Items([i for i, _ in rows], hashes, at, seed[order], item[order], place[order], sure)

    rows, size = [], 0
    for r in benchmark.select(item_id, text).filter(F.col(text).isNotNull()).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= BLOCK_BYTES:
            yield ready(rows)
            rows, size = [], 0
    if rows:
        yield ready(rows)


def frequencies(docs: DataFrame, known: np.ndarray, text: str = "text") -> np.ndarray:
    """In how many documents each of the sorted seeds ``known`` occurs."""
    sent = docs.sparkSession.sparkContext.broadcast((known, _maybe(known)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, maybe = sent.value
        for batch in batches:
            for lo, hi in _spans(batch.column(0)):
                hashes, at = _words(batch.column(0).slice(lo, hi - lo))
                found, begin = _seeds(hashes, at, at[:0])  # items of one word have no seed to spare
                some = _passing(maybe, found)
                found, begin = found[some], begin[some]
                i = np.minimum(np.searchsorted(seeds, found), len(seeds) - 1)
                hit = np.flatnonzero(seeds[i] == found)
                row = np.searchsorted(at, begin[hit], "right") - 1
                pairs = np.unique(row * len(seeds) + i[hit])  # a document counts once
                seed, n = np.unique(pairs % len(seeds), return_counts=True)
                yield pa.RecordBatch.from_pydict({"seed": pa.array(seed.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = np.zeros(len(known), dtype=np.int64)
    if not len(known):
        return counts
    texts = docs.select(text).filter(F.col(text).isNotNull())
    for r in texts.mapInArrow(counted, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():
        counts[r["seed"]] = r["n"]  # a row for each seed of the block at most
    return counts


def rare_seeds(docs: DataFrame, items: Items, text: str = "text") -> Items:
    """``items`` without the seeds of their most frequent places, as many as every copy can do without."""
    known, at = np.unique(items.seed, return_inverse=True)
    counts, in_items = frequencies(docs, known, text), np.bincount(at, minlength=len(known))
    start = items.at[items.item] + items.place  # a place has one seed or two
    n_docs = np.bincount(start, weights=counts[at], minlength=len(items.words))
    n_items = np.bincount(start, weights=in_items[at], minlength=len(items.words))
    of = np.repeat(np.arange(len(items.ids)), np.diff(items.at))
    order = np.lexsort((-n_items, -n_docs, of))  # most frequent first
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order)) - items.at[of]
    spare = items.support // 2
    return items.only(rank[start] >= spare[items.item], items.support - spare)


def align(item: np.ndarray, item_size: np.ndarray, text: np.ndarray, text_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of each lane, and where it ends in item and text (exclusive).

    ``item`` and ``text`` are word hashes, a lane a row, filled up to the longest.
    """
    lanes, width = text.shape
    step = GAP * np.arange(width + 1)
    valid = np.arange(width) < text_size[:, None]
    above = np.zeros((lanes, width + 1))
    best, item_end, text_end = np.zeros(lanes), np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    for i in range(item.shape[1]):
        now = np.zeros((lanes, width + 1))
        pair = np.where((text == item[:, i : i + 1]) & valid, MATCH, MISMATCH)
        now[:, 1:] = np.maximum(np.maximum(above[:, :-1] + pair, above[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now - step, axis=1) + step  # gaps along the text
        now[i >= item_size] = 0
        at = now.argmax(axis=1)
        top = now[np.arange(lanes), at]
        more = top > best
        best[more], item_end[more], text_end[more] = top[more], i + 1, at[more]
        above = now
    return best, item_end, text_end


def _copies(items: Items, maybe: np.ndarray, text: pa.Array) -> list[list[tuple[int | None, float, int, int]]]:
    """By row: (item id, score, first word, words) of the best copy of each item found in it."""
    found = _best(items, maybe, *_words(text))
    return [sorted(x.values(), key=lambda v: (v[0] is None, v[0] or 0, *v[1:])) for x in found]


def _keep(mine: dict, key: tuple, value: tuple) -> None:
    """The higher score stays, of equal ones the passage that begins first."""
    if key not in mine or (value[1], -value[2]) > (mine[key][1], -mine[key][2]):
        mine[key] = value


def _halves(items: Items, maybe: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> list[dict[tuple, tuple]] | None:
    """``_best`` of the rows in two parts, of a single row in two parts of its words; None where it is too short.

    A copy at the threshold takes up twice its item's words at most: of M matched words and
    E errors M - E/2 >= m/2, so M + E <= 3 M - m <= 2 m. The parts of one text overlap by as
    much, so that each copy lies in one of them whole.
    """
    if len(at) > 2:
        half = len(at) // 2
        return (_best(items, maybe, hashes[: at[half]], at[: half + 1])
                + _best(items, maybe, hashes[at[half] :], at[half:] - at[half]))
    reach, middle = int(np.diff(items.at).max()), len(hashes) // 2
    if middle <= 4 * reach:
        return None
    out: dict[tuple, tuple] = {}
    for lo, hi in ((0, middle + reach), (middle - reach, len(hashes))):
        for key, (item, score, first, n) in _best(items, maybe, hashes[lo:hi], np.array([0, hi - lo]))[0].items():
            _keep(out, key, (item, score, first + lo, n))
    return [out]


def _best(items: Items, maybe: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> list[dict[tuple, tuple]]:
    """By row, the best copy of each item; the rows' words follow each other, row i from ``at[i]``."""
    out: list[dict[tuple, tuple]] = [{} for _ in range(len(at) - 1)]
    found, place = _seeds(hashes, at, np.arange(len(hashes) if (np.diff(items.at) == 1).any() else 0))
    some = _passing(maybe, found)
    found, place = found[some], place[some]
    lo, hi = np.searchsorted(items.seed, found, "left"), np.searchsorted(items.seed, found, "right")
    n = hi - lo
    if not n.sum():
        return out
    if n.sum() > MOST_HITS and (parts := _halves(items, maybe, hashes, at)) is not None:
        return parts
    which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(place, n)
    row = np.searchsorted(at, place, "right") - 1
    item = items.item[which]
    place = place - at[row]
    begin = place - items.place[which]  # where the item would begin in the text
    order = np.lexsort((place, item, row))
    row, item, place, begin = row[order], item[order], place[order], begin[order]
    last = np.arange(len(row)) + items.support[item] - 1  # from each hit on, as many as a copy has
    size = np.diff(items.at)[item]
    near = np.flatnonzero(last < len(row))
    last = last[near]
    near = near[(row[last] == row[near]) & (item[last] == item[near]) & (place[last] - place[near] < 2 * size[near])]
    if not len(near):
        return out
    row, item, begin, size = row[near], item[near], begin[near], size[near]
    order = np.lexsort((begin, item, row))
    row, item, begin, size = row[order], item[order], begin[order], size[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    row, item, size = row[first], item[first], size[first]
    length = np.diff(at)[row]
    # a copy that has a hit strays from its diagonal by its gaps, which are no more than the item's words
    lo, hi = np.clip(begin[first] - size, 0, length), np.clip(begin[last] + 2 * size, 0, length)
    order = np.lexsort((hi - lo, size))
    i = 0
    while i < len(order):
        longest = int(size[order[i : i + LANES]].max()), int((hi - lo)[order[i : i + LANES]].max())
        some = order[i : i + max(1, min(LANES, CELLS // max(1, longest[1])))]
        i += len(some)
        m, w = size[some], (hi - lo)[some]

        def lanes(source, start, count):
            at_ = start[:, None] + np.minimum(np.arange(int(count.max())), count[:, None] - 1)
            return source[at_]

        a, b = lanes(items.words, items.at[item[some]], m), lanes(hashes, at[row[some]] + lo[some], w)
        score, item_end, text_end = align(a, m, b, w)
        good = np.flatnonzero(score >= THRESHOLD * MATCH * m)
        if not len(good):
            continue
        # the same from the end backwards finds the beginning
        back_a = lanes(items.words[::-1], len(items.words) - items.at[item[some[good]]] - item_end[good], item_end[good])
        back_b = lanes(hashes[::-1], len(hashes) - at[row[some[good]]] - lo[some[good]] - text_end[good], text_end[good])
        _, _, taken = align(back_a, item_end[good], back_b, text_end[good])
        for k, g in enumerate(good.tolist()):
            lane = some[g]
            value = (items.ids[item[lane]], float(score[g] / (MATCH * m[g])), int(lo[lane] + text_end[g] - taken[k]), int(taken[k]))
            # without an id, each row of the benchmark is an item
            _keep(out[row[lane]], (value[0], int(item[lane]) if value[0] is None else 0), value)
    return out


def _finder(sent):
    names = ("item_id", "score", "first_word", "n_words")

    @F.pandas_udf(HITS)
    def found(column: pd.Series) -> pd.Series:
        values = pa.array(column, pa.large_string())
        rows = [x for lo, hi in _spans(values) for x in _copies(*sent.value, values.slice(lo, hi - lo))]
        return pd.Series([[dict(zip(names, x, strict=True)) for x in row] for row in rows], index=column.index, dtype=object)

    return found


def with_copies(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``copies``: the test items that each text holds (empty array: none).

    Each has the item's id, the score (1: every word of the item in order), and the first
    word and number of words of the passage in the text. Words are runs of letters and
    digits, lower-cased. An item is reported at ``THRESHOLD`` or more, once a document, with
    its best passage (of those with equal scores the first). Texts of any length are searched
    whole; those with very many seed hits in overlapping parts. Of an item of two words both must be there, next to each other or one
    word apart. Items without an id are looked for too, their copies have a null item_id.
    Null and empty texts, and items without words, have no copies; an empty benchmark leaves
    all arrays empty. A column named copies is replaced; rows and
    other columns stay, repeated rows get equal arrays.
    """
    ship_package(docs.sparkSession)
    out = docs.withColumn("copies", F.array().cast(HITS))
    for items in item_blocks(benchmark, item_id, item_text):
        rare = rare_seeds(docs, items, text)
        sent = docs.sparkSession.sparkContext.broadcast((rare, _maybe(rare.seed)))
        out = out.withColumn("copies", F.concat("copies", _finder(sent)(F.col(text))))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item of which it holds a copy: doc_id, item_id, score, first_word, n_words."""
    ship_package(docs.sparkSession)
    return with_copies(docs.select("doc_id", "text"), benchmark).select("doc_id", F.inline("copies"))
