"""Near duplicates by word shingles: a Jaccard self-join on PartEnum signatures.

Sets of a size band whose Jaccard similarity reaches the bound differ in few elements, at
most D. The feature domain is dealt into groups (by a hash of the shingle), each of three
parts; a set's signatures are the hashes of its elements in any two parts of a group. Two
sets with one difference or none inside a group share a signature of it: the difference
lies in one part, and the subset without it agrees. Groups are as small as makes that
likely, and a band has as many, over as many independent partitions of the domain, as
bring the chance that all of them miss a pair with D differences below ``MISS`` (1e-13
a pair, less than that of the 64-bit hashes). Sets whose partners may lie in the next
band have signatures there as well, and groups in which a set has nothing give none.

Dropping shingles from the domain loses no pair, as long as both sets drop the same ones
and have enough left: they differ in no more elements than before. So a set is signed
without the shingles that many others have (passages that repeat across documents), if
these are at most ``MOSTLY`` of it. For a set of which more are dropped, the domain is
dealt into parts of one element each, rare ones first, the more frequent the later: D
differences spare one of any D + 1 parts, so sets that are linked have an element in
common among the first of either, as far as their two sizes say. Such a signature has its
place in that order, and two sets that share one are a pair only where both places are
within what their sizes allow. A linked partner of such a set drops at least ``PARTLY``
of its own (0.5625), so sets from there on give these signatures too; two sets that drop
at most ``MOSTLY`` need no pair by them. So texts around one passage that aren't linked
don't meet: what makes them differ comes first. Which shingles are frequent is counted in every
document: first by place of a fixed table, then by shingle in the places that many fall on.
It steers only how many sets meet without being linked, never which links are found.

Sets that share a signature are compared by size, by a parity sketch (a bit that differs
proves an element that does, so it loses no link), and then on their whole texts. In a
group of sets with one signature only some are compared with all others in a round, at
first the one with the fewest rare shingles, which is nearest to what the others were made
from; members that are found connected need no comparison, and a group is
done when all of them are connected or every pair that isn't was compared. Equal sets
are one node from the start. Links are contracted to components by label propagation
with pointer jumping. Nothing but counts and bounded filters comes to the driver, and
files of the shared folder go as soon as later ones take their place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import staged, unstaged

WORDS, SIMILARITY = 5, Fraction(3, 4)
MISS, LAMBDA, GROWTH = 1e-13, 1.43, 1.5
SKETCH_BITS = 1024
#: Bytes of text whose sets are made at a time; some forty times as many are held meanwhile.
BLOCK_BYTES = 1 << 19
#: Members of a signature's group that are compared with all others, by round; the last number stays.
PIVOTS = (1, 16, 256)
FILTER_BITS = 1 << 26
#: Frequent shingles: occurrences that make a shingle frequent, places of the table, places that are counted together.
FREQUENT, LEVEL_PLACES, PIECE = 48, 1 << 24, 1 << 12
#: Rows of nodes or links, and of pairs or texts, that are worth a task of their own.
SMALL_ROWS, LARGE_ROWS = 1 << 17, 1 << 12
MOSTLY, PARTLY = 0.75, 0.56
#: Shares of a set that are left, by which the number of groups is planned.
LEFT = (0.9, 0.7, 0.5, 0.35, 0.25)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands(most: int) -> np.ndarray:
    """Upper ends of the size bands up to one that holds ``most``."""
    ends = [1, 2, 3]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, math.floor(ends[-1] * GROWTH)))
    return np.array(ends, dtype=np.int64)


def differences(both: int, similarity: Fraction) -> int:
    """The most elements in which two sets differ whose sizes add up to ``both``."""
    return math.floor((1 - similarity) / (1 + similarity) * both)


@lru_cache(maxsize=None)
def plan(low: int, high: int, similarity: Fraction, left: float) -> tuple[int, int]:
    """Groups of one partition, and groups in all, for sets of low to high elements of which a share is ``left``."""
    most = differences(2 * high, similarity)
    groups = max(1, -(-(most + 1) // 2), round(most / LAMBDA))
    q, worst = 1 / groups, 1.0
    for size in {low, (low + high) // 2, high}:
        d = differences(2 * size, similarity)
        # |A ∩ B| without the dropped ones, seen from one set, or from both (either leaves 1 - MOSTLY at least)
        common = max(left * size - d, (left + 1 - MOSTLY) / 2 * size - d / 2, 0.5)
        none, one = (1 - q) ** d, d * q * (1 - q) ** (d - 1) if d else 0.0
        worst = min(worst, none * (1 - (1 - q) ** common) + one * (1 - (1 - 2 * q / 3) ** common))
    return groups, 1 if worst >= 1 - 1e-12 else math.ceil(math.log(MISS) / math.log(1 - worst))


class Sets:
    """Distinct shingle hashes of a block of texts, row after row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int = WORDS):
        from .text_units import mix
        from .text_words import shingles, words

        found, at = shingles(*words(data, offsets), n, short=True)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        self.items, self.row = found[new], row[new]
        self.size = np.bincount(self.row, minlength=len(offsets) - 1)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.items + _MIX))])
        self.node = mix((sums[self.at[1:]] - sums[self.at[:-1]]) + self.size.astype(np.uint64) * _MIX).view(np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.items[self.at[i] : self.at[i + 1]]

    def sketches(self) -> np.ndarray:
        """SKETCH_BITS parities of each row, packed into bytes."""
        where = self.row * SKETCH_BITS + (self.items >> np.uint64(20)).astype(np.int64) % SKETCH_BITS
        odd = np.bincount(where, minlength=len(self.size) * SKETCH_BITS) & 1
        return np.packbits(odd.astype(np.uint8).reshape(len(self.size), SKETCH_BITS), axis=1)

    def signatures(self, similarity: Fraction, which: np.ndarray, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures, the row and the code of each, for the rows in ``which``. ``levels``: see frequency_levels.

        Code 0: of groups of shingles. Else of one shingle, the code // 2 th of its set; odd
        if the set drops too much for groups."""
        level = np.zeros(len(self.items), dtype=np.uint8)
        if levels is not None:
            level = levels[(self.items % np.uint64(len(levels))).astype(np.int64)]
        rare = np.bincount(self.row[level == 0], minlength=len(self.size))
        dropped = 1 - rare / np.maximum(self.size, 1)
        out, owner, codes = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        some = which[(rare[which] > 0) & (dropped[which] <= MOSTLY)]
        if len(some):
            found, of = self._signed(similarity, some, self.items[level == 0], rare, dropped)
            out.append(found)
            owner.append(of)
            codes.append(np.zeros(len(of), dtype=np.int64))
        asked = np.zeros(len(self.size), dtype=bool)
        asked[which] = True
        asked &= (dropped >= PARTLY) & (self.size > 0)
        if asked.any():
            found, of, place = self._single(similarity, asked, level)
            out.append(found)
            owner.append(of)
            codes.append(2 * place + np.where(dropped[of] > MOSTLY, 3, 2))
        return np.concatenate(out), np.concatenate(owner), np.concatenate(codes)

    def rare(self, levels: np.ndarray) -> np.ndarray:
        """Thousandths of each set that aren't dropped."""
        level = levels[(self.items % np.uint64(len(levels))).astype(np.int64)]
        return 1000 * np.bincount(self.row[level == 0], minlength=len(self.size)) // np.maximum(self.size, 1)

    def _single(self, similarity: Fraction, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first elements of each set, rare ones first: signature, row, place. As many as a partner of any size asks for."""
        from .text_units import mix

        use = np.flatnonzero(asked[self.row])
        key = mix(self.items[use] ^ np.uint64(0xA0761D6478BD642F))
        order = use[np.lexsort((key, level[use], self.row[use]))]
        row = self.row[order]
        size = np.where(asked, self.size, 0)
        place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        needed = self.size - -(-similarity.numerator * self.size // similarity.denominator)
        first = place <= needed[row]
        return mix(self.items[order[first]] + np.uint64(0xE7037ED1A0B428DB)), row[first], place[first]

    def _signed(self, similarity: Fraction, which: np.ndarray, items: np.ndarray, sizes: np.ndarray, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from .text_units import mix

        begin = np.concatenate([[0], np.cumsum(sizes)])
        ends = bands(math.floor(int(self.size.max()) / similarity) + 1)
        band = np.searchsorted(ends, self.size[which])
        reach = np.floor(self.size[which] * similarity.denominator / similarity.numerator).astype(np.int64)
        rows, at = [which], [band]
        step = 1  # bands above that a partner can lie in
        while (more := (band + step < len(ends)) & (reach > ends[np.minimum(band + step - 1, len(ends) - 1)])).any():
            rows.append(which[more])
            at.append(band[more] + step)
            step += 1
        row, band = np.concatenate(rows), np.concatenate(at)
        plans = np.array([[plan(int(ends[b - 1]) + 1 if b else 1, int(ends[b]), similarity, x) for x in LEFT] for b in range(len(ends))])
        kind = np.searchsorted(1 - np.array(LEFT), dropped[row] - 1e-9)
        groups, trials = plans[band, kind, 0], plans[band, kind, 1]
        out, owner = [], []
        for part in range(int((-(-trials // groups)).max())):
            some = np.flatnonzero(part * groups < trials)
            n = sizes[row[some]]
            own = np.repeat(np.arange(len(some)), n)
            item = items[np.repeat(begin[row[some]] - (np.cumsum(n) - n), n) + np.arange(len(own))]
            h = mix(item + np.uint64((2 * part + 1) * int(_MIX) % (1 << 64)))
            group = ((h & np.uint64(0xFFFFFFFF)) % groups[some][own].astype(np.uint64)).astype(np.int64)
            used = group + part * groups[some][own] < trials[some][own]
            own, group, h, item = own[used], group[used], h[used], item[used]
            width = np.minimum(groups[some], trials[some] - part * groups[some])
            base = np.concatenate([[0], np.cumsum(width)])
            cells = int(base[-1])
            cell = (base[own] + group) * 3 + ((h >> np.uint64(40)) % np.uint64(3)).astype(np.int64)
            value = mix(item ^ np.uint64(0x5851F42D4C957F2D))
            low = np.bincount(cell, weights=(value & np.uint64(0xFFFFFFFF)).astype(float), minlength=3 * cells)
            high = np.bincount(cell, weights=(value >> np.uint64(32)).astype(float), minlength=3 * cells)
            total = (low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))).reshape(cells, 3)
            count = np.bincount(cell, minlength=3 * cells).reshape(cells, 3)
            owner_of = np.repeat(np.arange(len(some)), width)
            trial = np.arange(cells) - base[owner_of] + part * groups[some][owner_of]
            label = (trial + (band[some][owner_of] << 32)).astype(np.uint64) * np.uint64(3)
            for k in range(3):
                full = count.sum(axis=1) - count[:, k] > 0
                content = total.sum(axis=1, dtype=np.uint64) - total[:, k]
                out.append(mix(mix(content) + (label + np.uint64(k)) * _MIX)[full])
                owner.append(row[some][owner_of[full]])
        return np.concatenate(out), np.concatenate(owner)


def _blocks(column: pa.Array, n: int) -> Iterator[tuple[int, int, Sets]]:
    from .text_units import blocks, utf8

    data, offsets = utf8(column)
    for lo, hi in blocks(offsets, BLOCK_BYTES):
        yield lo, hi, Sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)


def _mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def nodes(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, node (a hash of the set; null without words) and sketch of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets in _blocks(batch.column("text"), n):
                empty = sets.size == 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()),
                        "mark": batch.column("mark").slice(lo, hi - lo),
                        "n_shingles": pa.array(sets.size.astype(np.int64)),
                        "node": pa.array(sets.node, mask=empty),
                        "sketch": pa.array([x.tobytes() for x in sets.sketches()], pa.binary(), mask=empty),
                    }
                )

    return docs.select("doc_id", "text", _mark().alias("mark")).mapInArrow(read, "doc_id long, mark long, n_shingles long, node long, sketch binary")


def _once(sets: Sets) -> np.ndarray:
    """The items of all sets, those of equal sets once."""
    _, first = np.unique(sets.node, return_index=True)
    return sets.items[np.isin(sets.row, first)]


def place_counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(piece, held) of the PIECE places from piece * PIECE on: compressed 32-bit counts of the shingles that fall on each.

    A byte a place is held meanwhile, and the rest for those few with more.
    """
    load, whole = np.zeros(LEVEL_PLACES, dtype=np.uint8), {}  # whole: 256 occurrences at a place each
    for batch in batches:
        for _, _, sets in _blocks(batch.column("text"), n):
            place, more = np.unique((_once(sets) % np.uint64(LEVEL_PLACES)).astype(np.int32), return_counts=True)
            more += load[place]
            load[place] = more.astype(np.uint8)  # modulo 256
            for i in np.flatnonzero(more >= 256).tolist():
                whole[int(place[i])] = whole.get(int(place[i]), 0) + int(more[i]) // 256
    pieces = load.reshape(-1, PIECE)
    over = np.array(sorted(whole), dtype=np.int64)
    full = np.array([whole[i] for i in over.tolist()], dtype=np.uint32)
    used = np.union1d(np.flatnonzero(pieces.any(axis=1)), over // PIECE)
    for some in np.array_split(used, -(-len(used) // 256) or 1):
        counts = pieces[some].astype(np.uint32)
        mine = np.isin(over // PIECE, some)
        counts[np.searchsorted(some, over[mine] // PIECE), over[mine] % PIECE] += 256 * full[mine]
        held = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in counts]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(some.astype(np.int32)), "held": pa.array(held, pa.binary())})


def crowded(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Places (a shingle's hash modulo LEVEL_PLACES) with the occurrences that make a shingle frequent, and how many these are.

    All shingles of all documents count. These are FREQUENT, or twice, four times, ... as many where more than
    an eighth of the places would have them.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, held in zip(batch.column("piece").to_pylist(), batch.column("held")):
                now = np.frombuffer(pa.decompress(held.as_buffer(), 4 * PIECE, "zstd"), dtype=np.uint32)
                load[piece] = load.get(piece, 0) + now.astype(np.int64)
        for piece, x in load.items():
            at = np.flatnonzero(x >= FREQUENT)
            yield pa.RecordBatch.from_pydict({"place": pa.array((piece * PIECE + at).astype(np.int32)), "n": pa.array(x[at])})

    counts = docs.select("text").mapInArrow(lambda batches: place_counts(batches, n), "piece int, held binary")
    loads = staged(counts.repartition(64, "piece").mapInArrow(add, "place int, n long"), "loads")
    doubled = [FREQUENT << i for i in range(40)]
    many = loads.agg(*[F.count_if(F.col("n") >= x) for x in doubled]).first()
    least = next(x for x, c in zip(doubled, many) if c <= LEVEL_PLACES // 8)
    places = loads.filter(F.col("n") >= least).select("place").toPandas()["place"].to_numpy(np.int64)
    unstaged(loads)
    return places, least


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """By place (a shingle's hash modulo its length): 0, or 1, 2, ... for ten times more frequent shingles each.

    Every document is counted. The table has a fixed size; where there are more frequent
    shingles than an eighth of its places, only the more frequent ones count.
    """
    out = np.zeros(LEVEL_PLACES, dtype=np.uint8)
    hot, least = crowded(docs, n)
    if not len(hot):
        return out
    bits = np.zeros(LEVEL_PLACES, dtype=bool)
    bits[hot] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in _blocks(batch.column("text"), n):
                items = _once(sets)
                item, count = np.unique(items[_held(sent.value, (items % np.uint64(LEVEL_PLACES)).astype(np.int64))], return_counts=True)
                yield pa.RecordBatch.from_pydict({"item": pa.array(item.view(np.int64)), "n": pa.array(count.astype(np.int64))})

    counts = docs.select("text").mapInArrow(read, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    level = (F.floor(F.log10(F.col("n") / F.lit(least)) + 1e-9) + 1).cast("int")
    found = counts.select(F.expr(f"pmod(item, {LEVEL_PLACES})").alias("place"), level.alias("level")).toPandas()  # about a row a crowded place at most
    np.maximum.at(out, found["place"].to_numpy(np.int64), found["level"].to_numpy(np.uint8))
    return out


def signatures(docs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """(signature, node, single) of every set; equal sets of a block give theirs once.

    ``single`` is null for signatures of groups of shingles, so that most rows are two numbers;
    else the code (see Sets.signatures) times 1024 and the thousandths of the set that aren't dropped.
    """
    levels = frequency_levels(docs, n)
    place = np.flatnonzero(levels)
    sent = docs.sparkSession.sparkContext.broadcast((place.astype(np.int32), levels[place]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(LEVEL_PLACES, dtype=np.uint8)
        known[sent.value[0]] = sent.value[1]
        for batch in batches:
            for _, _, sets in _blocks(batch.column("text"), n):
                _, first = np.unique(sets.node, return_index=True)
                found, row, code = sets.signatures(similarity, first, known)
                single = pa.array(code * 1024 + sets.rare(known)[row], pa.int64(), mask=code == 0)
                yield pa.RecordBatch.from_pydict({"signature": pa.array(found.view(np.int64)), "node": pa.array(sets.node[row]), "single": single})

    return docs.select("text").mapInArrow(read, "signature long, node long, single long")


def shared_signatures(docs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """(signature, node, code, rare): those rows of ``signatures`` by which a pair can come about, each once; rare is 0 with code 0."""
    group = Window.partitionBy("signature")
    free = F.col("single").isNull() | (F.shiftright("single", 10) % 2 == 1)
    found = signatures(docs, n, similarity).withColumns({"_low": F.min("node").over(group), "_high": F.max("node").over(group), "_free": F.max(free).over(group)})
    once = found.filter("_low < _high AND _free").dropDuplicates(["signature", "node"])
    code, rare = F.shiftright("single", 10), F.col("single").bitwiseAND(F.lit(1023))
    return once.select("signature", "node", F.coalesce(code, F.lit(0)).cast("int").alias("code"), F.coalesce(rare, F.lit(0)).cast("int").alias("rare"))


def pairs_of(pivots: DataFrame, members: DataFrame, similarity: Fraction) -> DataFrame:
    """Distinct (a, b), a < b: a pivot and a later member of a group of its signature, in another component, that may be linked.

    Of both: signature, node, label, code, size and place in the group (_rank). One of two
    must be free to pair, and the places of one-element signatures within what the two sizes allow."""
    num, den = similarity.numerator, similarity.denominator
    one = pivots.select("signature", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "code", "size", "_rank")])
    free = "(code % 2 = 1 OR code_a % 2 = 1 OR code = 0)"
    within = " AND ".join(f"{num + den} * (size{x} - IF(code{x} = 0, 0, (code{x} - 2) DIV 2)) >= {num} * (size + size_a)" for x in ("", "_a"))
    both = one.join(members, "signature").filter(f"_rank_a < _rank AND label_a <> label AND {free} AND {within}")
    return both.select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()


def _node_filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of bounded size over the nodes of ``wanted`` (node, distinct), packed."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    at = F.pmod(F.col("node"), F.lit(bits))
    words = wanted.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    out = np.zeros(bits // 64, dtype=np.int64)
    found = words.toPandas()  # a 64th of the bits at most
    out[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64)
    return out.view(np.uint8)


def _held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at ``at`` are set, in a bitmap packed from the lowest bit on."""
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def texts_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, text): one text of each wanted node, and of few others."""
    sent = docs.sparkSession.sparkContext.broadcast(_node_filter(wanted))  # FILTER_BITS at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, sets in _blocks(batch.column("text"), n):
                node, first = np.unique(sets.node, return_index=True)
                use = _held(sent.value, node % (8 * len(sent.value))) & (sets.size[first] > 0)
                if use.any():
                    yield pa.RecordBatch.from_pydict({"node": pa.array(node[use]), "text": batch.column("text").take(pa.array(lo + first[use]))})

    return docs.select("text").mapInArrow(read, "node long, text string").dropDuplicates(["node"])


def _may_link(similarity: Fraction):
    num, den = similarity.numerator, similarity.denominator

    @F.pandas_udf("boolean")
    def close(size_a: pd.Series, size_b: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), dtype=np.uint64).reshape(len(a), -1) ^ np.frombuffer(b"".join(b), dtype=np.uint64).reshape(len(b), -1)
        differ, both = np.bitwise_count(x).sum(axis=1), (size_a + size_b).to_numpy()
        least, most = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
        return pd.Series((differ * (den + num) <= (den - num) * both) & (den * least >= num * most).to_numpy())

    return close


def verified(pairs: DataFrame, texts: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, from their whole texts."""
    num, den = similarity.numerator, similarity.denominator

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            good = np.zeros(len(a), dtype=bool)
            last, left = None, None
            for lo, hi, sets in _blocks(batch.column("text_b"), n):
                for i in range(lo, hi):
                    if a[i] != last:  # neighbours mostly have the same a
                        _, _, own = next(_blocks(batch.column("text_a").slice(i, 1), n))
                        last, left = a[i], own.of(0)
                    right = sets.of(i - lo)
                    common = len(np.intersect1d(left, right, assume_unique=True))
                    good[i] = den * common >= num * (len(left) + len(right) - common)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[good]), "b": pa.array(b[good])})

    with_b = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    both = with_b.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _tasks(rows: int, each: int) -> int:
    """Tasks that write ``rows``: few for few rows, whatever the number of shuffle partitions."""
    return 8 + rows // each


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b) and ``labels``: label is the smallest node reachable.

    ``labels`` are those of an earlier call, whose links hold on.
    """
    links = edges.select("a", "b")
    if labels is not None:
        links = links.union(labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    parts = _tasks(links.count(), SMALL_ROWS)
    links = staged(links.union(links.select("b", "a")).distinct().coalesce(parts), "links")
    now = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
    now = staged(now.coalesce(parts), "labels")
    while True:
        near = links.join(now, links.b == now.node).groupBy("a").agg(F.min("label").alias("near"))
        moved = now.join(near, now.node == near.a, "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old"))
        moved = staged(moved.coalesce(parts), "moved")
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
        jumped = moved.join(jump, "label").select("node", F.col("to").alias("label"), (F.col("to") != F.col("old")).alias("turned"))
        jumped = staged(jumped.coalesce(parts), "labels")
        unstaged(now, moved)
        now = jumped
        if not now.filter("turned").limit(1).count():
            break
    found = now.select("node", "label")
    if labels is not None:
        found = found.unionByName(labels.join(found.select("node"), "node", "left_anti").select("node", "label"))
    out = staged(found.coalesce(parts), "labels")
    unstaged(now, links)
    return out


def linked(docs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """doc_id, mark, n_shingles, label of every row: equal labels are connected (null: no words)."""
    ship_package(docs.sparkSession)
    rows = staged(nodes(docs, n), "nodes")
    shared = staged(shared_signatures(docs, n, similarity), "shared")
    sketches = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    sketches = staged(sketches.join(shared.select("node").distinct(), "node", "left_semi"), "sketches")
    order = Window.partitionBy("signature").orderBy("rare", "node")
    sized = shared.join(sketches.select("node", "size"), "node").withColumn("_rank", F.row_number().over(order))
    ranked = staged(sized.drop("rare"), "ranked")
    unstaged(shared)
    close = _may_link(similarity)
    labels = staged(ranked.select("node", F.col("node").alias("label")).limit(0), "labels")
    tested: list[DataFrame] = []
    kept: list[DataFrame] = []
    texts: list[DataFrame] = []
    whole = False
    covered = turn = 0
    members = ranked.withColumn("label", F.col("node"))
    while True:
        more = PIVOTS[min(turn, len(PIVOTS) - 1)]
        pairs = pairs_of(members.filter((F.col("_rank") > covered) & (F.col("_rank") <= covered + more)), members, similarity)
        for earlier in tested:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        sides = {x: sketches.withColumnsRenamed({"node": x, "size": f"size_{x}", "sketch": f"sketch_{x}"}) for x in "ab"}
        judged = pairs.join(sides["a"], "a").join(sides["b"], "b").select("a", "b", close("size_a", "size_b", "sketch_a", "sketch_b").alias("likely"))
        judged = staged(judged, "pairs")
        tested.append(judged.select("a", "b"))
        kept.append(judged)
        likely = judged.filter("likely").select("a", "b")
        if n_likely := likely.count():
            parts = _tasks(n_likely, LARGE_ROWS)
            if not whole:
                whole = turn > 0
                if whole:  # all that the open groups can still ask for: later rounds need no further scan
                    wanted = members.select("node").distinct()
                else:
                    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                for earlier in texts:  # those of an earlier round are there
                    wanted = wanted.join(earlier.select("node"), "node", "left_anti")
                wanted = staged(wanted, "wanted")
                if wanted.limit(1).count():
                    texts.append(staged(texts_of(docs, wanted, n), "texts"))
                unstaged(wanted)
            known = reduce(DataFrame.unionByName, texts).dropDuplicates(["node"])
            edges = staged(verified(likely, known, n, similarity).coalesce(parts), "edges")
            labels, old = components(edges, labels), labels
            unstaged(edges, old)
        covered, turn = covered + more, turn + 1
        # groups with members that aren't connected and haven't all met: each pair has a free member, and free ones come first
        labelled = ranked.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        free = F.count_if((F.col("code") == 0) | (F.col("code") % 2 == 1))
        sizes = labelled.groupBy("signature").agg(F.count("*").alias("_n"), free.alias("_free"), F.min("label").alias("_x"), F.max("label").alias("_y"))
        rest = sizes.filter((F.col("_x") < F.col("_y")) & (F.col("_n") > covered + 1) & (F.col("_free") > covered)).select("signature")
        after = staged(labelled.join(rest, "signature"), "open")
        if turn > 1:
            unstaged(members)
        members = after
        if not members.limit(1).count():
            break
    unstaged(members, ranked, sketches, *kept, *texts)
    named = rows.select("doc_id", "mark", "n_shingles", "node").join(labels, "node", "left")
    return named.select("doc_id", "mark", "n_shingles", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, n: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A set is the distinct n-word shingles of the whole text, words being runs of
    non-white-space with A-Z lower-cased; with fewer words all of them as one. Null texts
    and texts without words have an empty set and are linked with nothing: component_id is
    their own doc_id. Rows whose sets have at least that Jaccard similarity are linked, and
    component_id is the smallest doc_id reachable by links (null only if all of them are
    null). Repeated rows stay rows; other columns aren't read; no rows give no rows.
    """
    named = linked(docs, n, similarity)
    smallest = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("_least"))
    out = named.join(smallest, "label", "left")
    least = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return out.select("doc_id", "n_shingles", least.alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all their columns, of which one of each group of linked rows stays.

    That is the row with the smallest doc_id (null last; of equal ids the text's hash
    decides; of equal rows any one). Rows without words are linked with nothing and stay.
    """
    named = staged(linked(docs, n, similarity), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("m"))
    winners = named.filter("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("w")).select("w.id", "w.m")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k"), _mark().alias("mark"))
    first = keyed.join(winners, F.col("k").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left_semi").dropDuplicates(["k", "mark"])
    wordless = named.filter("label IS NULL").select(F.col("doc_id").alias("id"), F.col("mark").alias("m")).distinct()
    empty = keyed.filter(~F.col("row.text").rlike(r"[^\x20\x09-\x0D]") | F.col("row.text").isNull())
    rest = empty.join(wordless, F.col("k").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left_semi")
    return first.unionByName(rest).select("row.*")
