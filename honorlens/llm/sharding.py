"""Minimax contiguous sharding: the smallest capacity that holds ordered atomic groups in k shards.

Rows with equal texts are one group that stays together. Groups are ordered by a 60-bit
key (from the text's MD5), and shards are runs of that order, so all that is to be found
are the k - 1 keys to cut at. The capacity is found by binary search, each probe checked
greedily: the next cut goes to the last group boundary within reach.

The boundaries themselves never come to the driver. It holds the total size of key
ranges, ``FIRST_BITS`` of the key at first: at most 4,096 rows. A greedy run that may cut
anywhere inside a range gives a lower bound of the capacity, one that may cut only at
known boundaries an upper bound. While they differ, only the ranges that a cut can
fall into are divided further by one more aggregation over the group sizes, until both
bounds are equal: then the capacity is the least possible one, exactly.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

KEY_BITS, FIRST_BITS, MORE_BITS = 60, 12, 6
#: Rows of one shard whose slots are counted in one task, about (a hot group's shard has more).
SLOT_GROUP = 100_000


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized_rows(docs: DataFrame, overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and ``overhead``), text_crc32, key. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text_key(text).alias("key"),
    )


class _Ranges:
    """Key ranges in order: (first key, bits, bytes, groups); a range of one group can't be divided."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.rows = self._summed(groups, FIRST_BITS)
        self._added()

    def _summed(self, groups: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        shift = KEY_BITS - bits
        found = groups.groupBy(F.shiftright("key", shift).alias("b")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        return [(r["b"] << shift, bits, int(r["bytes"]), int(r["n"])) for r in found.collect()]

    def _added(self) -> None:
        self.rows.sort()
        self.edges = [0, *accumulate(r[2] for r in self.rows)]
        self.total = self.edges[-1]

    def divide(self, which: set[int]) -> None:
        keep = [r for i, r in enumerate(self.rows) if i not in which]
        for bits in {self.rows[i][1] for i in which}:
            shift = KEY_BITS - bits
            blocks = [self.rows[i][0] >> shift for i in which if self.rows[i][1] == bits]
            keep += self._summed(self.groups.filter(F.shiftright("key", shift).isin(blocks)), min(KEY_BITS, bits + MORE_BITS))
        self.rows = keep
        self._added()

    def greedy(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Where the shards end when each takes all it can; ``hopeful``: ranges of several groups can be cut anywhere."""
        ends, at = [], 0
        for _ in range(shards):
            i = bisect_right(self.edges, at + capacity) - 1
            at = at + capacity if hopeful and i < len(self.rows) and self.rows[i][3] > 1 else self.edges[i]
            ends.append(min(at, self.total))
        return ends

    def smallest(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, hopeful)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the keys at which shards 1, 2, ... begin, for ``groups`` (key, bytes).

    Of the cuts that keep the capacity, those nearest to equal shares are taken.
    """
    ranges = _Ranges(groups)
    if not ranges.rows:
        return 0, []
    most = int(groups.agg(F.max("bytes")).first()[0])
    low, high = max(most, -(-ranges.total // shards)), ranges.total
    while True:
        low = ranges.smallest(low, high, shards, hopeful=True)
        high = ranges.smallest(low, high, shards, hopeful=False)
        if low == high:
            break
        first, last = ranges.greedy(low, shards, hopeful=False), ranges.greedy(high, shards, hopeful=True)
        which = set()
        for a, b in zip(first, last, strict=True):
            i, j = bisect_right(ranges.edges, a) - 1, bisect_right(ranges.edges, b)
            which.update(k for k in range(max(0, i), min(j, len(ranges.rows))) if ranges.rows[k][3] > 1)
        ranges.divide(which)
    edges, capacity = ranges.edges, high
    least = [ranges.total]  # from the end: the first boundary from which the later shards hold the rest
    for _ in range(shards - 1):
        least.append(edges[bisect_left(edges, least[-1] - capacity)])
    least.reverse()
    keys, at = [], 0
    for k in range(1, shards):
        lo, hi = bisect_left(edges, max(least[k - 1], at)), bisect_right(edges, min(at + capacity, ranges.total)) - 1
        ideal = k * ranges.total / shards
        i = min(max(bisect_left(edges, ideal), lo), hi)
        if i > lo and ideal - edges[i - 1] < edges[i] - ideal:
            i -= 1
        at = edges[i]
        keys.append(ranges.rows[i][0] if i < len(ranges.rows) else 1 << KEY_BITS)
    return capacity, keys


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in its shard) of every row.

    The largest shard is as small as it can be while equal texts (null counts as empty)
    stay together and shards are runs of the key order. Null doc_ids and repeated rows
    are rows like any other; other columns aren't read. A shard may stay empty when there
    are fewer texts than shards. No rows give no rows.
    """
    rows = staged(sized_rows(docs), "sized")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, keys = minimax_cuts(groups, shards)
    shard = sum(((F.col("key") >= F.lit(k)).cast("int") for k in keys), F.lit(0))
    dealt = rows.select("doc_id", "size", "text_crc32", "key", shard.cast("int").alias("shard"))
    parts = 1 + rows.count() // (3 * SLOT_GROUP)
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    counts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "key")
    slot = (F.col("_before") + F.row_number().over(within) - 1).alias("slot")
    return dealt.join(counts, ["shard", "_part"]).select("doc_id", "size", "text_crc32", "shard", slot)
