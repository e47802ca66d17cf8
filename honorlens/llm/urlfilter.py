"""URL rules looked up in a cascade of Bloom filters: exact membership without a join.

The first level encodes the listed keys. Over all keys that the corpus can ask for, the
second encodes those that the first takes for listed though they aren't, the third the
listed keys that the second takes for false, and so on until a level makes no mistake.
A key's answer is the parity of the first level that lacks it, and it is exact for every
key of that universe. The filters are bits in a literal of the plan: their size follows
the list, not the corpus, and is checked against ``MAX_BYTES``.

A key is a host and a path prefix. A URL is asked for the ends of its host and the starts
of its path that have a listed key's lengths, and only where a label begins there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

#: Bytes of filters of a cascade that a plan may carry.
MAX_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # "block" or "allow"

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def asked_keys(host: Column, path: Column, lengths: list[tuple[int, int]]) -> Column:
    """The keys that a URL can match, in the order of ``lengths`` (of host and path of the listed keys)."""
    keys = []
    for h, p in lengths:
        fits = (F.length(host) == h) | ((F.length(host) > h) & (F.substring(host, -h - 1, 1) == "."))
        keys.append(F.when(fits & (F.length(path) >= p), F.concat(F.substring(host, -h, h) if h else F.lit(""), F.substring(path, 1, p))))
    return F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<string>")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: bytes  # big-endian words of 32 bits

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        found = F.lit(True)
        for at in self.positions(key):
            word = F.substring(F.lit(self.words), (F.shiftright(at, 5) * 4 + 1).cast("int"), F.lit(4))
            found &= F.getbit(F.conv(F.hex(word), 16, 10).cast("long"), at.bitwiseAND(F.lit(31)).cast("int")) == 1
        return found


def bloom_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over the n rows of ``keys`` (key) with about that rate of false positives."""
    bits = 32 * max(2, math.ceil(1.4427 * n * math.log2(1 / rate) / 32))
    if bits > 8 * MAX_BYTES:
        raise ValueError(f"a level of {bits // 8} bytes is over the bound of {MAX_BYTES}; deal the list out by host first")
    empty = Level(bits, max(1, round(math.log2(1 / rate))), seed, b"")
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(31)).cast("int"))).alias("v"))
    out = bytearray(bits // 8)
    for r in words.collect():  # at most bits / 32 rows, see MAX_BYTES
        out[4 * r["w"] : 4 * r["w"] + 4] = int(r["v"]).to_bytes(4, "big")
    return Level(bits, empty.hashes, seed, bytes(out))


class Cascade:
    """Exact membership of the keys in ``listed`` among all those in ``universe`` (both: key, distinct)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside, outside = listed, universe.join(listed, "key", "left_anti")
        inside, outside = staged(inside, "listed"), staged(outside, "unlisted")
        n, others = inside.count(), outside.count()
        self.levels: list[Level] = []
        self.size = n
        while n:
            rate = 0.5 if self.levels or not others else min(0.5, max(1e-6, n * math.sqrt(2) / others))
            level = bloom_level(inside, n, rate, len(self.levels))
            self.levels.append(level)
            wrong = staged(outside.filter(level.has(F.col("key"))), "false_positives")
            inside, outside, n = wrong, inside, wrong.count()
        if sum(len(x.words) for x in self.levels) > MAX_BYTES:
            raise ValueError("the cascade is over its bound")

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (key of the longest rule that fits, else null) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path. The
    longest key wins, of equally long ones that with the longer host. Without a rule the
    cascade's own answer holds: what isn't listed is allowed. A null url, or one without
    ://, has an empty host and path. Existing columns named host, path, rule or verdict are
    replaced; rows are neither dropped nor merged. The list itself is small enough to write
    down (a parameter), the universe is not and never leaves Spark.
    """
    spark: SparkSession = pages.sparkSession
    lengths = sorted({(len(r.host), len(r.path)) for r in rules}, key=lambda x: (-sum(x), -x[0]))
    host, path = host_and_path(F.col(url))
    asked = pages.select(asked_keys(host, path, lengths).alias("keys"))
    rows = [F.struct(F.lit(r.key).alias("key"), F.lit(r.verdict).alias("verdict")) for r in rules]
    listed = spark.range(1).select(F.inline(F.array(*rows) if rows else F.array().cast("array<struct<key:string,verdict:string>>")))
    universe = asked.select(F.explode("keys").alias("key")).union(listed.select("key")).distinct()
    universe = staged(universe, "universe")
    any_rule = Cascade(listed.select("key").distinct(), universe)
    blocking = Cascade(listed.filter("verdict = 'block'").select("key").distinct(), universe)
    out = pages.withColumns({"host": host, "path": path})
    keys = asked_keys(F.col("host"), F.col("path"), lengths)
    out = out.withColumn("rule", F.try_element_at(F.filter(keys, any_rule.has), F.lit(1)))
    verdict = F.when(F.col("rule").isNotNull() & blocking.has(F.col("rule")), "block").otherwise("allow")
    return out.withColumn("verdict", verdict)
