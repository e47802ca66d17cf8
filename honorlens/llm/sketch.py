"""Document fingerprints that keep every shingle hash below a fixed share of all hashes.

A shingle is five words in a row (of fewer words, all of them), its hash the MD5 of the
words with a space between. One in ``scale`` hashes is kept, whatever the length of the
text, so sketches of a short and of a very long text can be held against each other: what
share of one lies in the other is estimated from the hashes below the same bound. A
sketch of a union is the union of the sketches. Where no hash is below the bound the
smallest one stays, so a text with words never has an empty sketch; it says the same as a
sketch with that bound would, and the union rule holds (``merged`` drops it beside others).

Everything is a column expression. A hash is written as its first 16 hexadecimal digits,
a fingerprint is its hashes in ascending order, one behind the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii

WORDS, SCALE, DIGITS = 5, 4, 16
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\u000b\f\r"
#: Ranges of doc_ids a shuffle partition, in pairing each document with the next one.
RANGES = 4
LEAST_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever body uses it."""
    return F.transform(F.array(value), body)[0]


def bound(scale: int) -> str:
    """The least hash that isn't kept, as digits: the hashes below are one in ``scale``."""
    if scale < 2:
        raise ValueError("scale must be 2 or more")
    return format(-(-(1 << 4 * DIGITS) // scale), f"0{DIGITS}x")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """MD5 digits of the shingles of ``text``, A-Z lower-cased, in order and with repeats; none without words."""
    tokens = F.split(F.btrim(lower_ascii(text), F.lit(SPACES)), SPACE)

    def hashed(ws: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(ws) - (words - 1), F.lit(1)))
        found = F.transform(first, lambda i: F.md5(F.array_join(F.slice(ws, i, words), " ").cast("binary")))
        return F.when(ws[0] != "", found).otherwise(F.array().cast("array<string>"))

    return let(tokens, hashed)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted distinct hashes below ``bound(scale)``, else the smallest one; null text counts as empty."""

    def kept(hashes: Column) -> Column:
        least = F.when(F.size(hashes) > 0, F.array(F.substring(F.array_min(hashes), 1, DIGITS))).otherwise(hashes)
        below = F.transform(F.filter(hashes, lambda h: h < bound(scale)), lambda h: F.substring(h, 1, DIGITS))
        return let(below, lambda some: F.when(F.size(some) > 0, F.sort_array(F.array_distinct(some))).otherwise(least))

    return let(shingle_hashes(F.coalesce(text, F.lit("")), words), kept)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two shingle sets, from their sketches."""

    def both(union: Column) -> Column:
        below = F.filter(union, lambda h: h < bound(scale))
        return F.when(F.size(below) > 0, below).otherwise(F.slice(union, 1, 1))

    return let(F.sort_array(F.array_union(a, b)), both)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, of the shingle sets of two sketches (1 if both are empty)."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share, 0 to 1, of the shingles of ``a`` that ``b`` has, for texts of any two lengths.

    Null where the sketches can't tell: ``a`` has words, but no hash below the bound, and ``b`` has some.
    """
    common = F.size(F.array_intersect(a, b)) / F.size(a)
    unsure = (a[0] >= bound(scale)) & (F.size(b) > 0) & (b[0] < bound(scale))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(~unsure, common)


def fingerprint(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def hashes_of(fingerprint: Column) -> Column:
    """The sketch that a fingerprint was made from."""
    cut = F.regexp_extract_all(fingerprint, F.lit(f"(.{{{DIGITS}}})"), F.lit(1))
    return F.when(fingerprint == "", F.array().cast("array<string>")).otherwise(cut)


def fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """``docs`` with n_chars (code points) and fingerprint (replaced if there): one map, nothing is moved.

    Equal texts have equal fingerprints; null and empty texts and texts without words an
    empty one. Texts of any length are read whole, repeated rows stay rows, no rows give none.
    """
    n = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return docs.withColumns({"n_chars": n, "fingerprint": fingerprint(sketch(F.col("text"), words, scale))})


def _first_keys(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """First (id, mark) of each of about ``ranges`` even ranges, in descending order of id; ``ranges`` rows come here."""
    order = [F.col("id").desc(), F.col("mark").asc()]
    key = F.struct(F.bitwise_not("id").alias("down"), "mark")  # ascending, it is the order
    dealt = rows.select("id", "mark").repartitionByRange(ranges, *order)
    return sorted((r["k"]["down"], r["k"]["mark"]) for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(key).alias("k")).collect())


def _range_of(keys: list[tuple[int, int]]) -> tuple[Column, Column]:
    """By binary search over the first keys: a row's range, and whether it has the first key of it."""
    down, mark = (F.split(F.lit(",".join(str(k[i]) for k in keys)), ",").cast("array<bigint>") for i in (0, 1))
    own, own_mark = F.bitwise_not("id"), F.col("mark")

    def starts_at_or_before(i: Column) -> Column:
        return (F.get(down, i) < own) | ((F.get(down, i) == own) & (F.get(mark, i) <= own_mark))

    steps = F.lit([1 << i for i in reversed(range((len(keys) - 1).bit_length()))] or [0])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < len(keys)) & starts_at_or_before(at + step), at + step).otherwise(at))
    return found, (F.get(down, F.col("range")) == own) & (F.get(mark, F.col("range")) == own_mark)


def with_next(docs: DataFrame, add: dict[str, Column]) -> DataFrame:
    """doc_id, text and ``add`` of every row, and as next_text and next_<name> those of the row with the next smaller doc_id.

    The last row's next one is the first. Null ids come last, null texts count as empty;
    rows with one id are ordered by a hash of the text, equal rows in any order. Texts are
    moved once: rows go to even ranges of the order, each range gets a copy of the first
    key's rows of the range behind it, and ``add`` is computed where the rows arrive.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(LEAST_ID)).cast("long").alias("id"), F.xxhash64(text).alias("mark"))
    keys = _first_keys(rows, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not keys:
        keys = [(LEAST_ID, LEAST_ID)]
    at, is_first = _range_of(keys)
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("behind"))
    before = F.struct(F.pmod(F.col("range") - 1, F.lit(len(keys))).alias("range"), F.lit(True).alias("behind"))
    places = rows.withColumn("range", at).withColumn("place", F.explode(F.when(is_first, F.array(here, before)).otherwise(F.array(here))))
    dealt = places.select("doc_id", "text", "id", "mark", "place.range", "place.behind").repartition("range").withColumns(add)
    order = Window.partitionBy("range").orderBy("behind", F.col("id").desc(), "mark")
    nexts = {f"next_{c}": F.lead(c).over(order) for c in ("text", *add)}
    return dealt.withColumns(nexts).filter(~F.col("behind")).select("doc_id", "text", *add, *nexts)


def edited_fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and how much they are alike.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next row's text; see with_next for that row and its ties, and
    fingerprints for null, empty and long texts. Columns: doc_id, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next (likeness), in_edited (share of
    the text's shingles that the edited one has) and edited_in. No rows give no rows.
    """
    both = with_next(docs.select("doc_id", "text"), {"sketch": sketch(F.col("text"), words, scale)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited_text"), "sketch", "next_sketch")
    both = both.withColumn("edited", sketch(F.col("edited_text"), words, scale))
    a, b = F.col("sketch"), F.col("edited")
    return both.select(
        "doc_id", "n_chars", "edited_text", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, F.col("next_sketch")).alias("near_next"),
        containment(a, b, scale).alias("in_edited"), containment(b, a, scale).alias("edited_in"),
    )
