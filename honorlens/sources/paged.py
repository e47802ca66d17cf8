"""A source of linked pages, followed from its first page, and checked before it is used.

A page is one JSON document (UTF-8) in a file of its own, plain or packed (see ``json_array``):
an array of records and the name of the next page under ``links.next`` (none on the last). A
page may be large: its records are read by byte ranges, a slice of some MB at a time. Pages are
edges of a graph, and the order comes from following the links of all pages at once: after
round k the first 2^k pages are known, and each page knows the one 2^k further on. A source
counts only if

* every page can be parsed, and a page that is linked to is there,
* the links from the first page end, without meeting a page twice,
* pages and records are those of the manifest (page, n_records), where one is given.

``read_pages`` takes the first source that holds; reading errors and broken chains alike
lead on to the next one. The records of a source are parsed only if its links hold; checking
reads a source once more than using it does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised
from .json_array import RANGE_BYTES, array_slices, split_documents
from .nested import _exploded

CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Paged:
    """Where the pages of a source are, which is the first, and what a page is called (by its file)."""

    name: str
    path: str | list[str]  # a folder, or several
    first: str
    page_name: str = "_metadata.file_name"


def pages(spark: SparkSession, source: Paged, records: str, record: T.StructType, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The pages (file, page, next, corrupt) but for what their records hold, and where these are (see ``split_documents``)."""
    listed = spark.read.format("binaryFile").load(source.path)
    files = materialised(listed.select(F.expr(source.page_name).alias("page"), F.col("path").alias("file"), F.col("length").alias("size")))
    outlines, ranges = split_documents(files, records, range_bytes)
    links = T.StructType([T.StructField("next", T.StringType())])
    schema = T.StructType([T.StructField(records, T.ArrayType(record)), T.StructField("links", links), T.StructField(CORRUPT, T.StringType())])
    outlines = outlines.select("file", F.from_json("outline", schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("d"))
    more = F.coalesce(F.size(f"d.{records}"), F.lit(0)) > 0  # records in a second array of that name
    found = files.join(outlines, "file").select("file", "page", F.col("d.links.next").alias("next"), (F.col("d").isNull() | F.col(f"d.{CORRUPT}").isNotNull() | more).alias("corrupt"))
    return materialised(found), ranges


def page_records(placed: DataFrame, record: T.StructType) -> DataFrame:
    """page, position, records (an array; null if the page has none) and whether it is corrupt: a row a slice.

    ``placed`` are the ranges of pages, with page and position.
    """
    schema = T.StructType([T.StructField("records", T.ArrayType(record)), T.StructField(CORRUPT, T.StringType())])
    text = F.concat(F.lit('{"records": ['), "slice", F.lit("]}"))
    read = array_slices(placed, ["page", "position"]).select("page", "position", F.from_json(text, schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("d"))
    return read.select("page", "position", "d.records", F.col(f"d.{CORRUPT}").isNotNull().alias("corrupt"))


def page_order(links: DataFrame, first: str) -> tuple[DataFrame, bool]:
    """(page, position) of the pages from ``first`` on, by ``links`` (page, next), and whether the links end.

    A page that is linked to but missing has its position too. With a cycle, or a page that
    is there twice, the links don't end and the positions mean nothing.
    """
    jumps = materialised(links.select("page", F.col("next").alias("to")))
    n = jumps.count()
    found = materialised(jumps.filter(F.col("page") == first).select("page", F.lit(0).cast("long").alias("position")))
    step = 1
    while step <= 2 * n:
        ahead = found.join(jumps, "page").filter(F.col("to").isNotNull()).select(F.col("to").alias("page"), (F.col("position") + step).alias("position"))
        ahead = materialised(ahead)
        reached = ahead.join(found.select("page", F.lit(1).alias("again")), "page", "left").agg(F.count("page").alias("n"), F.count("again").alias("again")).first()
        if not reached["n"]:
            break
        if reached["again"]:
            return found, False
        found = materialised(found.unionByName(ahead))
        there = jumps.select(F.col("page").alias("to"), F.col("to").alias("further"))
        jumps = materialised(jumps.join(there, "to", "left").select("page", F.col("further").alias("to")))
        step *= 2
    twice = found.groupBy("page").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return found, not twice


def followed(found: DataFrame, first: str) -> tuple[DataFrame, str | None]:
    """(file, page, position) of the pages ``found`` (see ``pages``), and why their links can't be used; None if they can."""
    order, ends = page_order(found, first)
    if not ends:
        return order, "the links run in a circle, or a page is there twice"
    if not order.limit(1).count():
        return order, f"no first page {first}"
    chain = materialised(order.join(found, "page", "left"))
    worst = chain.agg(F.min(F.when(F.col("corrupt").isNull(), F.col("page"))).alias("missing"), F.min(F.when(F.col("corrupt"), F.col("page"))).alias("corrupt")).first()
    return chain.select("file", "page", "position"), _fault((worst["missing"], "is missing"), (worst["corrupt"], "can't be parsed"))


def counted(read: DataFrame, manifest: DataFrame | None = None) -> str | None:
    """Why the records ``read`` (see ``page_records``) can't be used; None if they can."""
    n = F.sum(F.when(F.col("records").isNull(), 0).otherwise(F.size("records"))).alias("n_records")
    chain = read.groupBy("page").agg(n, F.max("corrupt").alias("corrupt"))
    if manifest is None:
        chain = chain.withColumn("listed", F.col("n_records"))
    else:
        chain = chain.join(manifest.select("page", F.col("n_records").alias("listed")), "page", "full_outer")
    differs = F.when(~F.col("n_records").eqNullSafe(F.col("listed")), F.col("page"))
    worst = chain.agg(F.min(F.when(F.col("corrupt"), F.col("page"))).alias("corrupt"), F.min(differs).alias("differs")).first()
    return _fault((worst["corrupt"], "can't be parsed"), (worst["differs"], "isn't as the manifest has it"))


def _fault(*pages: tuple[str | None, str]) -> str | None:
    """The first of some (page, what is wrong with it) that names a page."""
    return next((f"page {page} {what}" for page, what in pages if page is not None), None)


def read_pages(spark: SparkSession, sources: Sequence[Paged], records: str, record: T.StructType, manifest: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """source, page, position and records of the first source that holds; an error that names every fault if none does.

    A page has one row, or several with some of its records each if it is large. Pages that the
    links don't reach are left out. ``manifest`` (page, n_records) has a row a page.
    """
    faults = []
    for source in sources:
        try:
            found, ranges = pages(spark, source, records, record, range_bytes)
            order, why = followed(found, source.first)
            if why is None:
                read = page_records(materialised(ranges.join(order, "file")), record)
                why = counted(read, manifest)
        except PySparkException as exc:  # the path, the listing or reading itself failed
            why = exc.getCondition() or type(exc).__name__
        except Exception as exc:  # noqa: BLE001 - a task's failure reaches Python as a py4j error
            why = type(exc).__name__
        if why is None:
            return read.select(F.lit(source.name).alias("source"), "page", "position", "records")
        faults.append(f"{source.name}: {why}")
    raise FileNotFoundError("no source holds: " + "; ".join(faults))


def records_of(read: DataFrame, *keep: str) -> DataFrame:
    """The records of all pages, one row each, with the page's columns in ``keep``."""
    return _exploded(read, "records", "r", *map(F.col, keep)).select(*keep, "r.*")
