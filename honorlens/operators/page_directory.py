"""Page directory of a listing (O7, C27): any page by opening the file that holds it.

``offset`` sorts and skips everything before a page, on every click. Here the
listing is numbered once by distributed ordinals and written in that order, at
most ``file_rows`` rows a file, with a directory of the first and last place in
each file. The number of results and pages is then known, and page 1 and page
10,000 both read the one file (two at a boundary) in which their places are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .search import page_count, page_info
from .windows import ordinal

PLACE = "_place"
FILE_ROWS = 100_000


@dataclass(frozen=True)
class PageDirectory:
    """A written listing; ``path`` is all that another session needs to open it."""

    spark: SparkSession
    path: str
    page_size: int
    total: int

    @property
    def max_pages(self) -> int:
        return page_count(self.total, self.page_size)

    def clamp(self, page: int | None) -> int:
        return min(max(1, int(page or 1)), self.max_pages)

    def files(self, page: int) -> list[str]:
        """Files that hold places of a page (one, or two at a boundary; more only if a file has under a page)."""
        p = self.clamp(page)
        first, last = (p - 1) * self.page_size + 1, p * self.page_size
        found = self.spark.read.parquet(f"{self.path}/directory").filter(
            (F.col("first_place") <= last) & (F.col("last_place") >= first)).select("file")
        return [r["file"] for r in found.collect()]

    def page(self, page: int | None) -> tuple[DataFrame, dict]:
        """Rows of ``page`` (clamped to what there is) with their place, and the page information."""
        p = self.clamp(page)
        files = self.files(p)
        reader = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/rows").schema)
        rows = reader.parquet(*files) if files else reader.parquet(f"{self.path}/rows")
        rows = rows.filter(F.col(PLACE).between((p - 1) * self.page_size + 1, p * self.page_size)).orderBy(PLACE)
        info = {"page": p, "max_pages": self.max_pages, "total": self.total}
        return rows, info | {"page_info": page_info(info)}


def write_page_directory(df: DataFrame, order: Sequence[str], page_size: int = 40, file_rows: int = FILE_ROWS,
                         path: str | None = None) -> PageDirectory:
    """Number ``df`` in the order of ``order`` (ascending, nulls last) and write it for paging.

    Rows that are equal in ``order`` get places next to each other, in any order. ``path`` is a folder that
    driver and executors share (by default a new one in ``spark.checkpoint.dir``); it must not exist. An
    empty listing has one empty page. A column named ``_place`` is refused."""
    if PLACE in df.columns:
        raise ValueError(f"the listing has a column named {PLACE}")
    if page_size < 1 or file_rows < 1:
        raise ValueError("page_size and file_rows must be at least 1")
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/pages-{uuid.uuid4().hex}"
    numbered = ordinal(df, order, PLACE).sortWithinPartitions(PLACE)
    numbered.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    directory = spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file")).agg(
        F.min(PLACE).alias("first_place"), F.max(PLACE).alias("last_place"), F.count(F.lit(1)).alias("n_rows"))
    # sorted files: a look-up reads the few row groups whose places fit
    directory.withColumn("page_size", F.lit(page_size)).repartitionByRange("first_place").sortWithinPartitions(
        "first_place").write.parquet(f"{path}/directory")
    return open_page_directory(spark, path, page_size)


def open_page_directory(spark: SparkSession, path: str, page_size: int | None = None) -> PageDirectory:
    """The directory written at ``path``; ``page_size`` may differ from the one it was written with."""
    one = spark.read.parquet(f"{path}/directory").agg(F.sum("n_rows").alias("n"), F.max("page_size").alias("p")).first()
    return PageDirectory(spark, path, int(page_size or one["p"] or 40), int(one["n"] or 0))
