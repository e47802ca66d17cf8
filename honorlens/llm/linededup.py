"""Corpus-wide line dedup on levelled sorted runs of line hashes.

Documents come in batches. A batch's lines become 128-bit hashes, counted by document;
lines that a run already knows to be frequent are taken out by a merge anti-join with
the runs (both sides are bucketed and sorted by the hash), and what is left is added as
a run of its own. Whenever a level holds ``FANOUT`` runs they are merged into one run of
the next level, so there are few runs however many batches came. At the end the counts
over all runs name the frequent lines; each document gets its own frequent hashes (by a
join on the hash, from the small side's point of view) and drops its lines by them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, shared_folder, staged

FANOUT, BATCHES = 2, 4
SPACES = " \t\n\u000b\f\r"


def line_hashes(lines: Column) -> Column:
    """By line (a, b): 128 bits of its key; null for a key without a character.

    A step an array: within one lambda each use of an expression would compute it again."""
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACES)))
    keys = F.transform(trimmed, lower_ascii)
    return F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(7), k).alias("b"))))


class LineRuns:
    """Levels of runs (a, b, n): n documents have the line. A run is a table bucketed and sorted by (a, b)."""

    def __init__(self, spark: SparkSession, least_docs: int, fanout: int = FANOUT):
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # so that a grouped batch is dealt as the runs are
        self.levels: list[list[str]] = []
        self.made: list[str] = []

    def _written(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", shared_folder(self.spark, name))
        writer.format("parquet").saveAsTable(name)
        self.made.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Takes up a batch: ``lines`` has a row (a, b) for each document and distinct line in it."""
        counted = lines.groupBy("a", "b").agg(F.count("*").alias("n"))
        for run in self.runs():
            frequent = run.filter(F.col("n") >= self.least_docs).select("a", "b")
            counted = counted.hint("merge").join(frequent.hint("merge"), ["a", "b"], "left_anti")
        self._put(0, self._written(counted))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = self._written(self._merged([self.spark.table(x) for x in self.levels[level]]))
            self.levels[level] = []
            self._put(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several. A full outer merge join, not a union: Spark 4.1 takes the union of two
        bucketed scans for bucketed too, but runs their partitions one after the other."""
        rows = runs[0]
        for run in runs[1:]:
            both = rows.hint("merge").join(run.withColumnRenamed("n", "m").hint("merge"), ["a", "b"], "full_outer")
            rows = both.select("a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return rows

    def frequent(self) -> DataFrame:
        """(a, b) of the lines that at least ``least_docs`` documents have."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "a long, b long")
        return self._merged(runs).filter(F.col("n") >= self.least_docs).select("a", "b")

    def drop(self) -> None:
        """Takes the runs' names out of the catalog."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_frequent_lines(docs: DataFrame, least_docs: int = 10, batches: int = BATCHES) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text: frequent lines gone from every document.

    Lines end at \\n; a null or empty text is one empty line. A line is frequent when at
    least ``least_docs`` documents (rows; a repeated row counts again) have a line with its
    key; empty keys never are. Other lines stay, in order, joined by \\n. A null doc_id is a
    value like any other; texts of any length are split whole, and no rows give no rows. Columns
    of ``docs`` named like the new ones are replaced, others stay, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"))  # a struct: no column of docs can clash
    text = F.coalesce(F.col("row.text"), F.lit(""))
    same = ["id", "mark"]  # rows that agree in both have the same lines
    marked = rows.withColumns({"id": F.col("row.doc_id"), "mark": F.xxhash64(text)})
    hashes = F.array_distinct(F.filter(line_hashes(F.split(text, "\n")), lambda x: x.isNotNull()))
    hashed = marked.select(*same, F.pmod(F.xxhash64(*same), F.lit(batches)).cast("int").alias("batch"), hashes.alias("hashes"))
    hashed = staged(hashed.filter(F.size("hashes") > 0), "line_hashes")
    lines = hashed.select(*same, "batch", F.explode("hashes").alias("h")).select(*same, "batch", "h.a", "h.b")
    index = LineRuns(spark, least_docs)
    try:
        for i in range(batches):
            index.add(lines.filter(F.col("batch") == i).select("a", "b"))
        frequent = staged(index.frequent(), "frequent_lines")
    finally:
        index.drop()
    own = lines.join(frequent, ["a", "b"]).groupBy(*same).agg(F.collect_set(F.struct("a", "b")).alias("goes"))  # a text's own lines
    own = own.select(F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), "goes")
    joined = marked.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left")
    split = F.split(text, "\n")
    gone = F.transform(line_hashes(split), lambda h: F.coalesce(F.array_contains(F.col("goes"), h), F.lit(False)))
    stays = F.transform(F.filter(F.arrays_zip(split.alias("line"), gone.alias("gone")), lambda x: ~x["gone"]), lambda x: x["line"])
    any_gone = F.col("goes").isNotNull()
    out = joined.withColumn("n", F.size(split).cast("long")).withColumn("kept", F.when(any_gone, stays))
    new = {
        "n_lines": F.col("n"),
        "n_dropped": F.when(any_gone, F.col("n") - F.size("kept")).otherwise(F.lit(0)).cast("long"),
        "kept_text": F.when(any_gone, F.array_join("kept", "\n")).otherwise(text),
    }
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
