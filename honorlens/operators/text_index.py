"""Trigram index for text search (P15, P18): a search opens only the files that can hold a match.

A regular expression without a fixed beginning can't be pushed down to Parquet, so every
search reads every text. Here the rows are written once in files of at most
``file_rows`` rows, next to a posting table of (trigram, file) pairs sorted by trigram. A
match must contain the literal runs of its expression; the files that have all their
trigrams are read and searched with the expression itself, so the result is that of a full
scan, whatever the index says. Everything is built from column expressions. A task
collects the distinct trigrams of its files before the shuffle, so what moves is a row for
each trigram and file, however often the trigram occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .search import text_match

GRAM = 3
#: Rows a file. Fewer make the index larger and a search read less.
FILE_ROWS = 10_000
#: Texts are cut into overlapping pieces of so many characters before their trigrams are listed.
PIECE = 4096

_QUANTIFIERS = "*?+{"
_GROUP_STARTS = ("(?:", "(?=", "(?!", "(?>", "(?<")
_CLASS_ESCAPES = "bBdDsSwWAzZGhHvVRtnrfae"


def _skip_class(pattern: str, i: int) -> int:
    """Behind the character class that begins at ``i`` (nested ones included); -1 if it doesn't end."""
    depth, start = 0, i
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            depth, start = depth + 1, i
        elif c == "]" and i > start + 1 and not (i == start + 2 and pattern[start + 1] == "^"):
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def _skip_group(pattern: str, i: int) -> int:
    """Behind the group that begins at ``i``; -1 if it doesn't end or may change how letters are read."""
    depth = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _skip_class(pattern, i)
            if i < 0:
                return -1
            continue
        elif c == "(":
            if pattern.startswith("(?", i) and not pattern.startswith(_GROUP_STARTS, i):
                return -1  # flags
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return -1


def required_runs(pattern: str) -> list[list[str]] | None:
    """For each alternative of a regular expression, literal runs that every match of it contains.

    Groups and classes end a run and add nothing; so does a character that may be missing.
    None where the expression can't be judged: quoting, numeric and property escapes, flags."""
    alternatives, runs, run, i = [], [], "", 0

    def end() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            end()
            alternatives.append(runs)
            runs, i = [], i + 1
            continue
        if c in "()[":
            end()
            i = _skip_group(pattern, i) if c == "(" else _skip_class(pattern, i) if c == "[" else -1
            if i < 0:
                return None
        elif c in _QUANTIFIERS:
            if run and c != "+":
                run = run[:-1]  # the character before it may be missing
            end()
            i = pattern.find("}", i) + 1 if c == "{" else i + 1
            if not i:
                return None
        elif c in ".^$":
            end()
            i += 1
        elif c == "\\":
            e = pattern[i + 1 : i + 2]
            if e in _CLASS_ESCAPES and e:
                end()
            elif e and not e.isalnum():
                run += e
            else:
                return None
            i += 2
        else:
            run += c
            i += 1
    end()
    return [*alternatives, runs]


def required_grams(term: str, literal: bool = False) -> list[set[str]] | None:
    """For each alternative of a search term, the trigrams that a text must have; None: any text may match."""
    term = term.lower()
    found = [[term]] if literal else required_runs(term)
    if found is None:
        return None
    grams = [{r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)} for runs in found]
    return grams if all(grams) else None


@dataclass(frozen=True)
class TextIndex:
    """A written table with its index; ``path`` and the searched columns are all that another session needs."""

    spark: SparkSession
    path: str
    text_cols: tuple[str, ...]

    def files(self) -> DataFrame:
        """(file, n_rows) of every file of the table."""
        return self.spark.read.parquet(f"{self.path}/files")

    def candidates(self, term: str, literal: bool = False) -> DataFrame:
        """(file, n_rows) of the files that can hold a match of ``term``."""
        grams = required_grams(term, literal)
        if grams is None:
            return self.files()
        wanted = sorted(set().union(*grams))
        held = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("gram").isin(wanted)).groupBy("file").agg(
            F.collect_set("gram").alias("held"))  # the term's trigrams at most
        fits = F.lit(False)
        for alternative in grams:
            fits = fits | (F.size(F.array_except(F.array(*[F.lit(g) for g in sorted(alternative)]), "held")) == 0)
        return self.files().join(held.filter(fits).select("file"), "file", "left_semi")

    def search(self, term: str, literal: bool = False) -> DataFrame:
        """The rows that match ``term`` as ``search.text_match`` defines it, read from the files that can hold one.

        The file names go through the driver, one for up to ``file_rows`` rows of those that
        can match, as they do in any scan of a folder."""
        whole = self.spark.read.parquet(f"{self.path}/rows")
        names = [f"{self.path}/rows/{r['file']}" for r in self.candidates(term, literal).select("file").toLocalIterator()]
        rows = self.spark.read.schema(whole.schema).parquet(*names) if names else whole.limit(0)
        return rows.filter(text_match(self.text_cols, term, literal))


def write_text_index(df: DataFrame, text_cols: Sequence[str], cluster_by: Sequence[str] = (), file_rows: int = FILE_ROWS,
                     path: str | None = None) -> TextIndex:
    """Write ``df`` and the trigram index of ``text_cols`` (lower-cased, whole texts).

    ``cluster_by`` sorts the rows by columns that make neighbours alike (a language, a source),
    which leaves fewer files for a term. Null texts have no trigrams and match nothing; texts
    under three characters are found by terms that can't be pruned only, as they can hold no
    longer run. ``path`` is a folder that driver and executors share (by default a new one in
    ``spark.checkpoint.dir``); it must not exist. An empty table gives an index that finds
    nothing."""
    if file_rows < 1 or not text_cols:
        raise ValueError("file_rows must be at least 1, and there must be a text column")
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/text-index-{uuid.uuid4().hex}"
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows")
    name = F.col("_metadata.file_name").alias("file")
    rows.select(name).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{path}/files")
    # look-aheads list overlapping pieces, and then overlapping trigrams, in one walk over a text
    pieces = F.flatten(F.array(*[
        F.coalesce(F.regexp_extract_all(F.lower(F.col(c)), F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1)),
                   F.array().cast("array<string>"))
        for c in text_cols]))
    grams = F.array_distinct(F.regexp_extract_all(F.col("piece"), F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))
    postings = rows.select(name, F.explode(pieces).alias("piece")).select("file", F.explode(grams).alias("gram")).distinct()
    postings.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.parquet(f"{path}/postings")
    return TextIndex(spark, path, tuple(text_cols))
