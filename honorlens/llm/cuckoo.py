"""Exact dedup on a cuckoo-filter index of live digests.

The index is dealt into buckets by the digest's first bytes. Each bucket holds a cuckoo
filter (16-bit fingerprints, four to a slot row, two rows for each key) and the bucket's
content: the digests that are alive, how many rows have each, and the row that is kept.
A row's digest is looked up in the filter; only a hit is verified against the content
(a false positive finds nothing there), a miss goes in as new. A digest whose last row
is taken back leaves filter and content. When an insertion finds no place after
``MAX_KICKS`` moves, the filter is doubled and filled again from the stored digests.

A bucket's state is one row of a table in the shared folder, and ``updated`` turns a
state and a batch of changes into the next state, so an index lives across runs and a
lost executor costs its bucket's last update. Digests are uniform, so buckets are even;
equal digests of a batch are added up where they are read, so a text that a third of
all rows share reaches its bucket as one row for each batch read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import lower_ascii, staged

SLOTS, MAX_KICKS = 4, 400
#: Rows for which one more bucket is made.
ROWS_PER_BUCKET = 50_000
STATE_SCHEMA = "bucket int, rows_log2 int, filter binary, digests binary, keep_ids binary, sizes binary"
NO_ID = np.iinfo(np.int64).min  # a row without an id


class CuckooFilter:
    """Approximate set of digests (bytes of 16 or more) with deletion."""

    def __init__(self, rows_log2: int = 4, table: bytes | None = None):
        self.log2 = rows_log2
        self.mask = (1 << rows_log2) - 1
        self.table = np.frombuffer(table, dtype=np.uint16).tolist() if table else [0] * (SLOTS << rows_log2)

    def _where(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[4:6], "little") or 1
        one = int.from_bytes(digest[6:14], "little") & self.mask
        return mark, one, one ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        mark, one, two = self._where(digest)
        return mark in self.table[SLOTS * one : SLOTS * one + SLOTS] or mark in self.table[SLOTS * two : SLOTS * two + SLOTS]

    def insert(self, digest: bytes) -> bool:
        """False when no place was found: the filter then lacks one entry and must be made anew."""
        mark, one, two = self._where(digest)
        for row in (one, two):
            for i in range(SLOTS * row, SLOTS * row + SLOTS):
                if not self.table[i]:
                    self.table[i] = mark
                    return True
        row = two
        for kick in range(MAX_KICKS):
            i = SLOTS * row + (mark + kick) % SLOTS
            mark, self.table[i] = self.table[i], mark
            row ^= mark * 0x5BD1E995 & self.mask
            for i in range(SLOTS * row, SLOTS * row + SLOTS):
                if not self.table[i]:
                    self.table[i] = mark
                    return True
        return False

    def delete(self, digest: bytes) -> bool:
        """Takes out one entry of a digest that was inserted."""
        mark, one, two = self._where(digest)
        for row in (one, two):
            for i in range(SLOTS * row, SLOTS * row + SLOTS):
                if self.table[i] == mark:
                    self.table[i] = 0
                    return True
        return False

    def to_bytes(self) -> bytes:
        return np.array(self.table, dtype=np.uint16).tobytes()


class Bucket:
    """One bucket: its filter, and by live digest [kept id, rows]."""

    def __init__(self, state: pd.Series | None = None, width: int = 32):
        self.filter, self.content = CuckooFilter(), {}
        if state is not None:
            self.filter = CuckooFilter(int(state["rows_log2"]), state["filter"])
            raw, ids, sizes = state["digests"], np.frombuffer(state["keep_ids"], np.int64), np.frombuffer(state["sizes"], np.int64)
            self.content = {raw[width * i : width * i + width]: [int(k), int(n)] for i, (k, n) in enumerate(zip(ids, sizes, strict=True))}

    def _index(self, digest: bytes) -> None:
        if not self.filter.insert(digest):
            self._resize()

    def _resize(self) -> None:
        log2 = self.filter.log2
        while True:  # the digest that found no place is among the stored ones
            log2 += 1
            self.filter = CuckooFilter(log2)
            if all(self.filter.insert(d) for d in self.content):
                return

    def add(self, digest: bytes, keep_id: int, rows: int) -> None:
        entry = self.content.get(digest) if digest in self.filter else None  # a hit may be false
        if entry is None:
            self.content[digest] = [keep_id, rows]
            self._index(digest)
        else:
            entry[0], entry[1] = max(entry[0], keep_id), entry[1] + rows

    def remove(self, digest: bytes, rows: int) -> None:
        entry = self.content.get(digest) if digest in self.filter else None
        if entry is None:
            return
        entry[1] -= rows
        if entry[1] <= 0:
            del self.content[digest]
            self.filter.delete(digest)

    def state(self, bucket: int) -> pd.DataFrame:
        ids = np.array([v[0] for v in self.content.values()], dtype=np.int64)
        sizes = np.array([v[1] for v in self.content.values()], dtype=np.int64)
        return pd.DataFrame([{"bucket": bucket, "rows_log2": self.filter.log2, "filter": self.filter.to_bytes(), "digests": b"".join(self.content), "keep_ids": ids.tobytes(), "sizes": sizes.tobytes()}])


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased; null counts as empty. Every row stays."""
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            out = [hashlib.sha256((x.as_py() or b"").translate(lower)).digest() for x in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "digest": pa.array(out, pa.binary())})

    return docs.select(doc_id, text).mapInArrow(hashed, "doc_id long, digest binary")


def changes(rows: DataFrame, buckets: int, sign: int = 1) -> DataFrame:
    """(bucket, digest, keep_id, rows): the rows of each batch read, added up by digest.

    ``sign`` 1 inserts rows, -1 takes them back (their digest dies with the last row; the
    kept id of a digest that stays alive isn't changed).
    """

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x = x.assign(doc_id=x["doc_id"].astype("Int64").fillna(NO_ID).astype(np.int64))
            x = x.groupby("digest", as_index=False, sort=False).agg(keep_id=("doc_id", "max"), rows=("doc_id", "size"))
            x["bucket"] = np.array([int.from_bytes(d[:4], "big") % buckets for d in x["digest"]], dtype=np.int32)
            x["rows"] *= sign
            yield x[["bucket", "digest", "keep_id", "rows"]]

    return rows.select("doc_id", "digest").mapInPandas(combined, "bucket int, digest binary, keep_id long, rows long")


def updated(state: DataFrame | None, change: DataFrame) -> DataFrame:
    """The state of every bucket after ``change``; without a state, that of a new index."""

    def applied(bucket: int, old: Bucket, change: pd.DataFrame) -> pd.DataFrame:
        for digest, keep_id, rows in zip(change["digest"], change["keep_id"].tolist(), change["rows"].tolist(), strict=True):
            if rows > 0:
                old.add(bytes(digest), keep_id, rows)
            else:
                old.remove(bytes(digest), -rows)
        return old.state(bucket)

    if state is None:
        return change.groupBy("bucket").applyInPandas(lambda key, x: applied(int(key[0]), Bucket(), x), STATE_SCHEMA)

    def both(key, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        return applied(int(key[0]), Bucket(old.iloc[0] if len(old) else None), change)

    return state.groupBy("bucket").cogroup(change.groupBy("bucket")).applyInPandas(both, STATE_SCHEMA)


def live(state: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every live digest."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for _, row in x.iterrows():
                content = Bucket(row).content
                keep = pd.array([None if v[0] == NO_ID else v[0] for v in content.values()], dtype="Int64")
                yield pd.DataFrame({"digest": list(content), "keep_id": keep, "group_size": [v[1] for v in content.values()]})

    return state.mapInPandas(listed, "digest binary, keep_id long, group_size long")


def bucket_count(rows: int) -> int:
    return max(16, -(-rows // ROWS_PER_BUCKET))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row a document, dropped ones too: doc_id, digest, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row
    with the largest doc_id of equal texts is kept. Rows without a doc_id come after any
    others; where all rows of a text lack it, keep_id is null and each of them counts as
    kept, as nothing tells them apart (so do repeated rows with the kept id). Only doc_id
    and text are read. No rows give no rows.
    """
    ship_package(docs.sparkSession)
    rows = staged(digests(docs), "digests")
    state = staged(updated(None, changes(rows, bucket_count(rows.count()))), "cuckoo")
    out = rows.join(live(state), "digest")
    return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, of which one of each group of equal texts stays: see exact_dedup.

    Of rows equal in text and doc_id (or without one) any one stays.
    """
    ship_package(docs.sparkSession)
    rows = staged(digests(docs), "digests")
    state = staged(updated(None, changes(rows, bucket_count(rows.count()))), "cuckoo")
    digest = F.unhex(F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256))
    keyed = docs.select(F.struct("*").alias("row"), digest.alias("k"), F.col("doc_id").alias("id"))
    kept = live(state).select("digest", "keep_id")
    out = keyed.join(kept, (F.col("k") == F.col("digest")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return out.dropDuplicates(["k", "id"]).select("row.*")
