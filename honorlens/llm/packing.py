"""Best-fit packing of tokenised documents into sequences (vector best-fit decreasing).

Every piece asks for a vector of tokens, documents and attention cost (length
squared); every sequence offers a capacity for each. Pieces go in order of falling
length into the open sequence that the score prefers among those with room in every
component: ``norm`` takes the smallest weighted norm of what would remain, ``dot``
the largest weighted dot product of demand and remaining room.

All pieces of one length ask for the same vector, so what is to be decided depends
only on how many pieces there are of each length: at most ``max_tokens`` counts
however large the corpus is. They are added up by Spark, the plan is made on them
(sequences with equal contents so far are one class with a multiplicity), and it
comes back as runs of ranks: piece number r among those of its length goes to
sequence ``first + (r - lo) // per_bin``. Ranks are row numbers in salted groups
plus the counts of the groups before, so a length that a third of all pieces share
is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import staged

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length in a group whose row numbers are counted in one task.
RANK_GROUP = 1_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and the weight of each component in the score.

    ``max_docs`` and ``max_cost`` of None don't bind beyond what ``max_tokens`` implies.
    """

    max_tokens: int = 2048
    max_docs: int | None = None
    max_cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    score: str = "norm"

    def vector(self) -> np.ndarray:
        docs = self.max_tokens if self.max_docs is None else self.max_docs
        cost = self.max_tokens**2 if self.max_cost is None else self.max_cost
        if min(self.max_tokens, docs, cost) < 1 or self.score not in ("norm", "dot"):
            raise ValueError(f"no such capacity: {self}")
        return np.array([self.max_tokens, docs, cost], dtype=np.int64)

    def longest(self) -> int:
        """Length of the longest piece that fits into an empty sequence."""
        tokens, _, cost = self.vector().tolist()
        return min(tokens, int(np.floor(np.sqrt(cost))))


def token_pieces(docs: DataFrame, tokenizer: str, longest: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``longest`` tokens of every document: its ids and then ``end_id``.

    Only documents with more tokens are cut; the first piece takes what is left over,
    all others have ``longest``. Null and empty texts give one piece with the end id
    alone; a null doc_id and repeated rows are kept as they are. ``with_ids`` adds the
    ids themselves (``ids array<int>``). Columns of ``docs`` other than doc_id and text
    aren't read. No rows give no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text_units import blocks, encoder, utf8

        enc = encoder(tokenizer)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for lo, hi in blocks(offsets):
                ids, at = enc.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                flat = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                size = np.diff(at)
                pieces = (size + longest - 1) // longest
                first = size - (pieces - 1) * longest
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * longest)
                length = np.where(piece == 0, first[row], longest)
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((at[row] + start).tolist(), (at[row] + start + length).tolist(), strict=True)]
                out = {
                    "doc_id": doc_ids.take(pa.array(lo + row)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:  # the pieces lie one after the other in flat
                    out["ids"] = pa.ListArray.from_arrays(np.append(at[row] + start, len(flat)).astype(np.int32), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: Capacity) -> tuple[np.ndarray, int]:
    """Runs (length, lo, hi, per_bin, first sequence, offset there), and the number of sequences.

    ``counts`` has the number of pieces by length. Of the pieces of one length, those
    with ranks from lo to hi - 1 go to sequences first + (rank - lo) // per_bin, at
    offset + (rank - lo) % per_bin * length.
    """
    full = capacity.vector()
    weight = np.array(capacity.weights, dtype=float) / full
    room = np.empty((1024, 3), dtype=np.int64)  # by class of equal sequences: what remains in each
    many, first = np.empty(1024, dtype=np.int64), np.empty(1024, dtype=np.int64)
    k, bins, runs = 0, 0, []

    def opened(rest: np.ndarray, n: int, at: int) -> None:
        nonlocal k, room, many, first
        if n <= 0 or rest.min() <= 0:
            return
        if k == len(many):
            alive = np.flatnonzero(many[:k] > 0)
            size = max(1024, 2 * len(alive))
            room2, many2, first2 = np.empty((size, 3), dtype=np.int64), np.empty(size, dtype=np.int64), np.empty(size, dtype=np.int64)
            room2[: len(alive)], many2[: len(alive)], first2[: len(alive)] = room[alive], many[alive], first[alive]
            room, many, first, k = room2, many2, first2, len(alive)
        room[k], many[k], first[k] = rest, n, at
        k += 1

    def filled(length: int, lo: int, left: int, rest: np.ndarray, n: int, at: int, need: np.ndarray) -> int:
        """Puts up to ``left`` pieces into n sequences from ``at`` on, each as full as it gets; how many it took."""
        per = int((rest // need).min())
        whole = min(n, left // per)
        offset = int(full[0] - rest[0])
        if whole:
            runs.append((length, lo, lo + whole * per, per, at, offset))
            opened(rest - per * need, whole, at)
        took = whole * per
        if whole < n and left > took:
            runs.append((length, lo + took, lo + left, left - took, at + whole, offset))
            opened(rest - (left - took) * need, 1, at + whole)
            took, whole = left, whole + 1
        opened(rest, n - whole, at + whole)
        return took

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits into no sequence")
        lo, left = 0, counts[length]
        while left:
            ok = np.flatnonzero((many[:k] > 0) & (room[:k] >= need).all(axis=1))
            if not len(ok):
                per = int((full // need).min())
                n = -(-left // per)
                lo += filled(length, lo, left, full, n, bins, need)
                bins, left = bins + n, 0
                break
            if capacity.score == "norm":
                best = ok[np.argmin((((room[ok] - need) * weight) ** 2).sum(axis=1))]
            else:
                best = ok[np.argmax((room[ok] * need * weight * weight).sum(axis=1))]
            rest, n, at = room[best].copy(), int(many[best]), int(first[best])
            many[best] = 0
            took = filled(length, lo, left, rest, n, at, need)
            lo, left = lo + took, left - took
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: Capacity) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences without gaps, every capacity kept.

    ``pieces`` has doc_id, piece and length (1 or more, and not longer than fits into an
    empty sequence; null is an error); it is read three times and should be a written
    table. Equal rows are packed one by one. No rows give no rows.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(counts, capacity)  # at most max_tokens counts: see the module's text
    salts = 1 + max(counts.values(), default=0) // RANK_GROUP
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    group = Window.partitionBy("length", "_salt")
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = salted.withColumn("_rank", F.row_number().over(group.orderBy(*order)) - 1)
    if salts > 1:
        before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        ranked = ranked.join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before")
    ranked = ranked.drop("_salt")
    sent = pieces.sparkSession.sparkContext.broadcast(runs)  # some rows for each length of at most max_tokens

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs = sent.value
        key = (runs[:, 0] << 40) + runs[:, 1]  # sorted
        run = runs[np.searchsorted(key, (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64), "right") - 1]
        back = rank.to_numpy(np.int64) - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + back // run[:, 3], "offset": run[:, 5] + back % run[:, 3] * run[:, 0]})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 0) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) tokenised, cut and packed; see token_pieces and pack."""
    ship_package(docs.sparkSession)
    pieces = staged(token_pieces(docs, tokenizer, capacity.longest(), end_id), "pieces")
    return pack(pieces, capacity)
