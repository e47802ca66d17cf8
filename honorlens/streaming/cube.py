"""Incremental count cube (A13, M15): reports follow a stream without another scan of the fact.

Most reports of the bundle are functions of how often each combination of
attributes occurs. Every micro-batch adds its own counts as a delta, under its batch id
and an attempt of its own, and a commit row names the attempt once the delta is whole. A reader takes
one committed attempt a batch: a batch that runs again after a failure, or whose first
attempt died half way, counts once, and nothing that a reader may hold is deleted.
``compact`` adds all batches so far up into one delta, so that reading doesn't grow with
their number. The cube's size is set by the combinations of its keys, not by rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

ROWS = "n_rows"
BATCH, ATTEMPT = "cube_batch", "cube_attempt"
COMMITS = f"{BATCH} long, {ATTEMPT} string, compacted boolean"


def _stored(keys: StructType) -> StructType:
    return StructType(list(keys.fields)).add(ROWS, "long").add(BATCH, "long").add(ATTEMPT, "string")


@dataclass(frozen=True)
class DeltaCube:
    """Counts by ``keys`` under ``path``, a folder that driver and executors share."""

    spark: SparkSession
    path: str
    keys: StructType

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")

    def _commit(self, counts: DataFrame, batch: int, compacted: bool) -> None:
        attempt = uuid.uuid4().hex
        counts.withColumns({BATCH: F.lit(batch).cast("long"), ATTEMPT: F.lit(attempt)}).write.mode("append").partitionBy(
            BATCH, ATTEMPT).parquet(f"{self.path}/deltas")
        self.spark.createDataFrame([(batch, attempt, compacted)], COMMITS).coalesce(1).write.mode("append").parquet(
            f"{self.path}/commits")

    def _compacted(self) -> int:
        """The last batch that a compaction covers (-1: none)."""
        last = self.commits().filter("compacted").agg(F.max(BATCH)).first()[0]
        return -1 if last is None else last

    def add(self, rows: DataFrame, batch: int) -> None:
        """Count the rows of one batch; nothing happens if that batch is committed. Batch ids
        start at 0 and grow, as a streaming query's do."""
        if batch < 0:
            raise ValueError("batch ids start at 0")
        if batch <= self._compacted() or not self.commits().filter(F.col(BATCH) == batch).isEmpty():
            return
        self._commit(rows.groupBy(*self.keys.names).agg(F.count(F.lit(1)).alias(ROWS)), batch, False)

    def read(self) -> DataFrame:
        """The keys and ``n_rows`` over all committed batches (null is a key value like others)."""
        covered = self._compacted()
        commits = self.commits().filter(F.when(F.col("compacted"), F.col(BATCH) == covered).otherwise(F.col(BATCH) > covered))
        chosen = commits.groupBy(BATCH).agg(F.max(ATTEMPT).alias(ATTEMPT))
        deltas = self.spark.read.schema(_stored(self.keys)).parquet(f"{self.path}/deltas")
        return deltas.join(chosen, [BATCH, ATTEMPT], "left_semi").groupBy(*self.keys.names).agg(F.sum(ROWS).alias(ROWS))

    def compact(self) -> None:
        """Add all committed batches up into one delta. Run it between batches: a batch with a
        lower id than the last committed one can't be added afterwards."""
        last = self.commits().agg(F.max(BATCH)).first()[0]
        if last is not None and last > self._compacted():
            self._commit(self.read(), last, True)


def open_cube(rows: DataFrame, keys: Sequence[str], path: str) -> DeltaCube:
    """The cube at ``path`` by ``keys`` of frames like ``rows`` (batch or streaming); an empty one where there is none."""
    if clash := {ROWS, BATCH, ATTEMPT} & set(keys):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    spark = rows.sparkSession
    types = rows.select(*keys).schema
    cube = DeltaCube(spark, path.rstrip("/"), types)
    spark.createDataFrame([], COMMITS).coalesce(1).write.mode("ignore").parquet(f"{cube.path}/commits")
    spark.createDataFrame([], _stored(types)).write.mode("ignore").partitionBy(BATCH, ATTEMPT).parquet(f"{cube.path}/deltas")
    return cube


def start_cube(stream: DataFrame, cube: DeltaCube, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Feed ``cube`` from a streaming DataFrame; ``available_now`` takes what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(lambda rows, batch: cube.add(rows, batch))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
