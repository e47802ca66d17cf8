"""Batches, replays, torn attempts and compaction leave the counts of one run over everything."""

import random

import pytest
from pyspark.sql import functions as F

from honorlens.streaming.cube import ATTEMPT, BATCH, ROWS, open_cube, start_cube

KEYS = ["category", "year"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([1900, 1950, None]), i) for i in range(900)]
    return spark.createDataFrame(data, "category string, year int, id long")


def counts(df):
    return sorted(((r.category, r.year, r[ROWS]) for r in df.collect()), key=str)


def whole(rows):
    return counts(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(ROWS)))


def test_batches_replays_and_compaction_equal_one_run(spark, rows, tmp_path):
    cube = open_cube(rows, KEYS, f"{tmp_path}/cube")
    assert cube.read().count() == 0
    cube.compact()
    parts = [rows.filter(F.col("id") < 400), rows.filter(F.col("id").between(400, 649)), rows.filter(F.col("id") >= 650)]
    cube.add(parts[0], 0)
    cube.add(parts[0], 0)  # a replay
    assert counts(cube.read()) == whole(parts[0])
    cube.add(parts[1], 1)
    cube.compact()
    cube.compact()
    cube.add(parts[1], 1)  # a replay of what is compacted
    assert counts(cube.read()) == whole(parts[0].union(parts[1]))
    cube = open_cube(rows, KEYS, f"{tmp_path}/cube")  # another session
    cube.add(parts[2], 2)
    assert counts(cube.read()) == whole(rows)
    cube.compact()
    assert counts(cube.read()) == whole(rows)
    assert cube.commits().filter("compacted").count() == 2


def test_an_attempt_without_a_commit_and_a_second_one_do_not_count(spark, rows, tmp_path):
    cube = open_cube(rows, KEYS, f"{tmp_path}/cube")
    torn = rows.limit(100).groupBy(*KEYS).agg(F.count(F.lit(1)).alias(ROWS))
    torn.withColumns({BATCH: F.lit(0).cast("long"), ATTEMPT: F.lit("torn")}).write.mode("append").partitionBy(BATCH, ATTEMPT).parquet(f"{cube.path}/deltas")
    assert cube.read().count() == 0
    counted = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(ROWS))
    cube._commit(counted, 0, False)
    cube._commit(counted, 0, False)  # two attempts that both came through
    assert counts(cube.read()) == whole(rows)


def test_a_stream_of_files_and_its_second_start(spark, rows, tmp_path):
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    cube = open_cube(stream, KEYS, f"{tmp_path}/cube")
    for _ in range(2):
        start_cube(stream, cube, f"{tmp_path}/progress").awaitTermination()
        assert counts(cube.read()) == whole(rows)
    assert cube.commits().count() == 3
    rows.limit(50).write.mode("append").parquet(f"{tmp_path}/in")
    start_cube(stream, cube, f"{tmp_path}/progress").awaitTermination()
    assert cube.read().agg(F.sum(ROWS)).first()[0] == 950
    with pytest.raises(ValueError):
        cube.add(rows, -1)


def test_reserved_names_are_refused(rows, tmp_path):
    with pytest.raises(ValueError, match="reserved"):
        open_cube(rows.withColumn(ROWS, F.lit(1)), ["category", ROWS], f"{tmp_path}/cube")
