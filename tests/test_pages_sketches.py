"""Page directory (O7) and mergeable sketches."""

import pytest
from pyspark.sql import functions as F

from honorlens.operators import page_directory as P
from honorlens.operators import sketches as SK


def test_pages_follow_the_order_and_open_few_files(spark, tmp_path):
    df = spark.range(1003).select(F.when(F.col("id") % 5 > 0, (F.col("id") * 7919) % 1003).alias("a"), "id").repartition(6)
    order = ["a", "id"]
    expected = sorted(((r["a"], r["id"]) for r in df.collect()), key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    d = P.write_page_directory(df, order, 40, file_rows=100, path=str(tmp_path / "pages"))
    assert d.total == 1003 and d.max_pages == 26
    got = []
    for p in range(1, 27):
        rows, info = d.page(p)
        assert 1 <= len(d.files(p)) <= 2 and info["page"] == p
        got += [(r["a"], r["id"]) for r in rows.collect()]
    assert got == expected
    assert d.page(0)[1]["page"] == 1 and d.page(99)[1]["page"] == 26 and d.page(None)[1]["page"] == 1
    again = P.open_page_directory(spark, d.path, 100)
    assert again.max_pages == 11 and again.page(11)[0].count() == 3
    assert d.page(26)[1]["page_info"] == "Page 26 of 26 · 1003 results"


def test_every_page_reads_as_many_rows(spark):
    df = spark.range(20_000).withColumn("text", F.repeat(F.lit("x"), 20))
    d = P.write_page_directory(df, ["id"], 40, file_rows=1000)
    reads = [sum(spark.read.parquet(f).count() for f in d.files(p)) for p in (1, 250, 490)]
    assert max(reads) <= 2000


def test_empty_listing_and_ties(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a int, b int")
    d = P.write_page_directory(df, ["a"], 2)
    assert [r["a"] for r in d.page(1)[0].collect()] == [2, None] and d.page(2)[0].count() == 1
    none = P.write_page_directory(df.limit(0), ["a"], 2)
    assert none.total == 0 and none.max_pages == 1 and none.page(3)[0].count() == 0
    with pytest.raises(ValueError):
        P.write_page_directory(df.withColumnRenamed("b", "_place"), ["a"])


def test_roll_up_stays_within_the_bounds(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        (F.col("id") % 7).alias("y"), (F.col("id") % 20_011).alias("who"), ((F.col("id") * 7919) % 10_007).alias("v"))
    cube = SK.sketch_cube(df, ["k", "y"], ["who"], ["v"])
    for keys in (["k"], ["y"], []):
        got = SK.estimates(SK.roll_up(cube, keys))
        exact = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.count_distinct("who").alias("d"), F.percentile("v", 0.49).alias("lo"))
        pairs = [(g, exact.collect()[0]) for g in got.collect()] if not keys else got.join(exact, keys).collect()
        for row in pairs:
            r = {**row[0].asDict(), **row[1].asDict()} if isinstance(row, tuple) and not keys else row.asDict()
            assert r["n"] == r["m"]
            assert abs(r["distinct_who"] - r["d"]) <= 4 * SK.distinct_error() * r["d"]
    total = SK.estimates(SK.roll_up(cube, [])).first()
    rank = df.filter(F.col("v") <= total["values_v"]).count() / 60_000
    assert abs(rank - 0.5) < 3 * SK.rank_error()


def test_sketches_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, None), (None, "x", 1.0)], "k string, who string, v double")
    got = {r["k"]: r for r in SK.estimates(SK.sketch_cube(df, ["k"], ["who"], ["v"])).collect()}
    assert got["a"]["n"] == 2 and got["a"]["distinct_who"] == 0 and got["a"]["values_v"] is None
    assert got[None]["distinct_who"] == 1 and got[None]["values_v"] == 1.0
    assert SK.sketch_cube(df.limit(0), ["k"], ["who"], ["v"]).count() == 0
