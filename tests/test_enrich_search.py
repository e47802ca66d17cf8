"""Enrichment, search and ordered operators (FIXTURES §2.4)."""

import pytest
from pyspark.sql import functions as F

from honorlens.operators import enrich as J
from honorlens.operators import search as Q
from honorlens.operators import windows as W


def test_j1_ordered_labels_with_fallback(spark):
    keys = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "entity_id string")
    claims = spark.createDataFrame([("e1", 1, "Q2"), ("e1", 2, "Q1"), ("e1", 3, None)], "entity_id string, pos int, value string")
    labels = spark.createDataFrame([("Q1", "Xland")], "qid string, label string")
    out = {r["entity_id"]: r["nationality"] for r in J.ordered_labels(keys, claims, labels).collect()}
    assert out == {"e1": "Q2, Xland", "e2": None, "e3": None}


def test_j3_chain_and_cycle(spark):
    starts = spark.createDataFrame([("a",), ("x",), ("z",), ("self",), ("solo",)], "title string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("self", "self"), ("n", None)],
                                  "`from` string, `to` string")
    out = {r["start"]: r for r in J.resolve_aliases(starts, edges).collect()}
    assert out["a"]["final"] == "c" and out["a"]["depth"] == 2 and out["a"]["resolved"]
    assert out["solo"]["final"] == "solo" and out["solo"]["depth"] == 0
    for t in ("x", "z", "self"):
        assert out[t]["resolved"] is False and out[t]["final"] is None and out[t]["depth"] is None


@pytest.mark.parametrize("n,step", [(37, 5), (100, 1), (10_000, 999)])
def test_j3_long_chain_matches_walk(spark, n, step):
    edges = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(n)], "`from` string, `to` string")
    starts = spark.createDataFrame([(f"t{i}",) for i in range(0, n, step)], "title string")
    out = {r["start"]: (r["final"], r["depth"], r["resolved"]) for r in J.resolve_aliases(starts, edges).collect()}
    assert len(out) == len(range(0, n, step)) and all(v == (f"t{n}", n - int(k[1:]), True) for k, v in out.items())


def test_j3_last_edge_of_several_counts(spark):
    edges = spark.createDataFrame([("a", "z", 1), ("a", "b", 2)], "`from` string, `to` string, nth int")
    starts = spark.createDataFrame([("a",)], "title string")
    assert J.resolve_aliases(starts, edges, order="nth").first()["final"] == "b"


def test_j4_inner_lookup_drops_unknown(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "country string, n int")
    dim = spark.createDataFrame([("A", 1.0, 2.0)], "country string, lat double, lon double")
    assert [r["country"] for r in J.lookup(df, dim, "country", "country").collect()] == ["A"]


def test_p15_regex_and_literal(spark):
    df = spark.createDataFrame([("abc", "")], "name string, motivation string")
    assert df.filter(Q.text_match(["name", "motivation"], "a.c")).count() == 1
    assert df.filter(Q.text_match(["name", "motivation"], "a.c", literal=True)).count() == 0
    assert df.filter(Q.text_match(["name"], "(", literal=True)).count() == 0
    with pytest.raises(Exception):
        df.filter(Q.text_match(["name"], "(")).count()


def test_p17_substring_vs_token(spark):
    df = spark.createDataFrame([("Nigeria",), (None,)], "nationality string")
    assert Q.contains_facet(df, "nationality", "Niger").count() == 1
    assert Q.contains_facet(df, "nationality", "Niger", token_sep=", ").count() == 0


def test_o7_pagination_clamps(spark):
    df = spark.range(81).withColumnRenamed("id", "k")
    rows, info = Q.paginate(df, ["k"], page=3)
    assert info == {"page": 3, "max_pages": 3, "total": 81} and [r["k"] for r in rows.collect()] == [80]
    _, info = Q.paginate(df, ["k"], page=9)
    assert info["page"] == 3
    _, info = Q.paginate(df.filter("k < 0"), ["k"], page=1)
    assert info == {"page": 1, "max_pages": 1, "total": 0}


def test_running_total_matches_brute_force(spark):
    import random

    random.seed(7)
    vals = [(random.randint(0, 30), random.randint(1, 5)) for _ in range(300)]
    df = spark.createDataFrame(vals, "k int, v int").groupBy("k").agg(F.sum("v").alias("v"))
    got = {r["k"]: r["cum"] for r in W.running_total(df, ["k"], "v", "cum", n_parts=4).collect()}
    acc, want = 0, {}
    for k in sorted({k for k, _ in vals}):
        acc += sum(v for kk, v in vals if kk == k)
        want[k] = acc
    assert got == want


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("n_parts", [None, 8])
def test_running_total_over_many_keys_with_more_columns(spark, n_parts, aqe):
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        n = 300_000
        df = spark.range(n, numPartitions=6).select(
            F.expr(f"(id * 7919) % {n}").alias("k"), F.expr("id % 5 + 1").alias("v"), F.concat(F.lit("x"), "id").alias("more"))
        got = W.running_total(df, ["k"], "v", "cum", n_parts=n_parts)
        from pyspark.sql import Window

        want = df.withColumn("cum", F.sum("v").over(Window.orderBy("k")))
        assert got.count() == n
        assert got.select("k", "v", "more", "cum").exceptAll(want.select("k", "v", "more", "cum")).isEmpty()
        rows = [r[0] for r in df.select("k").collect()]
        assert W.distributed_quantile(df.withColumn("k", F.col("k").cast("double")), "k").first()[0] == (min(rows) + max(rows)) / 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ordinal_is_dense_1_based(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",)], "k string")
    assert {r["k"]: r["ord"] for r in W.ordinal(df, ["k"]).collect()} == {"a": 1, "b": 2, "c": 3}


def test_keyset_pages_cover_offset_pages(spark):
    rows = [(y, i % 7, f"n{i}") for i, y in enumerate([3, 1, 2] * 30)]
    df = spark.createDataFrame(rows, "y int, k int, name string")
    order = ["y", "k", "name"]
    seen, last = [], None
    while True:
        page = [tuple(r) for r in Q.page_after(df, order, last, 40).collect()]
        if not page:
            break
        seen += page
        last = page[-1]
    assert seen == sorted(rows)


def test_display_rounding_half_even(spark):
    from honorlens.functions.scalar import round_half_even

    df = spark.createDataFrame([(0.25, 2.5)], "a double, b double")
    r = round_half_even(df, {"a": 1, "b": 0}).collect()[0]
    assert r["a"] == 0.2 and r["b"] == 2.0


def test_running_total_aqe_sized_partitions(spark):
    rows = [(k, (k * 7) % 5 + 1) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r["k"]: r["cum"] for r in W.running_total(df, ["k"], "v", "cum").collect()}
    acc, want = 0, {}
    for k, v in rows:
        acc += v
        want[k] = acc
    assert got == want


def test_j3_slug_underscores_become_spaces(spark):
    starts = spark.createDataFrame([("New_York",)], "title string")
    edges = spark.createDataFrame([("New York", "NYC")], "`from` string, `to` string")
    r = J.resolve_aliases(starts, edges).collect()[0]
    assert (r["start"], r["final"], r["depth"], r["resolved"]) == ("New_York", "NYC", 1, True)


def test_p24_display_country_fallbacks(spark):
    df = spark.createDataFrame([("A, B", "X"), (None, "X"), (None, ""), (None, None)],
                               "nationality string, birth_country string")
    got = [r[0] for r in df.select(Q.display_country()).collect()]
    assert got == ["A, B", "X", "Unknown", "Unknown"]


def test_p16_all_sentinel_means_no_filter(spark):
    df = spark.createDataFrame([("x", 1990), ("y", 2000)], "category string, decade int")
    assert Q.facet_filter(df, {"category": "All", "decade": None}).count() == 2
    assert Q.facet_filter(df, {"category": "x", "decade": "All"}).count() == 1
    assert Q.facet_filter(df, {"decade": 2000}).collect()[0]["category"] == "y"
