"""SURVEY §5(c) invariants on the registered queries over the sf0.001 tables."""

from collections import defaultdict

import __spark_entry__ as E
from honorlens.plans.reports import CATEGORY_ORDER
from tests.conftest import SMALL


def _rows(spark, name):
    return [r.asDict() for r in E.queries()[name](spark, SMALL).collect()]


def test_crosstab_sums_equal_row_count(spark):
    total = _rows(spark, "summary_stats")[0]["total_prizes"]
    per_decade = _rows(spark, "prizes_per_decade")
    assert sum(sum(r[c] for c in CATEGORY_ORDER) for r in per_decade) == total
    heat = _rows(spark, "category_decade_heatmap")
    assert sum(r["count"] for r in heat) == total


def test_row_percentages_sum_to_100(spark):
    by_row = defaultdict(float)
    for r in _rows(spark, "category_continent_shares"):
        by_row[r["birth_continent"]] += r["pct"]
    assert by_row and all(abs(v - 100) < 1e-4 for v in by_row.values())


def test_last_running_total_is_row_count(spark):
    total = _rows(spark, "summary_stats")[0]["total_prizes"]
    tl = sorted(_rows(spark, "cumulative_timeline"), key=lambda r: r["award_year"])
    assert tl[-1]["cumulative"] == total == sum(r["count"] for r in tl)


def test_gender_split_consistent_with_gender_by_decade(spark):
    a2 = {r["decade"]: r for r in _rows(spark, "gender_by_decade")}
    c5 = {r["decade"]: r for r in _rows(spark, "gender_split_by_decade")}
    for d, r in c5.items():
        assert (r["female"], r["male"]) == (a2[d]["female"], a2[d]["male"])
        assert a2[d]["total"] >= r["female"] + r["male"]


def test_sankey_values_equal_bar_counts(spark):
    bars = {(r["birth_continent"], r["category"]): r["count"] for r in _rows(spark, "continent_category_bars")}
    links = {(r["birth_continent"], r["category"]): r["value"] for r in _rows(spark, "sankey_links")}
    assert bars == links
