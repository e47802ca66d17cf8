"""Faceted search and pagination."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised

ALL = "All"


def text_match(cols: Sequence[str], term: str, literal: bool = False) -> Column:
    """Lower-cased ``term`` found in any of ``cols`` (lower-cased). The term is
    a regular expression, as in the reference; ``literal=True`` matches a plain substring."""
    t = term.lower()
    cond = None
    for c in cols:
        s = F.lower(F.col(c))
        m = s.contains(F.lit(t)) if literal else s.rlike(t)
        m = F.coalesce(m, F.lit(False))
        cond = m if cond is None else cond | m
    return cond


def facet_filter(df: DataFrame, facets: dict[str, object], all_value: str = ALL) -> DataFrame:
    """Equality facets; a missing value or the 'All' sentinel means no filter."""
    for col, v in facets.items():
        if v is None or v == all_value or v == "":
            continue
        df = df.filter(F.col(col) == F.lit(v))
    return df


def contains_facet(df: DataFrame, col: str, value: str | None, token_sep: str | None = None) -> DataFrame:
    """Literal substring facet; null never matches (so 'Niger' also hits 'Nigeria').
    With ``token_sep`` the value must equal one delimited token instead."""
    if not value or value == ALL:
        return df
    if token_sep:
        return df.filter(F.coalesce(F.array_contains(F.split(F.col(col), token_sep), value), F.lit(False)))
    return df.filter(F.coalesce(F.col(col).contains(F.lit(value)), F.lit(False)))


def display_country(nationality: str = "nationality", country: str = "birth_country") -> Column:
    """Nationality, else birth country ('' counts as missing), else 'Unknown'."""
    return F.coalesce(F.col(nationality), F.nullif(F.col(country), F.lit("")), F.lit("Unknown"))


def page_info(info: dict) -> str:
    """The gallery's status line (F9s)."""
    return f"Page {info['page']} of {info['max_pages']} · {info['total']} results"


def page_count(total: int, page_size: int) -> int:
    return max(1, math.ceil(total / page_size))


def paginate(df: DataFrame, order: Sequence[Column | str], page: int, page_size: int = 40) -> tuple[DataFrame, dict]:
    """Clamp ``page`` to [1, max_pages] and return that slice in ``order``.

    The matching rows are written once; their count (the page information) and the
    slice, a top-(offset+limit) sort (``TakeOrderedAndProject`` with offset), read
    them. For deep pages use ``page_after``."""
    df = materialised(df)
    total = df.count()
    max_pages = page_count(total, page_size)
    p = min(max(1, int(page or 1)), max_pages)
    keys = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    rows = df.orderBy(*keys).offset((p - 1) * page_size).limit(page_size)
    return rows, {"page": p, "max_pages": max_pages, "total": total}


def page_after(df: DataFrame, order: Sequence[str], last_key: Sequence | None, page_size: int = 40) -> DataFrame:
    """O7 deep-page variant (keyset pagination): the ``page_size`` rows that follow
    ``last_key`` in the order of ``order`` (ascending, nulls last). Each task keeps
    only ``page_size`` candidates, however deep the page is; ``offset`` would keep
    offset + page_size."""
    f = df
    if last_key is not None:
        after = F.lit(False)
        # lexicographic "behind" on the key tuple; null is behind every value, nothing is behind null
        for i, (c, v) in enumerate(zip(order, last_key, strict=True)):
            if v is None:
                continue
            same = F.lit(True)
            for cc, vv in zip(order[:i], last_key[:i], strict=True):
                same = same & F.col(cc).eqNullSafe(F.lit(vv))
            after = after | (same & ((F.col(c) > F.lit(v)) | F.col(c).isNull()))
        f = f.filter(after)
    return f.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(page_size)


def gallery(
    df: DataFrame, search: str | None = None, category: str | None = None, decade: int | None = None,
    birth_country: str | None = None, nationality: str | None = None, page: int = 1, page_size: int = 40,
    literal: bool = False,
) -> DataFrame:
    """Filtered, paginated cards with "page p of m · n results" columns."""
    f = df
    if search:
        f = f.filter(text_match(["name", "motivation"], search, literal))
    f = facet_filter(f, {"category": category, "decade": decade, "birth_country": birth_country})
    if "nationality" in f.columns:
        f = contains_facet(f, "nationality", nationality)
    nat = "nationality" if "nationality" in f.columns else None
    cards = f.select(
        "award_year", "id", "category", "name", "motivation",
        (display_country(nat) if nat else F.coalesce(F.nullif(F.col("birth_country"), F.lit("")), F.lit("Unknown")))
        .alias("display_country"),
    )
    order = ["award_year", "id", "category", "name", "motivation", "display_country"]
    rows, info = paginate(cards, order, page, page_size)
    return rows.select(
        "name", "category", "award_year", "display_country", "motivation",
        F.lit(info["page"]).alias("page"), F.lit(info["max_pages"]).alias("max_pages"),
        F.lit(info["total"]).cast("long").alias("total_results"),
        F.lit(page_info(info)).alias("page_info"),
        F.upper(F.col("category")).alias("category_label"),  # F3s: the card's category line
    )


def age_scatter(df: DataFrame, category: str | None = None, all_value: str = "All Categories") -> DataFrame:
    """Person points (year, age) with an optional single-category filter."""
    base = df.filter(~F.col("is_org") & F.col("age_at_award").isNotNull())
    base = facet_filter(base, {"category": category}, all_value)
    return base.select("name", "award_year", "age_at_award", "category", "birth_country")
