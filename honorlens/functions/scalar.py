"""Column-expression helpers (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_partial_date(c: Column | str) -> Column:
    """P5: '1943-00-00' → 1943-01-01; tries y-M-d, y-M, y; null for null, '', 'None', bad dates.

    Single-letter patterns accept both '1943-5-1' and '1943-05-01'."""
    s = F.replace(F.col(c) if isinstance(c, str) else c, F.lit("-00"), F.lit("-01"))
    s = F.when(s.isNull() | (s == "") | (s == "None"), F.lit(None)).otherwise(s)
    return F.coalesce(
        F.try_to_date(s, "y-M-d"), F.try_to_date(s, "y-M"), F.try_to_date(s, "y")
    )


def age_at(birth_date: Column, award_year: Column) -> Column:
    """Award year minus birth year, null-safe, bad years → null."""
    return award_year.try_cast("int") - F.year(birth_date)


def lifespan_years(birth_date: Column, death_date: Column, digits: int = 1) -> Column:
    """Days / 365.25 rounded (the input dates never produce a .x5 tie)."""
    return F.round(F.datediff(death_date, birth_date) / F.lit(365.25), digits)


def bucket(c: Column, width: int) -> Column:
    """floor(c / width) * width, kept as int."""
    return (F.floor(c / F.lit(width)) * F.lit(width)).cast("int")


def capitalized(c: Column) -> Column:
    """F7s: first letter upper-case, the rest lower-case (Python ``str.capitalize``)."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def pct_label(v: Column, threshold: float = 5.0) -> Column:
    """F8s: '12%' when v >= threshold, else ''. Rounds half to even, as the
    reference's ``f"{v:.0f}%"`` does (Java's ``%.0f`` would round half up)."""
    return F.when(v >= threshold, F.concat(F.bround(v, 0).cast("long").cast("string"), F.lit("%"))).otherwise(F.lit(""))


def intensity_class(share: Column) -> Column:
    """F17s: four buckets of a 0..1 share (thresholds are the reference's)."""
    # Thresholds 0.5, 0.2, 0.05.
    return (
        F.when(share > 0.5, F.lit("high"))
        .when(share > 0.2, F.lit("upper"))
        .when(share > 0.05, F.lit("middle"))
        .otherwise(F.lit("low"))
    )


def bubble_size(n: Column, n_max: Column, base: float = 6.0, span: float = 40.0) -> Column:
    """F18s: linear rescale base + n / max * span."""
    return F.lit(base) + n / n_max * F.lit(span)


def sphere_xyz(lat: Column, lon: Column, r: float = 1.0) -> tuple[Column, Column, Column]:
    """F13s: latitude/longitude in degrees → unit-sphere coordinates."""
    la, lo = F.radians(lat), F.radians(lon)
    return (F.lit(r) * F.cos(la) * F.cos(lo), F.lit(r) * F.cos(la) * F.sin(lo), F.lit(r) * F.sin(la))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column as an explicit last step (N9); adding 0.0
    turns a rounded -0.0 into 0.0."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def round_half_even(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Display rounding as the reference's ``round(x, n)`` / ``.round(n)``: half to
    even (``bround``), per column."""
    return df.withColumns({c: F.bround(F.col(c), d) for c, d in digits.items() if c in df.columns})


def non_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pandas groupby/crosstab drop null keys; Spark keeps a NULL group."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)
