"""Chart-data marts (C1-C16, C25): each returns a DataFrame; drawing is not built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bubble_size, intensity_class, non_null_keys, pct_label, round_doubles, sphere_xyz
from ..operators import enrich as J
from ..operators import groups as G
from ..operators import windows as W
from ..sources.dims import ABBREVIATIONS_SQL, CENTROIDS_SQL, country_centroids, name_abbreviations
from ..sources.facts import award_facts, order_facts, persons
from .oracle_sql import with_fact
from .registry import query


# ---------------------------------------------------------------- operators

def continent_category(df: DataFrame, row: str = "birth_continent", col: str = "category",
                       weight: str | None = None, series_order: Sequence[str] = ()) -> DataFrame:
    """Counts by (row, col), rows ordered by their total ascending (``row_order``)."""
    counts = G.count_by(df, [row, col], "count", weight)
    totals = counts.groupBy(row).agg(F.sum("count").alias("_total"))
    order = W.ordinal(totals, ["_total", row], "row_order").drop("_total")
    out = counts.join(order, row)
    if series_order:
        out = out.withColumn("series_order", G.fixed_order(col, series_order))  # O6
    return out.orderBy("row_order", col)


def cumulative_timeline(df: DataFrame, key: str = "award_year", weight: str | None = None) -> DataFrame:
    """Rows per key and their running total (aggregate first, W1 after)."""
    yearly = G.count_by(df, [key], "count", weight)
    return W.running_total(yearly, [key], "count", "cumulative").orderBy(key)


def row_shares(df: DataFrame, row: str = "birth_continent", col: str = "category",
               weight: str | None = None) -> DataFrame:
    """Crosstab in long form with % of row total, a label when ≥5 %, row order by total.

    The label rounds half-to-even like the reference's ``f"{v:.0f}%"``."""
    counts = G.count_by(df, [row, col], "count", weight)
    shares = W.share_of_group(counts, [row], "count", "pct")
    totals = counts.groupBy(row).agg(F.sum("count").alias("_total"))
    order = W.ordinal(totals, ["_total", row], "row_order").drop("_total")
    return shares.withColumn("label", pct_label(F.col("pct"))).join(order, row)


def globe_points(df: DataFrame, centroids: DataFrame, key: str = "birth_country", top: int = 5,
                 weight: str | None = None) -> DataFrame:
    """C4: per country: rows, sorted fields, first five names, centroid, bubble size,
    intensity class and whether it is among the ``top`` countries. Countries without
    a centroid are dropped (J4) after the max and the top list are taken, as in the
    reference."""
    base = df.filter(F.col(key).isNotNull())
    counts = G.count_by(base, [key], "n_prizes", weight)
    fields = G.sorted_distinct_join(base, key, "category", "fields")
    notable = G.first_k_distinct(base, key, "name", "notable", k=5)
    ranked = W.top_k(counts, [F.desc("n_prizes"), F.asc(key)], top, "_r")
    top_keys = ranked.select(key, F.lit(True).alias("is_top"))
    scaled = G.share_of_max(counts, "n_prizes", "intensity")
    pts = (
        scaled.join(fields, key).join(notable, key)
        # centroids derive from ``nation``: at most 25 rows at every scale factor
        .join(F.broadcast(centroids), F.col(key) == F.col("country"), "inner").drop("country")
        .join(top_keys, key, "left")
    )
    x, y, z = sphere_xyz(F.col("lat"), F.col("lon"))
    is_top = F.coalesce(F.col("is_top"), F.lit(False))
    return pts.select(
        key, "n_prizes", "fields", "notable", "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"),
        bubble_size(F.col("n_prizes"), F.col("_max")).alias("size"),
        intensity_class(F.col("intensity")).alias("intensity_class"),
        is_top.alias("is_top"),
        F.when(is_top, F.format_string("%s (%d)", F.col(key), F.col("n_prizes"))).otherwise(F.lit("")).alias("label"),
    )


def gender_split(df: DataFrame, row: str = "decade", gender: str = "gender",
                 values: Sequence[str] = ("female", "male"), weight: str | None = None) -> DataFrame:
    """Row × {female, male} counts and female share of female+male."""
    base = df.filter(F.col(gender).isin(*values))
    ct = G.crosstab_counts(base, row, gender, values, weight)
    denom = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return ct.withColumn("female_pct", F.col(values[0]) / denom * 100).orderBy(row)


def box_stats(df: DataFrame, group: str, value: str, whisker: float = 1.5, approx: bool = False,
              distributed: bool = False) -> DataFrame:
    """Quartiles (linear interpolation), whiskers at the most extreme
    points within ``whisker``·IQR, and outlier counts per group. Exact quartiles
    keep a value→count buffer per group; ``distributed=True`` computes the same
    exact quartiles without that buffer (hot groups with many distinct values);
    ``approx=True`` uses a bounded sketch."""
    base = non_null_keys(df.filter(F.col(value).isNotNull()), [group])
    if distributed:
        n = base.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        q = n.join(W.distributed_quantiles(base, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group]), group)
    else:
        quart = (F.percentile_approx(F.col(value).cast("double"), [0.25, 0.5, 0.75], 10000) if approx
                 else F.percentile(value, [0.25, 0.5, 0.75]))
        q = base.groupBy(group).agg(
            quart.alias("_q"), F.count(F.lit(1)).alias("n"),
        ).select(group, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    q = q.withColumn("_lo", F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + whisker * (F.col("q3") - F.col("q1")))
    v = F.col(value)
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    ext = base.join(q.select(group, "_lo", "_hi"), group).groupBy(group).agg(
        F.min(F.when(inside, v)).cast("double").alias("whisker_low"),
        F.max(F.when(inside, v)).cast("double").alias("whisker_high"),
        F.count(F.when(~inside, F.lit(1))).alias("n_outliers"),
    )
    return q.drop("_lo", "_hi").join(ext, group)


def histogram(df: DataFrame, value: str, by: str | None = None, bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max] of the whole column, counted per ``by``."""
    base = df.filter(F.col(value).isNotNull())
    rng = base.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    idx = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    b = G.with_scalar(base, rng).withColumn("bin", idx.cast("int"))
    keys = [by, "bin"] if by else ["bin"]
    if by:
        b = b.filter(F.col(by).isNotNull())
    out = b.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
    )
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return out.select(*keys, (F.col("_lo") + F.col("bin") * w).alias("bin_low"),
                      (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_high"), "count")


def sankey_links(df: DataFrame, src: str = "birth_continent", dst: str = "category",
                 weight: str | None = None) -> DataFrame:
    """Links (source index, target index, value). Sources are numbered in
    sorted order; targets after them, in order of first appearance in the
    (source, target)-sorted rows."""
    flow = G.count_by(df.filter(F.col(src).isNotNull()), [src, dst], "value", weight)
    srcs = W.ordinal(flow.select(src).distinct(), [src], "_s")
    n_src = srcs.agg(F.count(F.lit(1)).alias("_ns"))
    first = flow.groupBy(dst).agg(F.min(src).alias("_first"))
    dsts = W.ordinal(first, ["_first", dst], "_t").drop("_first")
    return G.with_scalar(flow.join(srcs, src).join(dsts, dst), n_src).select(
        src, dst, (F.col("_s") - 1).alias("source"), (F.col("_ns") + F.col("_t") - 1).alias("target"), "value"
    )


def multi_recipients(df: DataFrame, abbreviations: DataFrame, keys: Sequence[str] = ("id", "name")) -> DataFrame:
    """Every row of the id (``keys[0]``) of a repeat recipient (J6) with a short display name."""
    repeat = G.repeat_holders(df, keys).select(keys[0]).distinct()
    rows = J.keep_members(df, repeat, keys[0])  # J6
    named = J.lookup(rows, abbreviations, "name", "name", how="left")  # J5, default = own name below
    return named.select("id", "name", F.coalesce(F.col("abbr"), F.col("name")).alias("display_name"),
                        "award_year", "category")


# ---------------------------------------------------------------- registered queries

@query("continent_category_bars", with_fact("""
, c AS (SELECT birth_continent, category, count(*) AS count FROM fact
        WHERE birth_continent IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
t AS (SELECT birth_continent, row_number() OVER (ORDER BY sum(count), birth_continent) AS row_order
      FROM c GROUP BY birth_continent)
SELECT c.birth_continent, c.category, c.count, t.row_order,
       CAST(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], c.category) AS INTEGER) AS series_order
FROM c JOIN t USING (birth_continent)
""".replace("\n, c AS", "WITH c AS", 1)))
def q_c1(spark, sf_dir):
    """Continent × category bars with row and series order."""
    from .reports import CATEGORY_ORDER

    return continent_category(order_facts(spark, sf_dir), weight="n_items", series_order=CATEGORY_ORDER)


@query("cumulative_timeline", with_fact("""
SELECT award_year, count(*) AS count,
       CAST(sum(count(*)) OVER (ORDER BY award_year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative
FROM fact WHERE award_year IS NOT NULL GROUP BY award_year
"""))
def q_c2(spark, sf_dir):
    """Yearly counts and their running total."""
    return cumulative_timeline(order_facts(spark, sf_dir), weight="n_items")


@query("category_continent_shares", with_fact("""
, c AS (SELECT birth_continent, category, count(*) AS count FROM fact
        WHERE birth_continent IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, count / sum(count) OVER (PARTITION BY birth_continent) * 100 AS pct FROM c),
t AS (SELECT birth_continent, row_number() OVER (ORDER BY sum(count), birth_continent) AS row_order
      FROM c GROUP BY birth_continent)
SELECT s.birth_continent, s.category, s.count, round(s.pct, 6) AS pct,
       CASE WHEN s.pct >= 5 THEN CAST(CAST(round_even(s.pct, 0) AS BIGINT) AS VARCHAR) || '%' ELSE '' END AS label,
       t.row_order
FROM s JOIN t USING (birth_continent)
""".replace("\n, c AS", "WITH c AS", 1)))
def q_c3(spark, sf_dir):
    """C3 / W3 / F8s: row shares with labels."""
    return round_doubles(row_shares(order_facts(spark, sf_dir), weight="n_items"))


@query("globe_points", with_fact(f"""
, {CENTROIDS_SQL},
counts AS (SELECT birth_country, count(*) AS n_prizes FROM fact WHERE birth_country IS NOT NULL GROUP BY 1),
mx AS (SELECT max(n_prizes) AS m FROM counts),
top AS (SELECT birth_country FROM counts ORDER BY n_prizes DESC, birth_country LIMIT 5),
fields AS (SELECT birth_country, string_agg(DISTINCT category, ', ' ORDER BY category) AS fields
           FROM fact WHERE birth_country IS NOT NULL AND category IS NOT NULL GROUP BY 1),
names AS (SELECT DISTINCT birth_country, name FROM fact WHERE birth_country IS NOT NULL AND name IS NOT NULL),
ranked AS (SELECT birth_country, name, row_number() OVER (PARTITION BY birth_country ORDER BY name) AS r,
                  count(*) OVER (PARTITION BY birth_country) AS nd FROM names),
notable AS (SELECT birth_country, string_agg(name, ', ' ORDER BY name) || CASE WHEN max(nd) > 5 THEN '...' ELSE '' END AS notable
            FROM ranked WHERE r <= 5 GROUP BY 1)
SELECT c.birth_country, c.n_prizes, f.fields, n.notable, g.lat, g.lon,
       round(cos(radians(g.lat)) * cos(radians(g.lon)), 6) + 0.0 AS x,
       round(cos(radians(g.lat)) * sin(radians(g.lon)), 6) + 0.0 AS y,
       round(sin(radians(g.lat)), 6) + 0.0 AS z,
       round(6 + c.n_prizes / mx.m * 40, 6) AS size,
       CASE WHEN c.n_prizes / mx.m > 0.5 THEN 'high' WHEN c.n_prizes / mx.m > 0.2 THEN 'upper'
            WHEN c.n_prizes / mx.m > 0.05 THEN 'middle' ELSE 'low' END AS intensity_class,
       c.birth_country IN (SELECT birth_country FROM top) AS is_top,
       CASE WHEN c.birth_country IN (SELECT birth_country FROM top)
            THEN c.birth_country || ' (' || CAST(c.n_prizes AS VARCHAR) || ')' ELSE '' END AS label
FROM counts c CROSS JOIN mx JOIN fields f USING (birth_country) JOIN notable n USING (birth_country)
JOIN centroids g ON g.country = c.birth_country
""".replace("\n, centroids AS", "WITH centroids AS", 1)))
def q_c4(spark, sf_dir):
    """C4 / J4 / F13s / F17s / F18s / O4: globe points."""
    return round_doubles(globe_points(order_facts(spark, sf_dir), country_centroids(spark, sf_dir), weight="n_items"))


@query("gender_split_by_decade", with_fact("""
SELECT decade, count(*) FILTER (WHERE gender = 'female') AS female, count(*) FILTER (WHERE gender = 'male') AS male,
       round(count(*) FILTER (WHERE gender = 'female')
             / (count(*) FILTER (WHERE gender = 'female') + count(*) FILTER (WHERE gender = 'male')) * 100, 6) AS female_pct
FROM persons WHERE gender IN ('female', 'male') AND decade IS NOT NULL GROUP BY decade
"""))
def q_c5_c6(spark, sf_dir):
    """Female and male counts and share per decade."""
    return round_doubles(gender_split(persons(order_facts(spark, sf_dir)), weight="n_items"))


def _box_sql(value: str, src: str) -> str:
    return with_fact(f"""
, b AS (SELECT category, {value} AS v FROM {src} WHERE {value} IS NOT NULL AND category IS NOT NULL),
q AS (SELECT category, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM b GROUP BY category),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.category, f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(CAST(min(v) FILTER (WHERE v >= lo AND v <= hi) AS DOUBLE), 6) AS whisker_low,
       round(CAST(max(v) FILTER (WHERE v >= lo AND v <= hi) AS DOUBLE), 6) AS whisker_high,
       count(*) FILTER (WHERE NOT (v >= lo AND v <= hi)) AS n_outliers
FROM b JOIN f USING (category) GROUP BY f.category, f.n, f.q1, f.median, f.q3
""".replace("\n, b AS", "WITH b AS", 1))


@query("age_box_by_category", _box_sql("age_at_award", "persons"))
def q_c7(spark, sf_dir):
    """Age quartiles, whiskers and outliers per category."""
    return round_doubles(box_stats(persons(award_facts(spark, sf_dir)), "category", "age_at_award"))


@query("prize_box_by_category", _box_sql("prize_amount", "fact"))
def q_prize_box(spark, sf_dir):
    """C7 with exact quartiles of a column of many distinct values: no buffer of values per group."""
    return round_doubles(box_stats(award_facts(spark, sf_dir), "category", "prize_amount", distributed=True))


@query("lifespan_box_by_category", _box_sql("lifespan", "persons"))
def q_c9(spark, sf_dir):
    """Lifespan quartiles, whiskers and outliers per category."""
    return round_doubles(box_stats(persons(award_facts(spark, sf_dir)), "category", "lifespan"))


@query("age_scatter_points", with_fact("""
SELECT name, award_year, age_at_award, category, birth_country FROM persons
WHERE age_at_award IS NOT NULL AND category = '2-HIGH'
"""))
def q_c8(spark, sf_dir):
    """Age scatter points for one category."""
    from ..operators.search import age_scatter
    return age_scatter(award_facts(spark, sf_dir), category="2-HIGH")


@query("age_histogram_by_gender", with_fact("""
, b AS (SELECT gender, age_at_award AS v FROM persons WHERE age_at_award IS NOT NULL),
r AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM b),
x AS (SELECT gender, lo, hi, CAST(CASE WHEN (hi - lo) / 40 > 0 THEN least(floor((v - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS INTEGER) AS bin
      FROM b CROSS JOIN r WHERE gender IS NOT NULL)
SELECT gender, bin, round(lo + bin * ((hi - lo) / 40), 6) AS bin_low, round(lo + (bin + 1) * ((hi - lo) / 40), 6) AS bin_high,
       count(*) AS count
FROM x GROUP BY gender, bin, lo, hi
""".replace("\n, b AS", "WITH b AS", 1)))
def q_c10(spark, sf_dir):
    """40-bin age histogram by gender."""
    return round_doubles(histogram(persons(award_facts(spark, sf_dir)), "age_at_award", "gender", 40))


@query("category_decade_heatmap", with_fact("""
SELECT category, decade, count(*) AS count FROM fact WHERE category IS NOT NULL AND decade IS NOT NULL GROUP BY 1, 2
"""))
def q_c11(spark, sf_dir):
    """C11: category × decade counts."""
    return G.count_by(order_facts(spark, sf_dir), ["category", "decade"], "count", weight="n_items")


@query("sankey_links", with_fact("""
, flow AS (SELECT birth_continent, category, count(*) AS value FROM fact
           WHERE birth_continent IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
s AS (SELECT birth_continent, row_number() OVER (ORDER BY birth_continent) - 1 AS source FROM (SELECT DISTINCT birth_continent FROM flow)),
t AS (SELECT category, row_number() OVER (ORDER BY min(birth_continent), category) - 1 AS t FROM flow GROUP BY category)
SELECT f.birth_continent, f.category, s.source, (SELECT count(*) FROM s) + t.t AS target, f.value
FROM flow f JOIN s USING (birth_continent) JOIN t USING (category)
""".replace("\n, flow AS", "WITH flow AS", 1)))
def q_c13(spark, sf_dir):
    """Sankey links with node indices."""
    return sankey_links(order_facts(spark, sf_dir), weight="n_items")


@query("multi_recipients", with_fact(f"""
, {ABBREVIATIONS_SQL},
rep AS (SELECT id, name FROM fact WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY id, name HAVING count(*) > 1)
SELECT f.id, f.name, coalesce(a.abbr, f.name) AS display_name, f.award_year, f.category
FROM fact f LEFT JOIN abbreviations a ON a.name = f.name
WHERE f.id IN (SELECT id FROM rep)
""".replace("\n, abbreviations AS", "WITH abbreviations AS", 1)))
def q_c25(spark, sf_dir):
    """Rows of repeat recipients with display names."""
    return multi_recipients(award_facts(spark, sf_dir), name_abbreviations(spark, sf_dir))


@query("age_density_by_category", with_fact("""
, b AS (SELECT category, age_at_award AS v FROM persons WHERE age_at_award IS NOT NULL),
r AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM b),
x AS (SELECT category, lo, hi, CAST(CASE WHEN (hi - lo) / 40 > 0 THEN least(floor((v - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS INTEGER) AS bin
      FROM b CROSS JOIN r WHERE category IS NOT NULL)
SELECT category, bin, round(lo + bin * ((hi - lo) / 40), 6) AS bin_low, round(lo + (bin + 1) * ((hi - lo) / 40), 6) AS bin_high,
       count(*) AS count
FROM x GROUP BY category, bin, lo, hi
""".replace("\n, b AS", "WITH b AS", 1)))
def q_c7_density(spark, sf_dir):
    """C7 (density part): binned age distribution per category — the violin's
    KDE is drawn in the browser by the reference; the bins are its data."""
    return round_doubles(histogram(persons(award_facts(spark, sf_dir)), "age_at_award", "category", 40))
