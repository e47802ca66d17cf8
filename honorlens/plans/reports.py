"""Registered report queries (A1-A27) over the bound fact, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import round_doubles
from ..operators import groups as G
from ..operators import sketches as SK
from ..session import materialised
from ..sources.facts import award_facts, order_facts, persons
from .oracle_sql import with_fact
from .registry import query

# The category axis order of the binding.
CATEGORY_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PERSON_GENDERS = ["female", "male", "other"]


def _cat_counts_sql(src: str, row: str) -> str:
    cols = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS \"{c}\"" for c in CATEGORY_ORDER)
    return with_fact(
        f"SELECT {row}, {cols} FROM {src} WHERE {row} IS NOT NULL AND category IS NOT NULL GROUP BY {row}"
    )


@query("descriptive_by_category", with_fact("""
SELECT category,
       count(id) AS count,
       count(DISTINCT id) AS unique_laureates,
       round(avg(age_at_award), 6) AS avg_age,
       round(median(age_at_award), 6) AS median_age,
       round(stddev_samp(age_at_award), 6) AS std_age,
       min(age_at_award) AS min_age,
       max(age_at_award) AS max_age,
       round(avg(CASE WHEN gender = 'female' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS pct_female,
       round(avg(lifespan), 6) AS avg_lifespan
FROM persons WHERE category IS NOT NULL GROUP BY category
"""))
def q_descriptive(spark, sf_dir):
    """A1: per-category descriptive statistics of persons."""
    return round_doubles(G.descriptive_by_group(persons(award_facts(spark, sf_dir))))


@query("gender_by_decade", with_fact("""
SELECT decade,
       count(*) FILTER (WHERE gender = 'female') AS female,
       count(*) FILTER (WHERE gender = 'male') AS male,
       count(*) FILTER (WHERE gender = 'other') AS other,
       count(*) AS total,
       round(count(*) FILTER (WHERE gender = 'female') / count(*) * 100, 6) AS female_pct
FROM persons WHERE decade IS NOT NULL AND gender IS NOT NULL GROUP BY decade
"""))
def q_gender_by_decade(spark, sf_dir):
    """A2: decade × gender counts with female share of all genders."""
    return round_doubles(G.gender_by_decade(persons(order_facts(spark, sf_dir)), values=PERSON_GENDERS, weight="n_items"))


@query("country_rankings", with_fact("""
SELECT birth_country, count(id) AS count, count(DISTINCT category) AS categories
FROM fact WHERE birth_country IS NOT NULL GROUP BY birth_country
ORDER BY count DESC, birth_country LIMIT 20
"""))
def q_country_rankings(spark, sf_dir):
    """A3: top 20 birth countries by rows, with distinct categories."""
    return G.top_groups(order_facts(spark, sf_dir), top_n=20, weight="n_items")


@query("lifespan_by_category", with_fact("""
SELECT category, round(avg(lifespan), 6) AS avg_lifespan, round(median(lifespan), 6) AS median_lifespan,
       count(id) AS count
FROM persons WHERE lifespan IS NOT NULL AND category IS NOT NULL GROUP BY category
"""))
def q_lifespan(spark, sf_dir):
    """Lifespan mean/median/count per category."""
    return round_doubles(G.lifespan_by_group(persons(award_facts(spark, sf_dir))))


@query("prizes_per_decade", _cat_counts_sql("fact", "decade"))
def q_prizes_per_decade(spark, sf_dir):
    """Decade × category counts."""
    return G.counts_per_bucket(order_facts(spark, sf_dir), "decade", "category", CATEGORY_ORDER, weight="n_items")


@query("summary_stats", with_fact("""
SELECT count(*) AS total_prizes,
       count(DISTINCT id) AS unique_laureates,
       count(DISTINCT CASE WHEN NOT is_org THEN id END)
         + max(CASE WHEN NOT is_org AND id IS NULL THEN 1 ELSE 0 END) AS persons,
       count(DISTINCT CASE WHEN is_org THEN id END) AS organizations,
       count(DISTINCT category) AS n_categories,
       (SELECT string_agg(category, ', ' ORDER BY category) FROM (SELECT DISTINCT category FROM fact WHERE category IS NOT NULL)) AS categories,
       min(award_year) AS year_min,
       max(award_year) AS year_max,
       count(DISTINCT birth_country) AS countries,
       round(avg(CASE WHEN NOT is_org THEN age_at_award END), 6) AS avg_age,
       round(count(*) FILTER (WHERE NOT is_org AND gender = 'female') * 100.0::DOUBLE
             / count(*) FILTER (WHERE NOT is_org), 6) AS female_pct
FROM fact
"""))
def q_summary(spark, sf_dir):
    """Headline metrics in one pass."""
    return round_doubles(G.summary_stats(award_facts(spark, sf_dir)))


@query("top_country", with_fact("""
SELECT birth_country, count(*) AS n FROM fact WHERE birth_country IS NOT NULL
GROUP BY birth_country ORDER BY n DESC, birth_country LIMIT 1
"""))
def q_top_country(spark, sf_dir):
    """The country with most rows."""
    return G.argmax_group(order_facts(spark, sf_dir), "birth_country", weight="n_items")


@query("youngest_oldest", with_fact("""
, b AS (SELECT * FROM persons WHERE age_at_award IS NOT NULL)
SELECT (SELECT name FROM b ORDER BY age_at_award, award_year, id, name LIMIT 1) AS youngest_name,
       (SELECT min(age_at_award) FROM b) AS youngest_age,
       (SELECT name FROM b ORDER BY age_at_award DESC, award_year, id, name LIMIT 1) AS oldest_name,
       (SELECT max(age_at_award) FROM b) AS oldest_age
""".replace("\n, b AS", "WITH b AS", 1)))
def q_youngest_oldest(spark, sf_dir):
    """Youngest and oldest person rows."""
    return G.extreme_rows(persons(award_facts(spark, sf_dir)))


@query("repeat_recipients", with_fact("""
SELECT id, name, count(*) AS prizes FROM fact WHERE id IS NOT NULL AND name IS NOT NULL
GROUP BY id, name HAVING count(*) > 1
"""))
def q_repeat(spark, sf_dir):
    """Recipients with more than one row."""
    return G.repeat_holders(order_facts(spark, sf_dir), weight="n_items")


@query("prize_amount_trend", with_fact("""
SELECT award_year, round(avg(prize_amount_adjusted), 6) AS avg_amount,
       round(max(prize_amount_adjusted), 6) AS max_amount
FROM fact WHERE prize_amount_adjusted IS NOT NULL AND award_year IS NOT NULL GROUP BY award_year
"""))
def q_amount_trend(spark, sf_dir):
    """Mean and max adjusted amount per year."""
    return round_doubles(G.mean_max_by(award_facts(spark, sf_dir)))


@query("top_country_by_category", with_fact("""
SELECT category, top_birth_country, top_birth_country_count FROM (
  SELECT category, birth_country AS top_birth_country, count(*) AS top_birth_country_count,
         row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, birth_country) AS r
  FROM persons WHERE birth_country IS NOT NULL GROUP BY category, birth_country) WHERE r = 1
"""))
def q_mode(spark, sf_dir):
    """Most frequent birth country per category."""
    return G.mode_by(persons(order_facts(spark, sf_dir)), "category", "birth_country", weight="n_items")


@query("category_hierarchy", with_fact("""
SELECT birth_continent, birth_country, category, count(*) AS count,
       CAST(GROUPING(birth_continent, birth_country, category) AS INTEGER) AS level_id
FROM fact WHERE birth_continent IS NOT NULL
GROUP BY ROLLUP (birth_continent, birth_country, category)
"""))
def q_hierarchy(spark, sf_dir):
    """Continent > country > category rollup."""
    return G.hierarchy_counts(order_facts(spark, sf_dir), weight="n_items")


@query("facet_values", with_fact("""
SELECT DISTINCT facet, value FROM (
  SELECT 'category' AS facet, CAST(category AS VARCHAR) AS value FROM fact WHERE category IS NOT NULL
  UNION ALL SELECT 'decade', CAST(decade AS VARCHAR) FROM fact WHERE decade IS NOT NULL
  UNION ALL SELECT 'birth_country', CAST(birth_country AS VARCHAR) FROM fact WHERE birth_country IS NOT NULL)
"""))
def q_facets(spark, sf_dir):
    """Sorted distinct facet values."""
    return G.facet_values(order_facts(spark, sf_dir))


@query("country_fields_notables", with_fact("""
, names AS (SELECT DISTINCT birth_country, name FROM fact WHERE birth_country IS NOT NULL AND name IS NOT NULL),
ranked AS (SELECT birth_country, name, row_number() OVER (PARTITION BY birth_country ORDER BY name) AS r,
                  count(*) OVER (PARTITION BY birth_country) AS nd FROM names)
SELECT f.birth_country, f.fields,
       n.names || CASE WHEN n.nd > 5 THEN '...' ELSE '' END AS notable
FROM (SELECT birth_country, string_agg(DISTINCT category, ', ' ORDER BY category) AS fields
      FROM fact WHERE birth_country IS NOT NULL AND category IS NOT NULL GROUP BY birth_country) f
JOIN (SELECT birth_country, string_agg(name, ', ' ORDER BY name) AS names, max(nd) AS nd
      FROM ranked WHERE r <= 5 GROUP BY birth_country) n USING (birth_country)
""".replace("\n, names AS", "WITH names AS", 1)))
def q_country_fields(spark, sf_dir):
    """Sorted fields and first five names per country."""
    fact = order_facts(spark, sf_dir).filter(F.col("birth_country").isNotNull())
    fields = G.sorted_distinct_join(fact, "birth_country", "category", "fields")
    notable = G.first_k_distinct(fact, "birth_country", "name", "notable", k=5)
    return fields.join(notable, "birth_country")


ROLL_UPS = [("category",), ("award_year",), ("birth_country",), ()]


def _roll_up_sql() -> str:
    parts = []
    for keys in ROLL_UPS:
        label = f"CAST({keys[0]} AS VARCHAR)" if keys else "'all'"
        name = keys[0] if keys else "all"
        parts.append(f"SELECT '{name}' AS level, {label} AS member, count(*) AS n, count(DISTINCT id) AS distinct_ids, "
                     f"TRUE AS distinct_within_bound, TRUE AS median_within_bound FROM persons" + (f" GROUP BY {keys[0]}" if keys else ""))
    return with_fact("\nUNION ALL\n".join(parts))


@query("sketch_roll_ups", _roll_up_sql())
def q_sketch_roll_ups(spark, sf_dir):
    """Distinct recipients and median ages of four groupings from one sketch cube by (category,
    year, country), beside the exact distincts, and whether both estimates stay within the sketches' bounds (four
    standard errors; three times the 99 % rank error)."""
    p = materialised(persons(award_facts(spark, sf_dir)).select("id", "category", "award_year", "birth_country", "age_at_award"))
    cube = materialised(SK.sketch_cube(p, ["category", "award_year", "birth_country"], ["id"], ["age_at_award"]))
    ages = p.groupBy("category", "award_year", "birth_country", "age_at_award").agg(F.count(F.lit(1)).alias("m"))
    ids = p.select("category", "award_year", "birth_country", "id").distinct()
    out = None
    for keys in ROLL_UPS:
        # one level column for every grouping: the joins below are on (level, member)
        member = F.col(keys[0]).cast("string") if keys else F.lit("all")
        named = lambda df: df.withColumn("level", F.lit(keys[0] if keys else "all")).withColumn("member", member)  # noqa: B023, E731
        parts = [named(cube).drop(*ROLL_UPS[0], *ROLL_UPS[1], *ROLL_UPS[2]), named(ids).select("level", "member", "id"),
                 named(ages).select("level", "member", "age_at_award", "m")]
        out = parts if out is None else [a.unionByName(b) for a, b in zip(out, parts, strict=True)]
    sketched = SK.estimates(SK.roll_up(out[0], ["level", "member"]))
    exact = out[1].groupBy("level", "member").agg(F.count_distinct("id").alias("distinct_ids"))
    both = sketched.alias("s").join(exact.alias("e"), (F.col("s.level") == F.col("e.level")) & F.col("s.member").eqNullSafe(F.col("e.member")))
    both = both.select("s.*", "distinct_ids")
    ranks = out[2].filter(F.col("age_at_award").isNotNull()).alias("a").join(
        both.alias("b"), (F.col("a.level") == F.col("b.level")) & F.col("a.member").eqNullSafe(F.col("b.member")))
    slack = 3 * SK.rank_error()
    below = F.sum(F.when(F.col("a.age_at_award") < F.col("values_age_at_award"), F.col("m")).otherwise(0)) / F.sum("m")
    upto = F.sum(F.when(F.col("a.age_at_award") <= F.col("values_age_at_award"), F.col("m")).otherwise(0)) / F.sum("m")
    error = F.abs(F.col("distinct_id") - F.col("distinct_ids"))
    return ranks.groupBy("b.level", "b.member", "n", "distinct_ids", "distinct_id").agg(
        ((below - slack <= 0.5) & (upto + slack >= 0.5)).alias("median_within_bound")).select(
        "level", "member", "n", "distinct_ids", (error <= 4 * SK.distinct_error() * F.col("distinct_ids")).alias("distinct_within_bound"),
        "median_within_bound")
