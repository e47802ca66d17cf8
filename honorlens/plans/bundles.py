"""Bundles of reports and models (A13, M13-M15) as lazily built DataFrames.

The reference computes every report once at start-up into a dict; here a
bundle is a dict of DataFrames over one fact — nothing runs until a report is
written or collected (``sources.sinks.write_reports`` persists a bundle)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_doubles, round_half_even
from ..llm.common import staged
from ..operators import groups as G
from ..operators import stats as S
from ..session import ensure_checkpoint_dir, materialised
from ..sources.facts import award_facts, persons
from ..streaming.cube import ROWS, open_cube, start_cube
from . import analysis  # noqa: F401  (the SQL of its queries is used below)
from .registry import ORACLES, query
from .reports import CATEGORY_ORDER, PERSON_GENDERS


# The reference's display rounding per report column.
DISPLAY_DIGITS = {
    "descriptive": {c: 1 for c in ("avg_age", "median_age", "std_age", "pct_female", "avg_lifespan")},
    "gender_decades": {"female_pct": 1},
    "chi_squared": {"chi2_statistic": 2},
    "mann_whitney": {"u_statistic": 2, "median_1": 1, "median_2": 1},
    "age_regression": {"slope": 4, "intercept": 2, "r_squared": 4, "t_statistic": 2},
    "lifespan": {"avg_lifespan": 1, "median_lifespan": 1},
    "age_distribution": {"mean": 1, "median": 1, "std": 1, "skewness": 3, "kurtosis": 3},
    "correlations": {"r": 3},
}


def run_analysis(spark: SparkSession, sf_dir: str, mw_categories: tuple[str, str] = ("1-URGENT", "5-LOW"),
                 numeric: tuple[str, ...] = ("award_year", "age_at_award", "prize_amount", "prize_amount_adjusted",
                                             "lifespan"), display: bool = False) -> dict[str, DataFrame]:
    """Descriptive, gender by decade, rankings, χ², rank-sum, regression,
    lifespan, per-decade counts, distribution and correlations. ``display=True``
    applies the reference's rounding (half to even) as the last step."""
    # the fact is joined once; the reports read their columns of it, those that need counts only read a cube
    fact = award_facts(spark, sf_dir).withColumn("has_id", F.col("id").isNotNull())
    fact = staged(fact.select(*dict.fromkeys([*CUBE_KEYS, "id", "lifespan", *numeric])), "facts")
    counted = counted_reports(materialised(fact.groupBy(*CUBE_KEYS).agg(F.count(F.lit(1)).alias(ROWS))), mw_categories)
    p = persons(fact)
    tests = {"chi": "chi_squared", "mw": "mann_whitney", "ols": "age_regression", "dist": "age_distribution"}
    out = {
        "descriptive": G.descriptive_by_group(p, apart=True),
        "gender_decades": counted["gender_decades"],
        "country_rankings": counted["country_rankings"],
        "chi_squared": counted["chi_squared"],
        "mann_whitney": counted["mann_whitney"],
        "age_regression": counted["age_regression"],
        "lifespan": G.lifespan_by_group(p),
        "prizes_decade": counted["prizes_decade"],
        "age_distribution": counted["age_distribution"],
        "correlations": S.correlation_long(p, list(numeric)),
        "p_values": S.with_p_values(**{k: counted[name] for k, name in tests.items()}),
    }
    if display:
        out = {k: round_half_even(v, DISPLAY_DIGITS.get(k, {})) for k, v in out.items()}
    return out


def run_ml(spark: SparkSession, sf_dir: str, forest_trees: int = 200, forest_folds: int = 5,
           kmeans_restarts: int = 10) -> dict[str, DataFrame]:
    """M15 (with M13, M14): clustering, forest, topics and forecast outputs.
    Model fits run when called (they are actions); outputs are DataFrames."""
    from . import models as MD
    from ..operators import forecast as FC
    from ..operators import learn as L
    from ..operators import topics as TP

    rows, points = MD._cluster_input(spark, sf_dir)
    points = points.cache()
    assigned, _ = L.kmeans_clusters(points, n_init=kmeans_restarts)
    frame, names = MD._forest_frame(spark, sf_dir)
    weighted, vocab, scores, comps = MD._topic_model(spark, sf_dir)
    series = MD._event_series(spark, sf_dir)
    fc = FC.forecast_series(series, MD.SERIES_LAGS, MD.SERIES_HORIZON)
    return {
        "cluster_profiles": L.cluster_profiles(rows, assigned),
        "silhouette": L.silhouette_sweep(points),
        "forest_cv": L.random_forest_cv(frame, num_trees=forest_trees, n_folds=forest_folds),
        "feature_importances": L.feature_importances(frame, names, num_trees=forest_trees),
        "topic_terms": TP.top_terms(spark, vocab, comps),
        "topic_by_category": TP.dominant_topic(scores).join(weighted.select("id", "category"), "id")
        .groupBy("category", "dominant_topic").count(),
        "explained_variance": TP.explained_variance(scores, weighted, "tfidf", len(comps)),
        "forecast": fc,
        "forecast_verdict": FC.trend_verdict(fc),
    }


# per report: the query whose SQL gives the same report, and the columns that its check adds up (numbers, texts)
CHECKED = {
    "descriptive": ("descriptive_by_category", ["count", "unique_laureates", "avg_age", "median_age", "std_age", "min_age", "max_age",
                                                "pct_female", "avg_lifespan"], ["category"]),
    "gender_decades": ("gender_by_decade", ["decade", "female", "male", "other", "total", "female_pct"], []),
    "country_rankings": ("country_rankings", ["count", "categories"], ["birth_country"]),
    "chi_squared": ("chi_squared_gender_category", ["chi2_statistic", "dof", "n", "n_rows", "n_cols"], []),
    "mann_whitney": ("mann_whitney_age", ["u_statistic", "u2", "n1", "n2", "tie_term", "mu", "sigma", "z", "median_1", "median_2"], []),
    "age_regression": ("age_trend_regression", ["slope", "intercept", "r_squared", "t_statistic", "n", "dof", "slope_per_decade"], []),
    "lifespan": ("lifespan_by_category", ["avg_lifespan", "median_lifespan", "count"], ["category"]),
    "prizes_decade": ("prizes_per_decade", ["decade", *CATEGORY_ORDER], []),
    "age_distribution": ("age_distribution_stats", ["mean", "median", "std", "skewness", "kurtosis", "youngest", "oldest", "n", "jarque_bera"], []),
    "correlations": ("correlation_matrix", ["r"], ["var_a", "var_b"]),
}


# the reports that need nothing but counts: a cube has them all
COUNTED = ["gender_decades", "country_rankings", "chi_squared", "mann_whitney", "age_regression", "prizes_decade", "age_distribution"]
CUBE_KEYS = ["category", "gender", "is_org", "decade", "award_year", "birth_country", "age_at_award", "has_id"]


def counted_reports(cube: DataFrame, mw_categories: tuple[str, str] = ("1-URGENT", "5-LOW")) -> dict[str, DataFrame]:
    """A13 from a count cube by ``CUBE_KEYS`` with ``n_rows``: the reports of ``COUNTED``, equal to those over the fact."""
    p = persons(cube)
    c1, c2 = mw_categories
    return {
        "gender_decades": G.gender_by_decade(p, values=PERSON_GENDERS, weight=ROWS),
        "country_rankings": G.top_groups(cube.withColumn("id", F.when(F.col("has_id"), F.lit(1))), top_n=20, weight=ROWS),
        "chi_squared": S.chi_squared(p.filter(F.col("gender").isin("male", "female")), "gender", "category", weight=ROWS),
        "mann_whitney": S.mann_whitney(p.filter(F.col("category").isin(c1, c2)), "age_at_award", F.col("category") == c1, weight=ROWS),
        "age_regression": S.ols_trend(p, weight=ROWS),
        "prizes_decade": G.counts_per_bucket(cube, "decade", "category", CATEGORY_ORDER, weight=ROWS),
        "age_distribution": S.distribution_stats(p, weight=ROWS),
    }


def _checks(report: str) -> str:
    name, numbers, texts = CHECKED[report]
    total = " + ".join(f'coalesce(CAST("{c}" AS DOUBLE), 0)' for c in numbers)
    digest = " + ".join(f"CAST('0x' || substr(md5({c}), 1, 8) AS BIGINT)" for c in texts) or "0"
    return (f"SELECT '{report}' AS report, count(*) AS n_rows, round(sum({total}), 4) AS total, "
            f"CAST(sum({digest}) AS BIGINT) AS text_digest FROM ({ORACLES[name]})")


def _checks_sql() -> str:
    """Rows, sum of all numbers and sum of text digests of every report, from the SQL of the reports' own queries."""
    parts = [_checks(report) for report in CHECKED]
    parts.append("SELECT 'p_values', 4, NULL, NULL")
    return "\nUNION ALL\n".join(parts)


def _summed(reports: dict[str, DataFrame]) -> DataFrame:
    """Each report with its number of rows and sums over all of its contents."""
    out = None
    for name, df in reports.items():
        sums = [F.lit(None).cast("double"), F.lit(None).cast("long")]
        if name in CHECKED:
            _, numbers, texts = CHECKED[name]
            value = sum((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in numbers), F.lit(0.0))
            digest = sum((F.conv(F.substring(F.md5(F.col(c)), 1, 8), 16, 10).cast("long") for c in texts), F.lit(0).cast("long"))
            sums = [F.round(F.sum(value), 4), F.sum(digest)]
        n = round_doubles(df).agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows"), sums[0].alias("total"),
                                  sums[1].alias("text_digest"))
        out = n if out is None else out.unionByName(n)
    return out


@query("analysis_bundle", _checks_sql())
def q_bundle(spark, sf_dir):
    """Every report of the bundle with its number of rows and sums over all of its contents."""
    return _summed(run_analysis(spark, sf_dir))


@query("incremental_bundle", "\nUNION ALL\n".join(_checks(report) for report in COUNTED))
def q_incremental_bundle(spark, sf_dir):
    """The counted reports from a cube that a stream of fact files feeds, three files a batch."""
    folder = f"{ensure_checkpoint_dir(spark)}/cube-{uuid.uuid4().hex}"
    fact = award_facts(spark, sf_dir).withColumn("has_id", F.col("id").isNotNull()).select(*CUBE_KEYS)
    fact.write.parquet(f"{folder}/fact")
    stream = spark.readStream.schema(fact.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/fact")
    cube = open_cube(fact, CUBE_KEYS, f"{folder}/cube")
    start_cube(stream, cube, f"{folder}/progress").awaitTermination()
    cube.compact()
    return _summed(counted_reports(materialised(cube.read())))
