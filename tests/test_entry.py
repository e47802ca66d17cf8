"""Driver contract and a small-scale oracle check."""

import duckdb

import __spark_entry__ as E
from honorlens.sources.tables import TABLES
from tests.conftest import SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "count" in df.columns


def test_oracle_keys_are_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def _norm(v):
    return "NULL" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_report_queries_match_duckdb_at_small_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    names = ["descriptive_by_category", "gender_by_decade", "country_rankings", "chi_squared_gender_category",
             "mann_whitney_age", "globe_points", "alias_resolution", "nested_records_flatten", "tfidf_vocabulary"]
    for name in names:
        sdf = E.queries()[name](spark, SMALL)
        res = con.execute(E.oracle_sql()[name])
        dcols = [d[0] for d in res.description]
        assert sorted(sdf.columns) == sorted(dcols), name
        assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, res.fetchall()), name


def test_analysis_bundle_runs(spark):
    from honorlens.plans.bundles import run_analysis

    bundle = run_analysis(spark, SMALL)
    assert {"descriptive", "chi_squared", "mann_whitney", "correlations", "p_values"} <= set(bundle)
    for name, df in bundle.items():
        assert df.count() >= 1, name


def test_write_reports(spark, tmp_path):
    from honorlens.sources.sinks import write_reports

    paths = write_reports({"facets": E.queries()["facet_values"](spark, SMALL)}, str(tmp_path))
    assert spark.read.parquet(paths[0]).count() > 0


def test_fact_table_roundtrip_prunes_partitions(spark, tmp_path):
    from honorlens.sources.facts import award_facts
    from honorlens.sources.sinks import write_fact_table

    fact = award_facts(spark, SMALL)
    path = write_fact_table(fact, str(tmp_path / "fact"))
    back = spark.read.parquet(path)
    assert back.count() == fact.count()
    year = back.select("award_year").first()[0]
    plan = back.filter(f"award_year = {year}")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "award_year" in plan


def test_ml_bundle_runs(spark):
    from honorlens.plans.bundles import run_ml

    bundle = run_ml(spark, SMALL, forest_trees=5, forest_folds=2, kmeans_restarts=2)
    assert bundle["silhouette"].count() == 5 and bundle["forest_cv"].count() == 2
    imp = [r["importance"] for r in bundle["feature_importances"].collect()]
    assert abs(sum(imp) - 1.0) < 1e-9
    assert bundle["cluster_profiles"].count() == 5
    assert bundle["topic_terms"].filter("rank <= 10").count() == bundle["topic_terms"].count()
    assert bundle["forecast_verdict"].count() >= 1


def test_insight_row_has_the_model_scalars(spark):
    r = E.queries()["insight_facts"](spark, SMALL).collect()
    assert len(r) == 1
    summary = E.queries()["topic_summary"](spark, SMALL).first()
    assert (r[0]["n_documents"], r[0]["n_topics"], r[0]["n_terms"]) == (summary["n_documents"], summary["n_topics"], summary["n_terms"])
    assert r[0]["forecast_years"] == 10 and r[0]["forecast_final_loss"] >= 0 and 0 < r[0]["explained_variance_pct"] <= 100


def test_import_needs_no_spark_installation_files(tmp_path):
    """The two maps can be read where no jars folder is to be found and no JVM can start."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    code = (
        "import builtins, glob, os, zipfile\n"
        "def refuse(*a, **k): raise RuntimeError('import must not look for files')\n"
        "glob.glob = refuse; zipfile.ZipFile = refuse\n"
        "import __spark_entry__ as e\n"
        "from pyspark import SparkContext\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and SparkContext._active_spark_context is None\n"
    )
    env = os.environ | {"PYTHONPATH": root, "SPARK_HOME": str(tmp_path), "JAVA_HOME": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
