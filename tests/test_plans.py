"""Plan guards: no registered query of the library proper may contain a cross join, with broadcast
auto-join off (the shape the plans take on large tables)."""

import pytest

from honorlens.plans import catalog
from tests.conftest import SMALL

# these return rows that the driver made from fitted models: their plan is a list of rows
FITTED = {"forest_cv_accuracy", "forest_feature_importances", "kmeans_silhouette"}


def test_no_cross_joins_in_any_registered_query(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    bad = {}
    try:
        for name, fn in catalog.queries().items():
            if name in FITTED:
                continue
            plan = fn(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
            hits = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
            if hits:
                bad[name] = hits
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not bad, bad


def test_bundle_reports_share_one_fact(spark):
    from honorlens.operators import groups as G
    from honorlens.plans.bundles import run_analysis
    from honorlens.sources.facts import award_facts, persons

    bundle = run_analysis(spark, SMALL)
    for name, df in bundle.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "o_custkey" not in plan, name
    alone = G.descriptive_by_group(persons(award_facts(spark, SMALL)))
    assert bundle["descriptive"].columns == alone.columns
    for a, b in zip(bundle["descriptive"].collect(), alone.collect(), strict=True):
        assert a[0] == b[0] and list(a[1:]) == pytest.approx(list(b[1:]), rel=1e-9)
