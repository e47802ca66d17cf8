"""M6 / M7: forests over points that stand for equal rows."""

import random

import numpy as np
from pyspark.ml.feature import VectorAssembler

from honorlens.operators import learn as L


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, award_year int, age_at_award int, x double, y double, label double")
    return VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)


def test_equal_rows_are_drawn_as_often_as_each_for_itself(spark):
    data = _frame(spark, [(i, 2000, 30, float(i), 0.0, 0.0) for i in range(20)]).selectExpr("features", "label", "1.0D AS weight", "400L AS n")
    bags = {str(r.features): r.bag for r in L.forest_points(data, 200, 42).collect()}
    assert bags == {str(r.features): r.bag for r in L.forest_points(data.repartition(7), 200, 42).collect()}
    drawn = np.array(list(bags.values()))
    assert drawn.shape == (20, 200) and abs(drawn.mean() - 400) < 2 and 340 < drawn.var() < 460  # 160,000 if one draw counted for all


def test_folds_and_importances_of_a_forest_on_points(spark):
    rnd = random.Random(5)
    rows = [(i, 2000, 30, float(c), float(rnd.randint(0, 3)), float(c % 3)) for i in range(600) for c in [rnd.randint(0, 5)]]
    frame = _frame(spark, rows)
    out = L.random_forest_cv(frame, num_trees=9, max_depth=4, n_folds=3).orderBy("fold").collect()
    assert [r.fold for r in out] == [0, 1, 2] and all(r.accuracy > 0.95 for r in out)
    assert abs(out[0].cv_accuracy_mean - sum(r.accuracy for r in out) / 3) < 1e-12
    imp = {r.feature: r.importance for r in L.feature_importances(frame, ["x", "y"], num_trees=9, max_depth=4).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["x"] > 0.8
