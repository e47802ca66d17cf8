"""Clustering and classification on Spark ML.

Feature preparation is column expressions; models are Spark ML estimators.
The training input is cached once per pipeline (iterative algorithms re-read
it); the cache is an optimisation only — a lost block is recomputed from the
lineage, so executor loss does not break a fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from . import groups as G
from .silhouette import euclidean_silhouette


def dummies(df: DataFrame, col: str, levels: Sequence[str], drop_first: bool = False, prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """0/1 indicator columns for ``levels`` (sorted); ``drop_first`` drops the first level
    (M5; Spark's OneHotEncoder would drop the last)."""
    prefix = prefix or col
    use = list(levels)[1:] if drop_first else list(levels)
    names = [f"{prefix}_{v}" for v in use]
    cols = {n: F.when(F.col(col) == v, F.lit(1.0)).otherwise(F.lit(0.0)) for n, v in zip(names, use)}
    return df.withColumns(cols), names


def levels_of(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct levels of a low-cardinality categorical column (one small job)."""
    return [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


# ------------------------------------------------------------------ K-Means (M1-M4)

def cluster_features(df: DataFrame, categories: Sequence[str], year: str = "award_year", age: str = "age_at_award"):
    """M1: persons with year and age, one-hot category (all levels), standardised.

    Identical feature tuples are collapsed into weighted points in one pass:
    K-Means on duplicated rows equals weighted K-Means on the distinct points,
    so the fit is exact while its input shrinks to the distinct tuples. The
    standardisation moments (mean, sample std over all rows) are weighted sums
    over the same points, so the fact is read once.
    Returns (rows with the feature columns, weighted points with ``features``)."""
    base = df.filter(~F.col("is_org")).na.drop(subset=[year, age])
    base = base.withColumn(year, F.col(year).cast("double")).withColumn(age, F.col(age).cast("double"))
    rows, cat_cols = dummies(base, "category", categories, prefix="cat")
    names = [year, age, *cat_cols]
    points = rows.groupBy(year, age, "category", *cat_cols).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    # two passes over the (small) points: centred sums don't cancel for years with a small spread
    w = F.col("weight")
    means = points.agg(F.sum(w).alias("_w"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"_m_{i}") for i, c in enumerate(names)])
    centred = G.with_scalar(points, means)
    moments = centred.agg(
        *[F.first(f"_m_{i}").alias(f"_m_{i}") for i in range(len(names))],
        *[F.sqrt(F.try_divide(F.sum(w * (F.col(c) - F.col(f"_m_{i}")) ** 2), F.first("_w") - 1)).alias(f"_s_{i}")
          for i, c in enumerate(names)],
    )
    points = G.with_scalar(points, moments)
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{i}"), F.col(f"_s_{i}")), F.lit(0.0)).alias(f"_z{i}")
              for i, c in enumerate(names)]
    points = points.select(year, age, "category", "weight", *scaled)
    points = VectorAssembler(inputCols=[f"_z{i}" for i in range(len(names))], outputCol="features").transform(points)
    return rows, points.select(year, age, "category", "weight", "features")


def _parallel(fn, items, parallelism: int, shared: DataFrame | None = None):
    """Run independent fits concurrently from driver threads (Spark schedules the
    jobs side by side, as ``CrossValidator(parallelism=...)`` does). A cached
    ``shared`` input is materialised first so the threads do not each compute it."""
    if shared is not None and shared.is_cached:
        shared.count()
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(fn, items))


def best_kmeans(points: DataFrame, k: int, n_init: int, seed: int, max_iter: int, parallelism: int):
    """The model with the lowest training cost of ``n_init`` seeded fits (the first seed wins a tie)."""

    def fit(i: int):
        m = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features", predictionCol="_c",
                   weightCol="weight").fit(points)
        return m.summary.trainingCost, i, m

    return min(_parallel(fit, list(range(n_init)), parallelism, points), key=lambda t: (t[0], t[1]))[2]


def kmeans_clusters(points: DataFrame, k: int = 5, n_init: int = 10, seed: int = 42, max_iter: int = 300,
                    parallelism: int = 10):
    """M2: weighted K-Means with ``n_init`` seeded restarts, lowest training cost kept
    (first seed wins a tie). Cluster ids are relabelled by centroid order so they are
    reproducible. Returns (points with ``cluster``, centroids as a list)."""

    model = best_kmeans(points, k, n_init, seed, max_iter, parallelism)
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    order = sorted(range(len(centers)), key=lambda i: centers[i])
    relabel = {old: new for new, old in enumerate(order)}
    mapping = points.sparkSession.createDataFrame([(o, n) for o, n in relabel.items()], "_c int, cluster int")
    out = model.transform(points).join(F.broadcast(mapping), "_c").drop("_c")  # k rows
    return out, [centers[i] for i in order]


def silhouette_sweep(points: DataFrame, ks: Sequence[int] = range(3, 8), seed: int = 42, n_init: int = 10,
                     max_iter: int = 300, parallelism: int = 10, chosen_k: int = 5) -> DataFrame:
    """M3: exact Euclidean silhouette (and Spark's squared one beside it) of the best of
    ``n_init`` fits for each k, flagging the best k by the Euclidean one and the k
    actually used (the reference reports the score at the chosen k, not the maximum).
    For the chosen k this is the model that ``kmeans_clusters`` returns with the same
    arguments."""
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="_c", distanceMeasure="squaredEuclidean",
                             weightCol="weight")
    rows = []
    for k in ks:
        assigned = best_kmeans(points, k, n_init, seed, max_iter, parallelism).transform(points)
        rows.append((int(k), euclidean_silhouette(assigned, "_c").first()["silhouette"], float(ev.evaluate(assigned))))
    best = max(rows, key=lambda r: (-1.0 if r[1] is None else r[1], -r[0]))[0]  # equal points make one cluster: no silhouette
    rows = [(k, e, v, k == best, k == chosen_k) for k, e, v in rows]
    return points.sparkSession.createDataFrame(
        rows, "k int, silhouette double, silhouette_sq_euclidean double, is_best_k boolean, is_chosen_k boolean")


def cluster_profiles(rows: DataFrame, assigned_points: DataFrame, year: str = "award_year",
                     age: str = "age_at_award") -> DataFrame:
    """M4: per cluster count, mean year and age, mode category and country.

    Everything that is a function of the feature tuple comes from the weighted
    point table; only the mode country needs the rows, which get their cluster
    by joining the point table on the feature tuple."""
    w = F.col("weight")
    base = assigned_points.groupBy("cluster").agg(
        F.sum(w).cast("long").alias("count"),
        (F.sum(w * F.col(year)) / F.sum(w)).alias("avg_year"),
        (F.sum(w * F.col(age)) / F.sum(w)).alias("avg_age"))
    cat = G.mode_by(assigned_points, "cluster", "category", "top_category", weight="weight").drop("top_category_count")
    assigned = rows.join(assigned_points.select(year, age, "category", "cluster"), [year, age, "category"])
    country = G.mode_by(assigned, "cluster", "birth_country", "top_country").drop("top_country_count")
    return base.join(cat, "cluster", "left").join(country, "cluster", "left").orderBy("cluster")


# ------------------------------------------------------------------ random forest (M5-M7)

def classifier_frame(df: DataFrame, genders: Sequence[str], continents: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """M5: persons with age, continent and decade; dummies with the first level dropped."""
    base = df.filter(~F.col("is_org")).na.drop(subset=["age_at_award", "birth_continent", "decade"])
    base, g_cols = dummies(base, "gender", genders, drop_first=True)
    base, c_cols = dummies(base, "birth_continent", continents, drop_first=True)
    names = [*g_cols, *c_cols, "decade", "age_at_award"]
    asm = VectorAssembler(inputCols=names, outputCol="features")
    base = base.withColumn("decade", F.col("decade").cast("double")).withColumn(
        "age_at_award", F.col("age_at_award").cast("double"))
    label = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(base)
    return label.transform(asm.transform(base)), names


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """w = n / (k · n_class), the 'balanced' class weight (one small aggregate)."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = per.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = G.with_scalar(per, tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(w, label)  # one row per class; AQE broadcasts it from its measured size


def fold_column(df: DataFrame, key_cols: Sequence[str], n_folds: int, seed: int = 42, label: str = "label",
                out: str = "fold") -> DataFrame:
    """Stratified folds: rows are numbered in the order (class, hash of the row key) and dealt
    in turn, so the rows of a class spread over the folds with counts at most one apart."""
    from .windows import ordinal

    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols]))
    numbered = ordinal(hashed, [label, "_h"], "_nth")
    return numbered.withColumn(out, ((F.col("_nth") - 1) % n_folds).cast("int")).drop("_h", "_nth")


# splits of a numeric feature that a forest tries: above the number of distinct ages, so that none is merged
FOREST_BINS = 128


def forest_points(data: DataFrame, num_trees: int, seed: int) -> DataFrame:
    """``data`` (features, label, weight, n: a row for n equal rows) with ``bag``, how often each tree draws it.

    A bootstrap draws each row Poisson(1) times, so n equal rows Poisson(n) times together: the
    bag of a tree has the distribution that it has over the rows. The draws depend on the
    point and the seed alone, not on the partitions."""

    @F.pandas_udf("array<int>")
    def draws(key: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([k & 0xFFFFFFFF, (k >> 32) & 0xFFFFFFFF]).poisson(m, num_trees).astype(np.int32) for k, m in zip(key.tolist(), n.tolist())])

    key = F.xxhash64(F.lit(seed), vector_to_array("features"), "label")
    return data.select("features", "label", "weight", draws(key, "n").alias("bag"))


def forest(points: DataFrame, num_trees: int, max_depth: int, seed: int, parallelism: int = 8) -> list:
    """The trees of a random forest over ``forest_points``, fitted side by side.

    Each is a forest of one tree with the square root of the features at every node, on its
    own bag; splits lie between the values of that bag. The work of a tree grows with the
    distinct points, and nothing is kept for a row and tree but the draws."""

    def tree(i: int):
        bag = F.col("bag")[i]
        drawn = points.filter(bag > 0).select("features", "label", (F.col("weight") * bag).alias("weight"))
        return RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=max_depth, seed=seed + i, weightCol="weight",
                                      featuresCol="features", labelCol="label", maxMemoryInMB=1024, maxBins=FOREST_BINS).fit(drawn)

    drawn = points.select(F.posexplode("bag")).groupBy("pos").agg(F.sum("col").alias("n")).filter("n > 0").collect()  # a tree without rows has no vote
    return _parallel(tree, sorted(r["pos"] for r in drawn), parallelism, points)


def forest_votes(trees: Sequence, points: DataFrame, n_classes: int, each: int = 25) -> DataFrame:
    """``points`` with ``prediction``: the class with the most votes, a tree's vote being its leaf's class shares."""
    votes = [F.lit(0.0)] * n_classes
    out = points.withColumn("_votes", F.array(*votes))
    for lo in range(0, len(trees), each):
        some = trees[lo : lo + each]
        for i, t in enumerate(some):
            t.setProbabilityCol(f"_p{i}").setRawPredictionCol("").setPredictionCol("")
            out = t.transform(out)
        held = [vector_to_array(f"_p{i}") for i in range(len(some))]
        total = [F.col("_votes")[c] + sum((F.coalesce(F.get(h, F.lit(c)), F.lit(0.0)) for h in held), F.lit(0.0)) for c in range(n_classes)]
        out = out.select(*points.columns, F.array(*total).alias("_votes"))
    most = F.array_position("_votes", F.array_max("_votes")) - 1  # the first of equal ones, as in Spark's forests
    return out.select(*points.columns, most.cast("double").alias("prediction"))


def random_forest_cv(frame: DataFrame, num_trees: int = 200, max_depth: int = 10, n_folds: int = 5,
                     seed: int = 42, key_cols: Sequence[str] = ("id", "award_year", "age_at_award"),
                     parallelism: int = 8) -> DataFrame:
    """M6: class-weighted random forest, accuracy of each of ``n_folds`` folds plus
    their mean and population std. Every row gets its fold; rows with equal features, label
    and fold are then one point with a count. ``parallelism``: trees fitted side by side."""
    keyed = fold_column(balanced_weights(frame), key_cols, n_folds, seed)
    data = keyed.groupBy("features", "label", "weight", "fold").agg(F.count(F.lit(1)).alias("n"))
    data = materialised(data)
    n_classes = int(data.agg(F.max("label")).first()[0]) + 1
    accs = []
    for f in range(n_folds):
        rest = data.filter(F.col("fold") != f).groupBy("features", "label", "weight").agg(F.sum("n").alias("n"))
        points = materialised(forest_points(rest, num_trees, seed))
        trees = forest(points, num_trees, max_depth, seed, parallelism)
        judged = forest_votes(trees, data.filter(F.col("fold") == f).select("features", "label", "n"), n_classes)
        right, total = judged.agg(F.sum(F.when(F.col("prediction") == F.col("label"), F.col("n")).otherwise(0)), F.sum("n")).first()
        accs.append((f, right / total if total else float("nan")))
    mean = sum(a for _, a in accs) / len(accs)
    std = math.sqrt(sum((a - mean) ** 2 for _, a in accs) / len(accs))
    folds = frame.sparkSession.createDataFrame(accs, "fold int, accuracy double")
    return folds.withColumn("cv_accuracy_mean", F.lit(mean)).withColumn("cv_accuracy_std", F.lit(std))


def feature_importances(frame: DataFrame, feature_names: Sequence[str], num_trees: int = 200, max_depth: int = 10,
                        seed: int = 42) -> DataFrame:
    """M7: importances of a forest fitted on all rows (the mean of its trees'), sorted descending."""
    data = balanced_weights(frame).groupBy("features", "label", "weight").agg(F.count(F.lit(1)).alias("n"))
    points = materialised(forest_points(data, num_trees, seed))
    each = np.array([t.featureImportances.toArray() for t in forest(points, num_trees, max_depth, seed)]).reshape(-1, len(feature_names))
    imp = each.sum(axis=0) / max(each.sum(), 1e-300)
    return frame.sparkSession.createDataFrame(
        [(n, float(v)) for n, v in zip(feature_names, imp)], "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")
