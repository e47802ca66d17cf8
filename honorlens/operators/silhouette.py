"""Exact Euclidean silhouette of weighted points (M3).

A silhouette needs the mean distance of every point to every cluster, and a
Euclidean distance (unlike a squared one) has no sum in closed form. Equal
points of a cluster are merged into one weighted point first; what is left is
numbered and cut into blocks of at most ``block`` points. A pair of blocks is
one group of a cogroup: NumPy builds its distances once, for both sides, and
only their sums per (point, cluster) leave the task. No pair is emitted, and a
task never holds more than two blocks and their distances, whatever the number
of points or however unequal the clusters are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import groups as G
from .windows import ordinal

BLOCK = 1024
_SUMS = "nth long, cluster string, weight double, other string, dist double"


def _block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``, one coordinate at a time (no cancellation)."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        total += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(total)


def _side(points: pd.DataFrame, others: pd.DataFrame, distances: np.ndarray) -> pd.DataFrame:
    """Weighted sums of ``distances`` over the clusters of ``others``, a row a (point, cluster)."""
    names, codes = np.unique(others["cluster"].to_numpy(dtype=str), return_inverse=True)
    member = np.zeros((len(others), len(names)))
    member[np.arange(len(others)), codes] = others["weight"].to_numpy()
    sums = distances @ member
    return pd.DataFrame({
        "nth": np.repeat(points["nth"].to_numpy(), len(names)),
        "cluster": np.repeat(points["cluster"].to_numpy(), len(names)),
        "weight": np.repeat(points["weight"].to_numpy(), len(names)),
        "other": np.tile(names, len(points)),
        "dist": sums.ravel()})


def _pair_of_blocks(key, low: pd.DataFrame, high: pd.DataFrame) -> pd.DataFrame:
    a, b = np.array(low["x"].tolist(), dtype=float), np.array(high["x"].tolist(), dtype=float)
    distances = _block_distances(a, b)
    out = _side(low, high, distances)
    if key[0] != key[1]:
        out = pd.concat([out, _side(high, low, distances.T)])
    return out


def silhouette_values(points: DataFrame, cluster: str = "cluster", features: str = "features",
                      weight: str | None = "weight", block: int = BLOCK) -> DataFrame:
    """A row for each distinct point of a cluster: ``cluster`` (as text), ``weight``, ``own`` and ``nearest``
    (mean distance to the rest of its cluster, and to the cluster next to it) and ``silhouette``.

    ``features`` is a vector or an array of doubles; ``weight`` counts equal points (None: one each), which
    give the same values as that many rows. The only member of a cluster has 0, as have points at distance 0
    from everything; with a single cluster there is no neighbour and the values are null. Rows without a
    cluster or features are left out; an empty input gives no rows."""
    if block < 1:
        raise ValueError("block must be at least 1")
    ship_package(points.sparkSession)
    x = vector_to_array(features) if isinstance(points.schema[features].dataType, VectorUDT) else F.col(features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # -0.0 and 0.0 are one coordinate: adding 0.0 makes them one key
    merged = points.select(F.transform(x, lambda v: v + F.lit(0.0)).alias("x"), F.col(cluster).cast("string").alias("cluster"),
                           w.alias("weight")).na.drop().groupBy("x", "cluster").agg(F.sum("weight").alias("weight"))
    numbered = ordinal(merged, ["x", "cluster"], "nth")
    numbered = numbered.withColumn("_b", F.floor((F.col("nth") - 1) / block).cast("int"))
    blocks = G.with_scalar(numbered, numbered.agg(F.max("_b").alias("_last")))
    low = blocks.withColumn("_o", F.explode(F.sequence(F.col("_b"), F.col("_last")))).drop("_last")
    high = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b")))).drop("_last")
    high = high.select(*[F.col(c).alias(c) for c in high.columns])  # both sides come from one table: columns of their own
    parts = low.groupBy("_b", "_o").cogroup(high.groupBy("_o", "_b")).applyInPandas(_pair_of_blocks, _SUMS)
    sums = parts.groupBy("nth", "cluster", "weight", "other").agg(F.sum("dist").alias("dist"))
    sizes = merged.groupBy(F.col("cluster").alias("other")).agg(F.sum("weight").alias("size"))
    own = F.col("cluster") == F.col("other")
    per = sums.join(sizes, "other").groupBy("nth", "cluster", "weight").agg(
        F.max(F.when(own, F.col("size"))).alias("_size"),
        F.max(F.when(own, F.try_divide(F.col("dist"), F.col("size") - 1))).alias("own"),
        F.min(F.when(~own, F.col("dist") / F.col("size"))).alias("nearest"))
    score = F.when(F.col("nearest").isNull(), F.lit(None).cast("double")).when(F.col("_size") <= 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("nearest") - F.col("own"), F.greatest("own", "nearest")), F.lit(0.0)))
    return per.select("cluster", "weight", "own", "nearest", score.alias("silhouette"))


def euclidean_silhouette(points: DataFrame, cluster: str = "cluster", features: str = "features",
                         weight: str | None = "weight", block: int = BLOCK) -> DataFrame:
    """M3: one row: the weighted mean ``silhouette`` of all points, ``n_points`` and ``n_clusters``."""
    v = silhouette_values(points, cluster, features, weight, block)
    return v.agg(F.try_divide(F.sum(F.col("silhouette") * F.col("weight")), F.sum("weight")).alias("silhouette"),
                 F.coalesce(F.sum("weight"), F.lit(0.0)).cast("long").alias("n_points"),
                 F.count_distinct("cluster").alias("n_clusters"))
