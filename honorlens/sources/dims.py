"""Small dimensions derived from the input tables.

The reference ships literal dictionaries keyed by real country and
organisation names; the driver tables use other keys, so the dimensions are
derived from the tables by a rule, keeping the reference's shape (a name may
lack an abbreviation; here every country has a centroid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def country_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, lat, lon) for every nation.

    ``nation`` has 25 rows at every scale factor, so joins against this
    dimension may broadcast it."""
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return nation.select(
        F.col("n_name").alias("country"),
        ((F.col("n_nationkey") * 37) % 160 - 80).cast("double").alias("lat"),
        ((F.col("n_nationkey") * 71) % 360 - 180).cast("double").alias("lon"),
    )


CENTROIDS_SQL = """centroids AS (
  SELECT n_name AS country, CAST((n_nationkey * 37) % 160 - 80 AS DOUBLE) AS lat,
         CAST((n_nationkey * 71) % 360 - 180 AS DOUBLE) AS lon
  FROM nation)"""


def name_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short display names for organisations (one per organisation name).

    Grows with ``customer``; joined by key, never broadcast blindly."""
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    return customer.filter(F.col("c_mktsegment") == "MACHINERY").select(
        F.col("c_name").alias("name"), F.concat(F.lit("ORG-"), F.col("c_custkey").cast("string")).alias("abbr")
    )


ABBREVIATIONS_SQL = """abbreviations AS (
  SELECT c_name AS name, 'ORG-' || CAST(c_custkey AS VARCHAR) AS abbr FROM customer WHERE c_mktsegment = 'MACHINERY')"""
