"""Parquet scans of the input tables, with explicit column lists so the scan
reads only what a report needs (``ReadSchema`` shows the pruned columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_first_available(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", **options) -> DataFrame:
    """S3: try each source in order and use the first that resolves.

    Only the *resolution* (listing + schema) is attempted here, so no data is
    read on the driver; the fallback happens before any job runs."""
    errors = []
    for path in paths:
        try:
            return spark.read.format(fmt).options(**options).load(path)
        except Exception as exc:  # noqa: BLE001 - any failure means "try the next one"
            errors.append(f"{path}: {exc.__class__.__name__}")
    raise FileNotFoundError("no source could be resolved: " + "; ".join(errors))
