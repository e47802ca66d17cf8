"""Imports every module that registers queries and exposes the two maps."""

from __future__ import annotations

from . import analysis, bundles, enrichment, ingest, marts, models, reports  # noqa: F401  (registration side effects)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
