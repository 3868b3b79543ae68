"""Every query of the engine's own operators with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans.declare import ORACLES, QUERIES, Tables, query  # noqa: F401
from quern.plans import batches, catalogs, corpora, ranking, scans, telemetry, vectors  # noqa: F401, I001

__all__ = ["ORACLES", "QUERIES", "Tables", "query", "Callable", "DataFrame", "SparkSession"]
