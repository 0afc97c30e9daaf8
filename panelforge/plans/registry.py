"""Named queries over the driver tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, cleaning, inference, panels, portfolio, textual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = cleaning.QUERIES | panels.QUERIES | portfolio.QUERIES | inference.QUERIES | audit.QUERIES | textual.QUERIES
ORACLES: dict[str, str] = cleaning.ORACLES | panels.ORACLES | portfolio.ORACLES | inference.ORACLES | audit.ORACLES | textual.ORACLES
