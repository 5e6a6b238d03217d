"""All registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, figures, logs, parts, roundtrips, scoring, specs, texts  # noqa: F401  the modules register their queries
from .registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.flagship_capability_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
