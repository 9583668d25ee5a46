"""Collects every registered query module into one registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def registry() -> dict:
    from barflow.plans import queries  # noqa: F401  (registers on import)
    from barflow.plans import queries_ml  # noqa: F401
    from barflow.plans import queries_ticks  # noqa: F401
    from barflow.plans import queries_wide  # noqa: F401
    return dict(queries.REGISTRY)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    from barflow.plans.queries import flagship_features
    return flagship_features(spark, sf)
