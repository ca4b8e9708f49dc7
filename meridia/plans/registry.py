"""All queries of the planning engine by name, and the SQL that states each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridia.plans import decision_queries, gold_queries, model_queries, place_queries, rank_queries, relational_queries, score_queries, serving_queries, text_queries  # noqa: F401  they register their queries
from meridia.plans.base import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
