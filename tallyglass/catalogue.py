"""The registry of relational and evaluation queries: name -> Spark callable, name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyglass.plans import evaluation, gold
from tallyglass.plans import texts as _texts  # noqa: F401  (registers its queries with those of evaluation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return gold.queries() | evaluation.queries()


def oracle_sql() -> dict[str, str]:
    return gold.oracle_sql() | evaluation.oracle_sql()
