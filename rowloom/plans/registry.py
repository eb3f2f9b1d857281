"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name, with the SQL it must agree with."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["offer_fields"](spark, sf_dir)


# each module registers its queries as it is imported
from . import lookup_queries, matching_queries, offer_queries, relational_queries, text_queries  # noqa: E402, F401
