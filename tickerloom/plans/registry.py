"""Registered queries and the SQL text each one is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.plans.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str):
    """Register a plan over ``Views`` and, where SQL can express it, its check."""

    def register(plan: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: plan(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql, **ctes)
        return plan

    return register


def iso(name: str) -> Column:
    """A date column as ISO text, so that results compare across engines."""
    return F.col(name).cast("string").alias(name)


def joined(name: str, sep: str = ",") -> Column:
    """An array column as text."""
    return F.array_join(name, sep).alias(name)
