"""Registered queries of the core training-data operators: name -> (callable, SQL twin or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.operators import orphans, timestamps
from quillon.plans.core_sql import P3, P3_BY_PERIOD
from quillon.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(table(spark, d, "raw_items"), table(spark, d, "exports"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, d, n) for n in ("facts", "raw_items", "entities", "tombstones")))


def p3_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(p3_found(spark, d))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_orphans_by_period": p3_orphans_by_period}
SQL = {"p3_found": P3, "p3_orphans_by_period": P3_BY_PERIOD}
