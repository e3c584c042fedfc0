"""The queries of the engine's own operators, with the SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans import queries_codes, queries_joins, queries_messages, queries_objects
from tracelake.plans.derived import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship", "queries_codes", "queries_joins", "queries_messages", "queries_objects"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan in miniature: class, process, subsystem, time and message of each event, counted."""
    return queries_joins.flagship(spark, sf_dir)
