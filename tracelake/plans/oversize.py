"""Values too large for their event: looked up by reference over all files, first one first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.plans.procs import BY_SHUFFLE

REF = ["data_ref", "p1", "p2"]


def first_of_each(oversize: DataFrame) -> DataFrame:
    """(REF, oversize_items): the first record of each reference in order of emission."""
    order = F.struct(F.split("evidence", "/"), "catalog_seq", "chunk_seq")
    return oversize.groupBy(*REF).agg(F.min_by("items", order).alias("oversize_items"))


def with_oversize(events: DataFrame, oversize: DataFrame) -> DataFrame:
    """events with message_items: those referred to (none, if they are nowhere), else the event's own.

    Only logs refer to such values; signposts that do keep their own items. One
    join over all files gives what carrying values from file to file and trying
    missing ones again would. Most events refer to nothing: they get a salt that no
    value has, so they are spread over the join instead of meeting under one key.
    """
    none = F.array().cast(dict(events.dtypes)["items"])
    refers = (F.col("activity_type") == 4) & (F.col("data_ref") != 0)
    place = [c for c in ("evidence", "catalog_seq", "chunk_seq", "event_seq") if c in events.columns]
    salted = events.withColumn("__salt", F.when(refers, 0).otherwise(1 + F.pmod(F.xxhash64(*place, *REF), F.lit(1 << 20)).cast("int")))
    joined = salted.join(first_of_each(oversize).withColumn("__salt", F.lit(0)).hint(BY_SHUFFLE), [*REF, "__salt"], "left")
    return joined.withColumn("message_items", F.when(refers, F.coalesce("oversize_items", none)).otherwise(F.col("items"))).drop("oversize_items", "__salt")


def split_missing(events: DataFrame, message: str = "message", marker: str = "<Missing message data>") -> tuple[DataFrame, DataFrame]:
    """(complete, missing) rows by whether the message lacks values."""
    lacks = F.contains(F.col(message), F.lit(marker))
    return events.where(~lacks), events.where(lacks)
