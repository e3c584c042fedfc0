"""Process dimensions of catalogs, and the joins that look them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.tables import UNKNOWN_SUBSYSTEM
from tracelake.operators.ranges import range_lookup

KEY = ["evidence", "catalog_seq", "p1", "p2"]
#: How joins with a side that grows with the events are done. Such sides are mostly repeated ids and paths: ten compressed MB, which Spark
#: would broadcast, are hundreds in the driver.
BY_SHUFFLE = "merge"


def of_kind(records: DataFrame, kind: str) -> DataFrame:
    """The records of one kind with their fields at the top."""
    return records.where(F.col("kind") == kind).select("evidence", "catalog_seq", "chunk_seq", f"{kind}.*")


def processes(records: DataFrame) -> DataFrame:
    """One row a process of a catalog, with images and subsystems as arrays."""
    return of_kind(records, "catalog").select("evidence", "catalog_seq", F.explode("processes").alias("p")).select("evidence", "catalog_seq", "p.*")


def subsystems(procs: DataFrame) -> DataFrame:
    """(KEY, subsystem_id, subsystem, category); of equal ids the first."""
    each = procs.select(*KEY, F.posexplode("subsystems").alias("at", "s"))
    first = each.groupBy(*KEY, F.col("s.id").alias("subsystem_id")).agg(F.min_by("s", "at").alias("s"))
    return first.select(*KEY, "subsystem_id", F.col("s.subsystem").alias("subsystem"), F.col("s.category").alias("category"))


def images(procs: DataFrame) -> DataFrame:
    """(KEY, at, uuid, low, size): the loaded ranges of a process in catalog order."""
    return procs.select(*KEY, F.posexplode("images").alias("at", "i")).select(*KEY, "at", F.col("i.uuid").alias("uuid"), F.col("i.load_address").alias("low"), F.col("i.size").alias("size"))


def with_process(events: DataFrame, procs: DataFrame) -> DataFrame:
    """events with pid, euid, main_uuid and dsc_uuid; zero and empty where the process is unknown."""
    dims = procs.select(*KEY, "pid", "euid", "main_uuid", "dsc_uuid")
    joined = events.join(dims.hint(BY_SHUFFLE), KEY, "left")
    return joined.withColumns({"pid": F.coalesce("pid", F.lit(0)), "euid": F.coalesce("euid", F.lit(0)), "main_uuid": F.coalesce("main_uuid", F.lit("")), "dsc_uuid": F.coalesce("dsc_uuid", F.lit(""))})


def with_subsystem(events: DataFrame, dims: DataFrame) -> DataFrame:
    """events with subsystem and category of their subsystem_id; id zero has neither."""
    joined = events.join(dims.hint(BY_SHUFFLE), [*KEY, "subsystem_id"], "left")
    asked = F.col("subsystem_id") != 0
    text = lambda c, unknown: F.when(asked, F.coalesce(c, F.lit(unknown))).otherwise("").alias(c)
    return joined.withColumns({"subsystem": text("subsystem", UNKNOWN_SUBSYSTEM), "category": text("category", "")})


def absolute_image(events: DataFrame, dims: DataFrame, address: Column) -> DataFrame:
    """events with image_uuid: the first image of the process whose range (both ends included) holds the address."""
    at = "__address"
    found = range_lookup(events.withColumn(at, address), dims.select(*KEY, "at", "low", "size", F.col("uuid").alias("image_uuid")), KEY, at)
    return found.select(*events.columns, "image_uuid")
