"""The event table: all joins composed, and the three kinds of facts united."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelake import schemas
from tracelake.functions.codes import event_type, log_type
from tracelake.functions.tables import MISSING
from tracelake.operators.objects import state
from tracelake.operators.printf import format_log
from tracelake.plans import procs, strings, timeline
from tracelake.plans.oversize import with_oversize


def zone_name(timezone: Column) -> Column:
    """The last part of a time zone's path."""
    return F.element_at(F.split(timezone, "/"), -1)


def activity_ids(kind: Column, own: Column, other: Column) -> tuple[Column, Column]:
    """An event's activity and its parent: an activity that names another one is the other's, and its own id the parent."""
    named = (kind == 2) & (other != 0)
    return F.when(named, other).otherwise(own), F.when(named, own).otherwise(0)


def statedump_message(title: Column, library: Column, decoder: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), title, F.lit("\nObject Type: "), library, F.lit("\nObject Type: "), decoder, F.lit("\n"), text)


def headers(records: DataFrame) -> DataFrame:
    """(evidence, boot_uuid, timezone_name) of each file's first header."""
    first = procs.of_kind(records, "header").groupBy("evidence").agg(F.min_by(F.struct("boot_uuid", "timezone"), F.struct("catalog_seq", "chunk_seq")).alias("h"))
    return first.select("evidence", F.col("h.boot_uuid").alias("boot_uuid"), zone_name(F.col("h.timezone")).alias("timezone_name"))


def firehose_events(records: DataFrame) -> DataFrame:
    """One row an event with its chunk's process ids and times."""
    chunk = procs.of_kind(records, "firehose").select("evidence", "catalog_seq", "chunk_seq", "p1", "p2", "base_time", F.posexplode("events").alias("event_seq", "e"))
    return chunk.select("evidence", "catalog_seq", "chunk_seq", "p1", "p2", "base_time", "event_seq", "e.*").withColumn("continuous_time", F.col("base_time") + F.col("delta"))


@F.pandas_udf(StringType())
def state_text(kind: pd.Series, title: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([state(k, t, bytes(d)) for k, t, d in zip(kind, title, data, strict=True)])


def with_backtrace(message: Column, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit("Backtrace:\n"), F.array_join(lines, "\n"), F.lit("\n"), message)).otherwise(message)


def signpost_prefix(number: Column, name: Column) -> Column:
    return F.concat(F.lit("Signpost ID: "), F.hex(number), F.lit(" - Signpost Name: "), F.hex(name), F.lit("\n "))


def finished(df: DataFrame, section: int) -> DataFrame:
    """All columns of the event table, absent ones empty, with lineage."""
    blank = {"string": F.lit(""), "bigint": F.lit(0), "double": F.lit(0.0)}
    columns = [(F.coalesce(F.col(c).cast(t), blank[t]) if t in blank else F.coalesce(F.col(c).cast(t), F.array().cast(t))).alias(c) if c in df.columns else (blank[t].cast(t) if t in blank else F.array().cast(t)).alias(c) for c, t in schemas.EVENT_COLUMNS.items()]
    lineage = [F.col("catalog_seq"), F.lit(section).alias("section"), F.col("chunk_seq"), F.col("event_seq") if "event_seq" in df.columns else F.lit(0).alias("event_seq")]
    return df.select(*columns, *lineage)


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", timeline.iso_nanos(F.col("time").cast("bigint")))


def event_table(records: DataFrame, timesync: DataFrame, uuidtext: DataFrame, dsc: DataFrame, exclude_missing: bool = False) -> DataFrame:
    """The event table of decoded records. exclude_missing leaves events out whose values were never found."""
    head = headers(records)
    people = procs.processes(records)
    events = firehose_events(records).join(head, "evidence", "left")
    events = procs.with_process(events, people)
    events = procs.with_subsystem(events, procs.subsystems(people))
    events = strings.routed(events)
    events = procs.absolute_image(events, procs.images(people), F.col("address"))
    events = strings.with_strings(events, uuidtext, dsc)
    events = with_oversize(events, procs.of_kind(records, "oversize"))
    events = timeline.with_time(events, timesync)
    kind = F.col("activity_type")
    said = F.when(kind.isin(2, 3, 4, 6), format_log(F.col("raw_message"), F.col("message_items")))
    events = events.withColumn("said", F.coalesce(said, F.lit("")))
    if exclude_missing:
        events = events.where(~F.contains("said", F.lit(MISSING)))
    events = events.withColumn("message", with_backtrace(F.when(kind == 6, F.concat(signpost_prefix(F.col("signpost_id"), F.col("signpost_name")), F.col("said"))).otherwise(F.col("said")), F.col("backtrace")))
    activity, parent = activity_ids(kind, F.col("activity_id"), F.col("activity_id_3"))
    events = events.withColumns({
        "parent_activity_id": parent, "activity_id": F.when(kind.isin(2, 4, 6), activity).otherwise(0),
        "event_type": event_type(kind), "log_type": F.when(kind == 7, "Loss").otherwise(log_type(F.col("log_type"), kind)),
        "raw_message": F.when(kind == 3, "").otherwise(F.col("raw_message")), "message_entries": F.col("items"),
        "subsystem": F.when(kind == 4, F.col("subsystem")).when(kind == 6, F.col("subsystem")).otherwise(""), "category": F.when(kind.isin(4, 6), F.col("category")).otherwise(""),
    })
    simple = procs.of_kind(records, "simpledump").join(head, "evidence", "left").withColumns({"continuous_time": F.col("time"), "base_time": F.lit(1).cast("bigint")})
    simple = timeline.with_time(simple, timesync).withColumns({"pid": F.col("p1"), "library_uuid": F.col("sender_uuid"), "process_uuid": F.col("dsc_uuid"), "event_type": F.lit("Simpledump"), "log_type": F.lit("Simpledump")})
    dumps = procs.of_kind(records, "statedump").join(head, "evidence", "left").withColumns({"continuous_time": F.col("time"), "base_time": F.lit(1).cast("bigint")})
    text = statedump_message(F.col("title"), F.col("library"), F.col("decoder"), state_text("data_type", "title", "data"))
    dumps = timeline.with_time(dumps, timesync).withColumns({"pid": F.col("p1"), "message": text, "library": F.lit(""), "event_type": F.lit("Statedump"), "log_type": F.lit("Statedump")})
    return finished(stamped(events), 0).unionByName(finished(stamped(simple), 1)).unionByName(finished(stamped(dumps), 2))


def in_order(events: DataFrame) -> DataFrame:
    """Rows as they are emitted: by file, catalog, kind of fact and place."""
    return events.orderBy(F.split("evidence", "/"), *schemas.LINEAGE)
