"""Where event tables go: JSON lines, CSV with headings, Parquet."""

from __future__ import annotations

from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.schemas import EVENT_COLUMNS

# The CSV's headings and their columns, in order.
CSV = {
    "Timestamp": "timestamp", "Event Type": "event_type", "Log Type": "log_type", "Subsystem": "subsystem", "Thread ID": "thread_id", "PID": "pid", "EUID": "euid",
    "Library": "library", "Library UUID": "library_uuid", "Activity ID": "activity_id", "Parent Activity ID": "parent_activity_id", "Category": "category",
    "Process": "process", "Process UUID": "process_uuid", "Message": "message", "Raw Message": "raw_message", "Boot UUID": "boot_uuid", "System Timezone Name": "timezone_name",
}


def csv_time(timestamp: Column) -> Column:
    """A nine-digit timestamp cut to milliseconds."""
    return F.concat(F.substring(timestamp, 1, 23), F.lit("Z"))


def csv_rows(events: DataFrame) -> DataFrame:
    return events.select(*[(csv_time(F.col(c)) if c == "timestamp" else F.col(c)).alias(heading) for heading, c in CSV.items()])


def json_line(columns: Iterable[str]) -> Column:
    """One JSON object of the columns; null fields are left out."""
    return F.to_json(F.struct(*columns))


def json_rows(events: DataFrame) -> DataFrame:
    """One JSON object a row with all fields; none is ever null, so none is left out."""
    return events.select(json_line(EVENT_COLUMNS).alias("value"))


def print_rows(events: DataFrame, out: TextIO, kind: str = "jsonl") -> bool:
    """Prints rows as lines, a partition at a time; false if the reader went away, which ends the run early and cleanly."""
    if kind == "csv":
        rows, head = csv_rows(events), ",".join(f'"{c}"' for c in CSV)
        lines = rows.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"escape": '"', "quoteAll": "true"}).alias("value"))
    elif kind == "jsonl":
        lines, head = json_rows(events), None
    else:
        raise ValueError(f"unknown format for printed rows: {kind}")
    try:
        if head:
            out.write(head + "\n")
        for row in lines.toLocalIterator():
            out.write(row["value"] + "\n")
        out.flush()
    except BrokenPipeError:
        return False
    return True


def write(events: DataFrame, path: str, kind: str = "jsonl", append: bool = True) -> None:
    mode = "append" if append else "errorifexists"
    if kind == "csv":
        csv_rows(events).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        events.write.mode(mode).parquet(path)
    elif kind == "jsonl":
        json_rows(events).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown output format: {kind}")
