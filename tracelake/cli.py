"""Command line: python -m tracelake.cli MODE --input DIR --output DIR [--format jsonl|csv|parquet].

An output of - prints rows; a reader that goes away ends the run. With --follow
new files are read as they appear, each batch to a folder of its own, until the
process is interrupted: the batch at work is finished first, and the next run
goes on after it.
"""

from __future__ import annotations

import argparse
import os
import signal
import sys
import threading

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake import sinks
from tracelake.functions.tables import ERRORS
from tracelake.plans.assemble import event_table, in_order
from tracelake.schemas import LINEAGE
from tracelake.sources import archive
from tracelake.sources.datasource import ranged
from tracelake.streaming import bookmark as marks
from tracelake.streaming import live


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Runs one command; a path that is not there ends it with a fixed text."""
    try:
        run(args, spark)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise SystemExit(ERRORS["path" if "single-file" in (args or sys.argv) else "dir"]) from e


def run(args: list[str] | None, spark: SparkSession | None) -> None:
    p = argparse.ArgumentParser(prog="tracelake", description=__doc__)
    p.add_argument("mode", choices=["live", "log-archive", "single-file"])
    p.add_argument("--input", help="archive directory or trace file; live reads the system's own")
    p.add_argument("--output", required=True)
    p.add_argument("--format", choices=["jsonl", "csv", "parquet"], default="jsonl")
    p.add_argument("--exclude-missing", action="store_true", help="leave out events whose values were never found")
    p.add_argument("--bookmark", nargs="?", const="", help="file that keeps the latest time read, by default in the user's data folder; later runs emit only later events")
    p.add_argument("--ordered", action="store_true", help="rows in order of emission")
    p.add_argument("--follow", action="store_true", help="go on reading files as they appear, until interrupted; state lies beside the output")
    p.add_argument("--split-bytes", type=int, help="read trace files larger than this by ranges of their catalogs, several tasks a file")
    p.add_argument("--stage", help="new folder that executors share, where decoded records are written once by kind; without it they are cached")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("tracelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    roots = list(archive.LIVE_ROOTS) if a.mode == "live" else a.input
    if a.follow:
        return follow(spark, str(a.input or archive.LIVE_ROOTS[0]), a)
    if a.mode == "single-file":
        records = archive.single_file(spark, a.input)
    else:
        records = ranged(spark, roots, splitBytes=a.split_bytes) if a.split_bytes else archive.records(spark, roots)
    records = archive.staged(records, a.stage) if a.stage else records.persist()
    if a.mode == "single-file":
        # Clocks and strings lie elsewhere: the same plan runs on empty dimensions.
        none = archive.files(spark, a.input).where("false")
        dims = archive.timesync_of(none), archive.uuidtext_of(none), archive.dsc_of(none)
    else:
        needed = archive.referenced(records)
        dims = archive.timesync(spark, roots), archive.uuidtext(spark, roots, needed), archive.dsc(spark, roots, needed)
    if a.bookmark == "":
        a.bookmark = marks.default_path(a.mode)
    events = event_table(records, *dims, exclude_missing=a.exclude_missing)
    if a.bookmark:
        mark = marks.load(spark, a.bookmark, str(roots))
        events = events.persist()
        latest = events.agg(F.max("time")).first()[0]
        events = marks.after(events, mark)
    events = in_order(events) if a.ordered else events
    if a.output != "-":
        sinks.write(events, a.output, a.format)
    elif not sinks.print_rows(events, sys.stdout, a.format):
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())  # nothing more is flushed to the reader that left
        return
    if a.bookmark:
        marks.save(spark, a.bookmark, mark.advanced(latest))


def follow(spark: SparkSession, root: str, a: argparse.Namespace) -> None:
    """Streams until SIGINT; the first one asks for a stop, a second one ends the process as usual."""
    asked = threading.Event()

    def interrupted(*_) -> None:
        asked.set()
        signal.signal(signal.SIGINT, signal.default_int_handler)

    def sink(events, number: int) -> None:
        live.forget(spark, f"{a.output}/batch={number}")  # of a batch that failed midway
        sinks.write(events.drop(*LINEAGE), f"{a.output}/batch={number}", a.format)

    before = signal.signal(signal.SIGINT, interrupted)
    try:
        mark = marks.default_path(a.mode) if a.bookmark == "" else a.bookmark
        live.run(live.stream_events(spark, root, sink, f"{a.output}-checkpoint", stopping=asked.is_set, bookmark=mark), asked.is_set)
    finally:
        signal.signal(signal.SIGINT, before)


if __name__ == "__main__":
    main()
