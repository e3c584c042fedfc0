"""Resuming: a threshold of event time, frozen while a run goes on."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bookmark:
    """How far a source was read."""

    source: str
    time: float = 0.0
    boot_uuid: str = ""
    processed_files: int = 0

    def advanced(self, time: float | None) -> Bookmark:
        """The bookmark moved to a later time; never back."""
        return self if time is None or time <= self.time else replace(self, time=time)


def default_path(mode: str, system: str = sys.platform) -> str:
    """Where a mode's bookmark is kept if no place is named: the user's data folder of the system."""
    home = os.environ.get("HOME", ".")
    if system.startswith("win"):
        folder = os.environ.get("LOCALAPPDATA", ".")
    elif system == "darwin":
        folder = f"{home}/Library/Application Support"
    else:
        folder = os.environ.get("XDG_DATA_HOME", f"{home}/.local/share")
    return f"{folder}/tracelake/{mode}.bookmark"


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load(spark: SparkSession, path: str, source: str) -> Bookmark:
    """The stored bookmark; a fresh one if there is none or it is of another source."""
    at, fs = _file(spark, path)
    if not fs.exists(at):
        return Bookmark(source)
    found = Bookmark(**json.loads(spark.read.text(path, wholetext=True).first()[0]))
    return found if found.source == source else Bookmark(source)


def save(spark: SparkSession, path: str, bookmark: Bookmark) -> None:
    at, fs = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(asdict(bookmark)).encode()))
    out.close()


def after(events: DataFrame, bookmark: Bookmark, time: str = "time") -> DataFrame:
    """Only events later than the bookmark; the condition is a plain filter that Spark pushes down."""
    return events.where(F.col(time) > bookmark.time)


def counts(events: DataFrame, time: str, mark: float, ids: str) -> DataFrame:
    """One row: emitted and skipped events, the new bookmark over both, and the sum of emitted ids."""
    late = F.col(time) > mark
    return events.agg(F.count_if(late).alias("emitted"), F.count_if(~late).alias("skipped"), F.max(time).alias("bookmark"), F.sum(F.when(late, F.col(ids))).alias("ids"))
