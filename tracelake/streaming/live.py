"""Archives as a stream: trace files arrive, their events leave as rows.

Files come in micro-batches of the binary source; a checkpoint holds which were
read. The dimension files (clocks and strings) are read anew for each batch,
because they grow too; of the strings only the files that are referred to. Values
too large for their event may arrive in a later file, or before it: the chunks of
such events wait in a folder beside the checkpoint, with their header and catalog,
and are tried again in every batch. After ``patience`` batches they are written as
they are. Large values are kept for ``keep`` batches. So what a batch carries on is
bounded by what arrived in the last batches, however long the stream runs.

State is a folder for each batch number. A batch that is run again after a
failure reads the state before it and replaces its own, so nothing is lost, and
the sink sees the same rows under the same batch number. States that no batch can
ask for again are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tracelake import schemas
from tracelake.functions.tables import MISSING
from tracelake.plans.assemble import event_table
from tracelake.sources import archive
from tracelake.streaming import bookmark as marks

BINARY = "path string, modificationTime timestamp, length long, content binary"
CHUNK = ["evidence", "catalog_seq", "chunk_seq"]
EVENT = [*CHUNK, "event_seq"]


def stream_files(spark: SparkSession, root: str, per_batch: int = 16) -> DataFrame:
    """(path, content) of trace files below a root, as they appear."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    found = found.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return archive.of_kind(found, "TraceV3").select("path", "content")


def state(spark: SparkSession, folder: str) -> DataFrame | None:
    """A folder's rows, or None if it was never written."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


class Stopped(Exception):
    """A batch was not begun because a stop was asked for."""


def run(writer: DataStreamWriter, stopping: Callable[[], bool], poll: float = 1.0) -> bool:
    """Runs a stream to its end (true) or until a stop is asked for (false).

    The batch at work is finished: its rows, state and bookmark are complete. The
    next one is refused before it does anything, so a later run from the same
    checkpoint begins with it and nothing is lost or written twice. A stream that
    waits for files is stopped while it waits.
    """
    query = writer.start()
    try:
        while not query.awaitTermination(poll):
            if stopping() and not query.status["isTriggerActive"]:
                query.stop()
    except StreamingQueryException:
        if not stopping():
            raise
    return not stopping()


def forget(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on any file system, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def carried(records: DataFrame, chunks: DataFrame, keep: int) -> DataFrame:
    """What the next batch needs: waiting chunks with their file's header and their catalog, and large values seen lately."""
    of = lambda kind: records.where(F.col("kind") == kind)
    waiting = of("firehose").join(chunks, CHUNK, "left_semi")
    heads = of("header").join(chunks.select("evidence").distinct(), "evidence", "left_semi")
    catalogs = of("catalog").join(chunks.select("evidence", "catalog_seq").distinct(), ["evidence", "catalog_seq"], "left_semi")
    return waiting.unionByName(heads).unionByName(catalogs).unionByName(of("oversize").where(F.col("age") < keep))


def stream_events(
    spark: SparkSession, root: str, sink: Callable[[DataFrame, int], None], checkpoint: str, per_batch: int = 16, patience: int = 10, keep: int = 50,
    stopping: Callable[[], bool] = lambda: False, bookmark: str | None = None,
) -> DataStreamWriter:
    """A writer that gives each micro-batch's event rows to the sink, late ones when they are complete.

    stopping is asked before each batch; see run(). bookmark names a file that keeps
    the latest time written, saved after the batch's rows and state.
    """

    def batch(files: DataFrame, number: int) -> None:
        if stopping():
            raise Stopped(f"batch {number} waits for the next run")
        at = lambda name, n: f"{checkpoint}-state/{name}/{n}"
        records = archive.records_of(files).withColumn("age", F.lit(0))
        waiting, written = state(spark, at("records", number - 1)), state(spark, at("written", number - 1))
        if waiting is not None:
            records = records.unionByName(waiting.withColumn("age", F.col("age") + 1))
        records = records.persist()
        needed = archive.referenced(records)
        rows = event_table(records.drop("age"), archive.timesync(spark, root), archive.uuidtext(spark, root, needed), archive.dsc(spark, root, needed))
        ages = records.where("kind IN ('firehose', 'simpledump', 'statedump')").select(*CHUNK, "age")
        rows = rows.join(ages, CHUNK).persist()
        # Only events wait; a dump that holds the marker is complete as it is.
        open_now = (F.col("section") == 0) & F.contains("message", F.lit(MISSING)) & (F.col("age") < patience)
        due = rows.where(~open_now)
        if written is not None:
            due = due.join(written, EVENT, "left_anti")
        sink(due.select(*schemas.EVENT_COLUMNS, *schemas.LINEAGE), number)
        chunks = rows.where(open_now).select(*CHUNK).distinct().persist()
        carried(records, chunks, keep).write.mode("overwrite").parquet(at("records", number))
        rows.where(~open_now).join(chunks, CHUNK, "left_semi").select(*EVENT).write.mode("overwrite").parquet(at("written", number))
        if bookmark:
            marks.save(spark, bookmark, marks.load(spark, bookmark, root).advanced(due.agg(F.max("time")).first()[0]))
        for df in (rows, chunks, records):
            df.unpersist()
        for name in ("records", "written"):
            forget(spark, at(name, number - 2))

    return stream_files(spark, root, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
