"""Archives as DataFrames: files are read by Spark's binary source and decoded a file at a time.

Paths may be on any file system that Spark reads. A file that cannot be decoded
is skipped (PERMISSIVE, the default) or fails the job (FAILFAST).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracelake import schemas
from tracelake.functions.tables import ERRORS
from tracelake.sources import codec

LIVE_ROOTS = ("/private/var/db/diagnostics", "/private/var/db/uuidtext")
BATCH, BATCH_BYTES = 200, 8 << 20


def only_hex(text: Column) -> Column:
    return text.rlike("^[0-9A-Fa-f]*$")


def file_kind(path: Column) -> Column:
    """TraceV3, UUIDText, Dsc, Timesync or Invalid, by the last two parts of a path."""
    name = F.substring_index(path, "/", -1)
    parent = F.when(F.contains(path, F.lit("/")), F.substring_index(F.substring_index(path, "/", -2), "/", 1)).otherwise("")
    trace = (name == "logdata.LiveData.tracev3") | (name.endswith(".tracev3") & parent.isin("HighVolume", "Special", "Signpost", "Persist"))
    text = name.rlike("^[0-9A-Fa-f]{30}$") & parent.rlike("^[0-9A-Fa-f]{2}$")
    shared = name.rlike("^[0-9A-Fa-f]{32}$") & (parent == "dsc")
    return F.when(trace, "TraceV3").when(text, "UUIDText").when(shared, "Dsc").when(name.endswith(".timesync") & (parent == "timesync"), "Timesync").otherwise("Invalid")


def padded_uuid(uuid: Column) -> Column:
    """A file's 32-digit id from 30 to 32 digits; null for any other length."""
    return F.when(F.length(uuid).between(30, 32), F.lpad(uuid, 32, "0"))


def files(spark: SparkSession, roots: str | list[str], kind: str | None = None, skip_hidden: bool = True) -> DataFrame:
    """(path, content) of the files of a kind below the roots. Only paths are read until content is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    if skip_hidden:  # side files that some copiers leave
        found = found.where(~F.element_at(F.split("path", "/"), -1).startswith("._"))
    found = found.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return (found.where(file_kind(F.col("path")) == kind) if kind else found).select("path", "content")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches, which else hold up to 10,000 files with their contents; a bound of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def decoded(source: DataFrame, kind: str, ddl: str, rows: Callable[[str, bytes], Iterator[dict]], strict: bool) -> DataFrame:
    """Rows that a function makes of each file, in Arrow batches of bounded length.

    strict fails on a file that cannot be decoded, naming its kind and path.
    """
    schema = StructType.fromDDL(ddl)
    small_batches(source.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out: list[dict] = []
                try:
                    for row in rows(path.as_py(), content.as_buffer().to_pybytes()):
                        out.append(row)
                        if len(out) >= BATCH:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out = []
                except (codec.Malformed, struct.error) as e:
                    if strict:
                        raise codec.Malformed(f"{ERRORS[kind]}: {path.as_py()}: {e}") from e
                if out:
                    yield pa.RecordBatch.from_pylist(out, arrow)

    return source.mapInArrow(run, schema)


def of_kind(source: DataFrame, kind: str) -> DataFrame:
    return source.where(file_kind(F.col("path")) == kind)


def record_row(evidence: str, found: codec.Record) -> dict:
    kind, catalog_seq, chunk_seq, zone, record = found
    return {"evidence": evidence, "catalog_seq": catalog_seq, "chunk_seq": chunk_seq, "kind": kind, "ticks_from": zone[0], "ticks_to": zone[1], kind: record}


def records_of(source: DataFrame, mode: str = "PERMISSIVE", since: int | None = None, until: int | None = None) -> DataFrame:
    """Every record of trace files (path, content): evidence, catalog_seq, chunk_seq, kind, zone and the column of that kind.

    since and until, in ticks, leave whole chunksets out that lie outside of them;
    values too large for their event that lie in such chunksets count as missing.
    """
    strict = mode.upper() == "FAILFAST"

    def rows(path: str, content: bytes) -> Iterator[dict]:
        return (record_row(path, r) for r in codec.trace_file(content, strict, since=since, until=until))

    return decoded(source, "TraceV3", schemas.RECORD_DDL, rows, strict)


def records(spark: SparkSession, roots: str | list[str], mode: str = "PERMISSIVE", since: int | None = None, until: int | None = None) -> DataFrame:
    return records_of(files(spark, roots, "TraceV3"), mode, since, until)


def single_file(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Records of one trace file wherever it is."""
    return records_of(spark.read.format("binaryFile").load(path).select("path", "content"), mode)


def timesync_of(source: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """A row for each clock record, and one with null seq for each boot."""

    def rows(path: str, content: bytes) -> Iterator[dict]:
        for n, boot in enumerate(codec.timesync(content)):
            own = {"path": path, "boot_seq": n} | {k: boot[k] for k in ("boot_uuid", "numerator", "denominator", "boot_time")}
            yield own
            for i, r in enumerate(boot["records"]):
                yield own | {"seq": i, "kernel_time": r["kernel_time"], "walltime": r["walltime"]}

    return decoded(source, "Timesync", schemas.TIMESYNC_DDL, rows, mode.upper() == "FAILFAST")


def timesync(spark: SparkSession, roots: str | list[str], mode: str = "PERMISSIVE") -> DataFrame:
    return timesync_of(files(spark, roots, "Timesync"), mode)


def file_uuid(path: Column, kind: str) -> Column:
    """The id that a string file's path stands for."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return F.upper(name if kind == "Dsc" else F.concat(F.element_at(parts, -2), name))


def wanted(found: DataFrame, kind: str, needed: DataFrame | None) -> DataFrame:
    """Only the files that are referred to, chosen by path before any content is decoded."""
    return found if needed is None else found.withColumn("uuid", file_uuid(F.col("path"), kind)).join(needed.select("uuid").distinct(), "uuid", "left_semi")


def only_needed(spark: SparkSession, roots: str | list[str], kind: str, needed: DataFrame | None) -> DataFrame:
    """(path, content) of the string files that are referred to; the others are listed, but never opened.

    The names of the chosen files, not their contents, pass through the driver, as
    in any listing of Spark's.
    """
    if needed is None:
        return files(spark, roots, kind)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path")
    paths = [r["path"] for r in wanted(listed.where(file_kind(F.col("path")) == kind), kind, needed).select("path").collect()]
    return files(spark, sorted(paths), kind) if paths else files(spark, roots, kind).where("false")


def referenced(records: DataFrame) -> DataFrame:
    """(uuid): the string files that records can refer to, by their processes, loaded images and events."""
    people = records.where("kind = 'catalog'").select(F.explode("catalog.processes").alias("p"))
    named = people.select(F.explode(F.array_union(F.array("p.main_uuid", "p.dsc_uuid"), F.col("p.images.uuid"))).alias("uuid"))
    relative = records.where("kind = 'firehose'").select(F.explode(F.array_distinct("firehose.events.uuid_relative")).alias("uuid"))
    return named.unionByName(relative).where("uuid <> ''").distinct()


def staged(records: DataFrame, folder: str) -> DataFrame:
    """The records, decoded once and written by kind: a reader of one kind opens that kind's files and columns only."""
    records.write.partitionBy("kind").parquet(folder)
    return records.sparkSession.read.schema(records.schema).parquet(folder).select(*records.columns)


def with_base(ranges: list[dict]) -> int:
    """Gives each range its base, the sum of the sizes before it, and returns the sum of all."""
    base = 0
    for r in ranges:
        r["base"] = base
        base += r["size"]
    return base


def uuidtext_of(source: DataFrame, needed: DataFrame | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """String files: uuid (32 digits), image path, ranges and the bytes they cut. needed: (uuid) to read only those."""

    def rows(path: str, content: bytes) -> Iterator[dict]:
        found = codec.uuidtext(content)
        at = with_base(found["entries"])
        if at > len(found["footer"]):
            raise codec.Malformed("path lies outside the file")
        yield {"uuid": "".join(path.split("/")[-2:]).upper(), "path": path, "image": codec.text_to_zero(found["footer"][at:]), **found}

    return decoded(wanted(source, "UUIDText", needed).select("path", "content"), "UUIDText", schemas.UUIDTEXT_DDL, rows, mode.upper() == "FAILFAST")


def uuidtext(spark: SparkSession, roots: str | list[str], needed: DataFrame | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    return uuidtext_of(only_needed(spark, roots, "UUIDText", needed), None, mode)


def dsc_of(source: DataFrame, needed: DataFrame | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Shared string files: uuid, ranges, images; content has the ranges' bytes in their order."""

    def rows(path: str, content: bytes) -> Iterator[dict]:
        found = codec.shared_strings(content)
        with_base(found["ranges"])
        yield {"uuid": path.split("/")[-1].upper(), "path": path, "ranges": found["ranges"], "images": found["images"], "content": b"".join(r["data"] for r in found["ranges"])}

    return decoded(wanted(source, "Dsc", needed).select("path", "content"), "Dsc", schemas.DSC_DDL, rows, mode.upper() == "FAILFAST")


def dsc(spark: SparkSession, roots: str | list[str], needed: DataFrame | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    return dsc_of(only_needed(spark, roots, "Dsc", needed), None, mode)
