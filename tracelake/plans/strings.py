"""Format strings and image paths: which file and offset an event means, and the lookup.

The router is column arithmetic. Lookups are reduced to distinct (file, kind
of lookup, offset) first. Which range holds an offset is an interval join of offsets and
ranges, without any bytes; the places found in a file then meet its bytes in one
row, so each blob is shipped once, and the texts are joined back by equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.ranges import range_hits
from tracelake.sources.codec import text_to_zero

SHARED, ABSOLUTE, RELATIVE, MAIN, DYNAMIC = "shared", "absolute", "relative", "main", "dynamic"
DYNAMIC_BIT = 0x80000000
NO_UUID = "0" * 32


def route(kind: Column) -> Column:
    """Which lookup an event takes; logs send every large shared cache to the shared file, others only with a large offset."""
    large = (F.col("large_shared_cache") != 0) & ((kind == 4) | (F.col("large_offset") != 0))
    other = F.when(F.col("absolute"), ABSOLUTE).when(F.col("uuid_relative") != "", RELATIVE).otherwise(MAIN)
    return F.when(kind == 3, MAIN).when(F.col("shared_cache") | large, SHARED).otherwise(other)


def shared_offset(raw: Column, large: Column, cache: Column) -> Column:
    """The offset with its high part, from the large-offset and large-cache fields."""
    base = F.when(large.isin(1, 2) & (large > cache), large.cast("bigint") * 0x80000000)
    base = base.when(cache != 0, F.floor(cache / 2).cast("bigint") * 0x100000000).otherwise(large.cast("bigint") * 0x100000000)
    return raw + F.when(large != 0, base).otherwise(0)


def absolute_address(alt_index: Column, pc: Column) -> Column:
    return alt_index.cast("bigint") * 0x100000000 + pc


def routed(events: DataFrame) -> DataFrame:
    """events with route, raw_offset, offset and address (absolute route only)."""
    kind = F.col("activity_type")
    raw = F.col("format_location")
    events = events.withColumn("route", F.when(kind.isin(2, 3, 4, 6), route(kind)))
    events = events.withColumn("offset", F.when(F.col("route") == SHARED, shared_offset(raw, F.col("large_offset"), F.col("large_shared_cache"))).otherwise(raw))
    return events.withColumns({
        "address": F.when(F.col("route") == ABSOLUTE, absolute_address(F.col("alt_index"), F.col("pc_id"))),
        # Traces are never dynamic.
        "dynamic": (raw.bitwiseAND(DYNAMIC_BIT) != 0) & (kind != 3),
    })


def text_ranges(uuidtext: DataFrame) -> DataFrame:
    """(file_uuid, lookup, at, low, size, base, upto, image_at): the ranges of string files, cut to the bytes there are.

    A relative offset is not checked against the place of its range.
    """
    each = uuidtext.select(F.col("uuid").alias("file_uuid"), F.length("footer").alias("length"), F.posexplode("entries").alias("at", "e"), F.array(F.lit(RELATIVE), F.lit(MAIN)).alias("both"))
    each = each.select("file_uuid", "length", "at", "e.*", F.explode("both").alias("lookup"))
    room = F.col("length") - F.when(F.col("lookup") == RELATIVE, 0).otherwise(F.col("base"))
    none = F.lit(None).cast("bigint")
    return each.select("file_uuid", "lookup", "at", F.col("start").alias("low"), F.least("size", room).alias("size"), "base", none.alias("upto"), none.alias("image_at"))


def shared_ranges(dsc: DataFrame) -> DataFrame:
    """The same of shared string files; the end of a range is not in it, and a text ends with its range."""
    each = dsc.select(F.col("uuid").alias("file_uuid"), F.lit(SHARED).alias("lookup"), F.posexplode("ranges").alias("at", "r"))
    upto = F.col("r.base") + F.col("r.size")
    return each.select("file_uuid", "lookup", "at", F.col("r.low").alias("low"), (F.col("r.size") - 1).alias("size"), F.col("r.base").alias("base"), upto.alias("upto"), F.col("r.image").alias("image_at"))


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a file (uuid, blob) and its asked (lookup, point, position, upto, image_at) to the text there; upto is null for the file's end."""
    names = ["file_uuid", "lookup", "point", "image_at", "text"]
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        out = []
        for uuid, blob, asked in zip(*(batch.column(c) for c in ("uuid", "blob", "asked")), strict=True):
            view = memoryview(blob.as_buffer())
            for a in asked.as_py():
                begin, end = a["position"], len(view) if a["upto"] is None else min(a["upto"], len(view))
                text = text_to_zero(bytes(view[begin:end])) if begin is not None and begin <= len(view) else None
                out.append((uuid.as_py(), a["lookup"], a["point"], a["image_at"], text))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def resolved(asked: DataFrame, uuidtext: DataFrame, dsc: DataFrame) -> DataFrame:
    """Distinct asked (file_uuid, lookup, point) of files that exist, with text (null where no range fits), image, image_id, ranges and bad.

    A dynamic offset of a shared file, like one that no range holds, has the
    library of the first range.
    """
    hits = range_hits(asked, text_ranges(uuidtext).unionByName(shared_ranges(dsc)), ["file_uuid", "lookup"], "point")
    hits = hits.withColumn("position", F.col("base") + F.col("point") - F.col("low")).withColumn("shared", F.col("lookup").isin(SHARED, DYNAMIC))
    places = hits.groupBy(F.col("file_uuid").alias("uuid"), "shared").agg(F.collect_list(F.struct("lookup", "point", "position", "upto", "image_at")).alias("asked"))
    blobs = uuidtext.select("uuid", F.lit(False).alias("shared"), F.col("footer").alias("blob")).unionByName(dsc.select("uuid", F.lit(True).alias("shared"), F.col("content").alias("blob")))
    texts = blobs.join(places, ["uuid", "shared"]).mapInArrow(cut_texts, "file_uuid string, lookup string, point bigint, image_at bigint, text string")
    shared = dsc.select(F.col("uuid").alias("file_uuid"), "images", (F.size("ranges") > 0).alias("ranges"), F.get("ranges.image", F.lit(0)).alias("first_image"))
    texts = texts.join(shared, "file_uuid", "left")
    of_shared = F.col("lookup").isin(SHARED, DYNAMIC)
    at = F.when(of_shared, F.coalesce("image_at", "first_image"))
    known = (at >= 0) & (at < F.size("images"))
    own = F.when(known, F.get("images", F.when(known, at).otherwise(0).cast("int")))
    bad = F.coalesce(at.isNotNull() & ~known, F.lit(False))
    text = F.when(bad, "Error: Invalid UUID index").otherwise(F.col("text"))
    return texts.select("file_uuid", "lookup", "point", text.alias("found"), own["path"].alias("image"), own["uuid"].alias("image_id"), (~of_shared | F.coalesce("ranges", F.lit(False))).alias("ranges"), bad.alias("bad"))


def with_strings(events: DataFrame, uuidtext: DataFrame, dsc: DataFrame) -> DataFrame:
    """Routed events with raw_message, library, library_uuid, process and process_uuid.

    events needs route, offset, dynamic, main_uuid, dsc_uuid, uuid_relative and image_uuid.
    """
    r = F.col("route")
    file_uuid = F.when(r == SHARED, F.col("dsc_uuid")).when(r == ABSOLUTE, F.coalesce("image_uuid", F.lit(""))).when(r == RELATIVE, F.col("uuid_relative")).when(r == MAIN, F.col("main_uuid"))
    events = events.withColumn("file_uuid", file_uuid)
    lookup = F.when(r == SHARED, F.when(F.col("dynamic"), DYNAMIC).otherwise(SHARED)).when(r == RELATIVE, RELATIVE).otherwise(MAIN)
    point = F.when(r == MAIN, F.col("offset").bitwiseAND(0xFFFFFFFF)).otherwise(F.col("offset"))
    key = ["file_uuid", "lookup", "point"]
    events = events.withColumns({"lookup": lookup, "point": point})
    found = resolved(events.where("file_uuid <> ''").select(*key).distinct(), uuidtext, dsc)
    # Paths of images are few and short; files without bytes would do.
    paths = uuidtext.select(F.col("uuid").alias("path_uuid"), F.col("image").alias("path"))
    joined = events.join(found, key, "left").join(paths.withColumnRenamed("path_uuid", "main_uuid").withColumnRenamed("path", "__process"), "main_uuid", "left")
    joined = joined.join(paths.withColumnRenamed("path_uuid", "file_uuid").withColumnRenamed("path", "__file"), "file_uuid", "left")
    has_file = F.when(r == SHARED, F.coalesce("ranges", F.lit(False))).otherwise(F.col("__file").isNotNull())
    kind = F.when(r == ABSOLUTE, "absolute ").when(r == RELATIVE, "alternative ").otherwise("")
    offset_of = F.col("offset").cast("string")
    dynamic = F.col("dynamic") | ((r == ABSOLUTE) & (F.col("offset") == F.col("address")))
    missing = F.when(r == SHARED, F.lit("Unknown shared string message")).otherwise(F.concat(F.lit("Failed to get string message from "), kind, F.lit("UUIDText file: "), F.col("file_uuid")))
    wrong = F.when(r == SHARED, F.lit("Error: Invalid shared string offset")).otherwise(F.concat(F.lit("Error: Invalid offset "), offset_of, F.lit(" for "), kind, F.lit("UUID "), F.col("file_uuid")))
    text = F.when(r.isNull(), "").when(F.coalesce("bad", F.lit(False)), F.col("found")).when(~has_file, missing).when(dynamic, "%s").otherwise(F.coalesce("found", wrong))
    unknown = F.concat(F.lit("Failed to get path string from UUIDText file for entry: "), F.col("main_uuid"))
    process = F.when(F.col("main_uuid") == NO_UUID, "").otherwise(F.coalesce("__process", unknown))
    # Where no file was found nothing else is known; the main route shows the file's own path.
    known = has_file & ~F.coalesce("bad", F.lit(False))
    columns = {
        "raw_message": text,
        "library": F.when(known, F.when(r == SHARED, F.coalesce("image", F.lit(""))).otherwise(F.col("__file"))).otherwise(""),
        "library_uuid": F.when(r == SHARED, F.when(known, F.coalesce("image_id", F.lit(""))).otherwise("")).otherwise(F.coalesce("file_uuid", F.lit(""))),
        "process": F.when(known, F.when(r == MAIN, F.col("__file")).otherwise(process)).otherwise(""),
        "process_uuid": F.when(r.isNull(), "").when((r == SHARED) & ~known, "").otherwise(F.col("main_uuid")),
    }
    return joined.withColumns(columns).drop("found", "image", "image_id", "ranges", "bad", "__process", "__file", "file_uuid", "lookup", "point")
