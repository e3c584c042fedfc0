"""SimHash near-dedup with deletion-variant signatures.

A fingerprint's 64 bits are cut into three segments. Two fingerprints that
differ in at most four bits have a segment that differs in at most one, because
three segments with two or more differing bits each make six. So every segment
is indexed with each of its bits deleted in turn (64 variants in all): segments
that differ in at most one bit share a variant. Variants are joined by equality
and the whole fingerprints verified.

Equal fingerprints are one before that. In a bucket, links are reduced to a
forest over its fingerprints, so a group of many near copies gives as many edges
as it has members. Buckets of more than some two thousand fingerprints are cut
into chunks, and each pair of chunks is its own bounded cell, so no bucket is
gathered in one task and no pair is lost.

Defined cases: null and empty texts and texts of white space have fingerprint
zero, linked like any other; fewer than four words are one shingle; a null
doc_id is never a component's id unless all are null; repeated rows each get
their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import near
from tracelake.llm.bpe import slices, with_column
from tracelake.llm.common import blocks, components, cut, equal_runs, roots, small_batches, table, tidy

SHINGLE, DISTANCE = 4, 4
SEGMENTS = [(0, 21), (21, 21), (42, 22)]
HALF, AT_ONCE, SMALL, BLOCK_BYTES, FPS_PER_TASK = 1024, 200_000, 20_000, 2_000_000, 20_000
LANES = np.uint64(0x0101010101010101)


def fingerprints(hashes: list[list[int]] | list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list: bit set where over half of the hashes have it.

    Bits are counted eight at a time in byte lanes over runs of at most 255 hashes.
    """
    lengths = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    flat = np.concatenate([np.array(own, np.uint64) for own in hashes])
    lengths = lengths[full]
    starts = np.cumsum(lengths) - lengths
    runs = -(-lengths // 255)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    found = np.zeros(len(full), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(bit)) & LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for lane in range(8):
            found |= (2 * counts[:, lane] > lengths).astype(np.uint64) << np.uint64(8 * lane + bit)
    out[full] = found
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with the fingerprint of the text as a long (its bits, signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, BLOCK_BYTES):
                found = fingerprints([near.shingle_hashes(t, SHINGLE) for t in batch.column(text).to_pylist()])
                kept = batch.drop_columns([text])
                yield with_column(kept, name, pa.array(found.view(np.int64)))

    kept = [f for f in docs.schema.fields if f.name != text]
    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), T.StructType([*kept, T.StructField(name, T.LongType())]))


def variants(fps: DataFrame) -> DataFrame:
    """(fp, key) for every segment and deleted bit; key says which, and what is left."""
    keys = []
    for s, (at, width) in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1)
        keys += [segment.bitwiseAND(((1 << width) - 1) ^ (1 << i)) + F.lit((s * 22 + i) << 22) for i in range(width)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def crowded(fps: DataFrame) -> DataFrame:
    """(key, chunks) of the variants that may hold more than 2 * HALF fingerprints.

    A variant unites two segment values, so counts of the three segment values
    bound it; at most three rows a thousand fingerprints come out of this.
    """
    values = [F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1).alias("v")) for s, (at, width) in enumerate(SEGMENTS)]
    many = fps.select(F.explode(F.array(*values)).alias("x")).select("x.*").groupBy("s", "v").agg(F.count("*").alias("n")).where(F.col("n") > HALF)
    widths = F.element_at(F.array(*[F.lit(w) for _, w in SEGMENTS]), F.col("s") + 1)
    many = many.withColumn("i", F.explode(F.sequence(F.lit(0), widths - 1)))
    key = F.col("v").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, i)"))) + F.expr("shiftleft(CAST(s * 22 + i AS BIGINT), 22)")
    return many.groupBy(key.alias("key")).agg(F.ceil((F.sum("n") + HALF) / (2 * HALF)).cast("long").alias("chunks"))


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a forest over the fingerprints that rows with equal cells link."""

    def forest(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(fps, return_inverse=True)
        a, b = [], []
        for i, j in equal_runs(cells):
            near = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[j]) <= DISTANCE)
            if len(near):
                a.append(at[i[near]])
                b.append(at[j[near]])
        top = roots(len(nodes), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(nodes))
        edge = np.flatnonzero(top != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[edge].view(np.int64)), pa.array(nodes[top[edge]].view(np.int64))], names=["a", "b"])

    cells, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        parts.append((batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
        if sum(len(p[0]) for p in parts) >= AT_ONCE:
            cells, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            open_from = int(np.searchsorted(cells, cells[-1]))
            if open_from:
                yield forest(cells[:open_from], fps[:open_from])
            parts = [(cells[open_from:], fps[open_from:])]
    if parts:
        yield forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def near_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints at most DISTANCE bits apart."""
    many = cut(crowded(fps))
    n = many.count()
    # One fingerprint makes 64 rows, so tasks are as many as those need; a number given is not reduced by AQE.
    rows = variants(fps.repartition(blocks(fps.count(), FPS_PER_TASK), "fp"))
    if n:
        # Broadcast only while small; beyond, Spark joins by shuffle.
        rows = rows.join(F.broadcast(many) if n <= SMALL else many, "key", "left")
        chunk, other = F.pmod(F.xxhash64("fp"), F.col("chunks")), F.explode(F.expr("sequence(0L, coalesce(chunks, 1L) - 1L)"))
        rows = rows.withColumn("mine", F.coalesce(chunk, F.lit(0))).withColumn("other", other)
        pair = F.greatest("mine", "other") * (F.greatest("mine", "other") + 1) / 2 + F.least("mine", "other")
        rows = rows.select("fp", (F.expr("shiftleft(key, 34)") + pair.cast("long")).alias("cell"))
    else:
        rows = rows.select("fp", F.expr("shiftleft(key, 34)").alias("cell"))
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(linked), "a long, b long").distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(fp, component_id) for rows of (doc_id, fp): the smallest doc_id reachable by links."""
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(near_links(fps.select("fp")))
    fps = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = cut(fps.groupBy("component").agg(F.min("least").alias("component_id")))
    return cut(fps.join(names, "component").select("fp", "component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each group of near copies with the smallest id (null first), ties by a hash of the text.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more, and what such pairs connect (near.py); texts without words are one group. Of rows equal
    in id and text one stays. Ids may be of any type that has an order.
    """
    first = near.first_of_groups(docs, doc_id, text, fingerprints, near_links)
    value = F.coalesce(F.col(text), F.lit(""))
    # Keys without nulls, so that one shuffle serves both steps.
    named = lambda i: {"__none": i.isNull(), "__id": F.coalesce(i.cast("string"), F.lit(""))}
    rows = docs.withColumns(named(F.col(doc_id)) | {"__t1": F.xxhash64(value), "__t2": F.xxhash64(F.lit(2), value)})
    first = first.withColumns(named(F.col("id"))).select("__none", "__id", F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    key = ["__none", "__id", "__t1", "__t2"]
    return rows.dropDuplicates(key).join(cut(first), key, "left_semi").select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = cut(with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.join(classes(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
