"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of other bytes than ASCII white space, as bytes.split() gives them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracelake-"))
    return sc.getCheckpointDir()


#: Seconds until the JVM is told of all plans that Python has dropped: py4j does so in a thread that looks once a second.
TOLD_S = 1.2


def release(spark: SparkSession, told: bool = False) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any more.

    Spark deletes them once the driver's JVM has collected their plans. Left to itself that
    comes late, and until then the files of all steps before take disk beside the next one's.
    told waits until plans dropped just now count as well: for steps right after one with large files.
    """
    gc.collect()
    if told:
        time.sleep(TOLD_S)
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, told: bool = False) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    The folder is the cluster's spark.checkpoint.dir; a folder of our own is set
    only where none is (tests in local mode). What earlier steps shuffled goes first; told: also that of the last one.
    """
    shared_folder(df.sparkSession)
    release(df.sparkSession, told)
    return df.checkpoint()


#: Rows up to which a checkpointed table of a few plain columns is broadcast.
BROADCAST_ROWS = 20_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it was counted and is small; else Spark joins it by shuffle.

    df should be a checkpoint, so that counting is cheap.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


ARROW_BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, so that long texts never make a batch large on either side."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = (spark.conf.get(name, None) or "").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    size = text.rstrip("kmg")
    if not size.lstrip("-").isdigit() or not 0 < int(size) * unit <= ARROW_BATCH:
        spark.conf.set(name, str(ARROW_BATCH))


def thin(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about as many bytes as most."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, most))) if batch.num_rows else 1
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def tidy(run):
    """A mapInArrow function that gives memory back to the system when its task ends.

    Python workers live on after a task; without this each would keep the most it
    ever held beside the next stage's needs.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


class RangeBins:
    """Bins of nearly equal mass over a binary or string sort key.

    There are 16 to 64 groups of as many bins, by the number of keys, so at most
    4,096 bins. Boundaries are quantiles of the 16
    keys a bin with the smallest hash, cut to 256 bytes: a bounded set, so it fits
    in the plan as a literal. Any boundaries give right results; they only decide
    how even the bins are. A row finds its bin by comparing with the groups, then
    within one.
    """

    PER_BIN, LEAST, MOST = 50_000, 16, 64

    def __init__(self, keys: DataFrame, column: str):
        self.ways = min(self.MOST, max(self.LEAST, math.ceil(math.sqrt(keys.count() / self.PER_BIN))))
        n = self.ways**2
        sample = keys.select(F.substring(F.col(column), 1, 256).alias("k")).where("k is not null")
        rows = sample.orderBy(F.xxhash64("k"), "k").limit(16 * n).collect()
        found = sorted(bytes(r[0]) for r in rows)
        self.bounds = sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []

    def of(self, key: Column) -> Column:
        parts = [self.bounds[i : i + self.ways] for i in range(0, len(self.bounds), self.ways)]
        if not parts:
            return F.lit(0)
        below = lambda values: F.size(F.filter(values, lambda b: b <= key))
        array = lambda values: F.array(*[F.lit(bytearray(v)) for v in values])
        coarse = below(array([p[0] for p in parts]))
        fine = F.array(F.array().cast("array<binary>"), *[array(p) for p in parts])
        return (F.greatest(coarse - 1, F.lit(0)) * self.ways + below(F.element_at(fine, coarse + 1))).cast("int")


def equal_runs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with equal keys in a sorted array, by growing distance.

    Each yield holds at most len(keys) pairs, so memory stays linear in the rows.
    """
    at = np.flatnonzero(keys[1:] == keys[:-1])
    d = 1
    while len(at):
        yield at, at + d
        d += 1
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


#: Edges up to which one task, which then holds some 100 MB, finds all components.
FEW_EDGES = 1_000_000


def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    top = roots(len(nodes), at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds; in one task if the edges, counted before, are few.

    edges has longs a and b. Returns (node, component) for every node of an edge,
    component being the smallest node reachable. Minima are taken by partial
    aggregates and joined back through shuffles that Spark can split, so a node
    with very many neighbours does not land in one task. Each round is cut by a
    reliable checkpoint.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    if e.count() <= FEW_EDGES:
        return e.coalesce(1).mapInArrow(tidy(in_one_task), "node long, component long")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(large.distinct())
        least = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        small = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def blocks(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def running(partition: list[str], order: list[str]):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
