"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are turned by random rotations and reduced to sign bits; with each
code its correction factor is stored, the inner product of the turned vector and
its code. The inner product of one vector's code, of the first rotation, with
the other turned vector, divided by the factor, estimates the cosine without bias; the
part of the vector that the code misses bounds the error. Only pairs whose upper bound reaches
the threshold, from either side, are recomputed in double precision, and only recomputed pairs link.

Candidates are vectors whose codes agree in a band of bits. Bits per band grow
with the logarithm of the number of vectors and the number of bands so that a
pair right at the threshold shares a band with probability RECALL; closer pairs
do so with more. A pair is counted in the first band it shares only. Bands
whose bucket has one vector leave before vectors are moved, and buckets of many
are cut into chunks whose pairs are bounded cells of their own. In a cell, links
become counts and a forest, never a row for each pair.

Equal vectors are one before all that and count with their number.

Defined cases: vectors that are null, empty or zero or hold null or non-finite
components link with nothing and keep their row; shorter vectors are padded with
zeros; repeated rows are vectors of their own; a row without an id keeps its row
and takes its component from the others' ids (null if there are none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import components, cut, equal_runs, roots, table

THRESHOLD, RECALL, SEED, BOUND = 0.9, 0.95, 7, 4.0
CHUNK, AT_ONCE = 1024, 50_000
PAIRS = 500_000


def bands_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits per band and number of bands for n vectors."""
    bits = max(16, math.ceil(math.log2(max(n, 2))) + 4)
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - share))


def rotations(dim: int, bits: int) -> np.ndarray:
    """A dim x bits matrix of random orthogonal blocks."""
    rng = np.random.default_rng(SEED)
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(blocks, axis=1)[:, :bits]


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def coded(dim: int, bits: int, bands: int):
    """Rows (rid, vector) to (rid, code, factor, keys): keys has one long a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim, max(dim, bits * bands))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                turned = unit_rows(part.column("vector"), dim) @ turn
                sign = turned[:, : bits * bands] > 0
                factor = np.abs(turned[:, :dim]).sum(axis=1) / math.sqrt(dim)
                keys = sign.reshape(len(sign), bands, bits) @ weights
                code = np.packbits(sign, axis=1)
                lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), lists], names=["rid", "code", "factor", "keys"])

    return run


def estimates(sign: np.ndarray, factor: np.ndarray, turned: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines, row by row, of vectors given as codes (+1, -1) and factors with turned unit vectors, and upper bounds.

    With the code as a unit vector c and f = <c, x>, <c, y> / f estimates <x, y>: its error is the inner product of y
    with what of c is at right angles to x, over f, whose direction a random rotation makes random.
    """
    dim = sign.shape[1]
    estimate = np.einsum("ij,ij->i", sign, turned) / math.sqrt(dim) / factor
    return estimate, estimate + bound * np.sqrt(np.maximum(1 - factor * factor, 0)) / factor / math.sqrt(max(dim - 1, 1))


def linked(dim: int, bits: int, bands: int, threshold: float):
    """Counts (a, a, n) and forest edges (a, b, 0) of the cells."""
    turn = rotations(dim, dim)

    def cells(cell: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        band, mine, rid, copies = (rows.column(c).to_numpy() for c in ("band", "mine", "rid", "copies"))
        cross, factor = rows.column("cross").to_numpy(zero_copy_only=False), rows.column("factor").to_numpy()
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)
        unit = unit_rows(rows.column("vector").combine_chunks(), dim)
        turned = (unit @ turn).astype(np.float32)
        sign = np.where(turned > 0, np.float32(1), np.float32(-1))
        nodes, at = np.unique(rid, return_inverse=True)
        count, a, b = np.zeros(len(nodes), np.int64), [], []
        for every_i, every_j in equal_runs(cell):
            for k in range(0, len(every_i), PAIRS):
                i, j = every_i[k : k + PAIRS], every_j[k : k + PAIRS]
                ok = (band[i] == band[j]) & ((mine[i] != mine[j]) | ~cross[i])
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                for x in range(0, len(i), 4096):
                    p, q = i[x : x + 4096], j[x : x + 4096]
                    upper = np.minimum(estimates(sign[p], factor[p], turned[q])[1], estimates(sign[q], factor[q], turned[p])[1])
                    near = upper >= threshold
                    p, q = p[near], q[near]
                    apart = np.unpackbits(code[p] ^ code[q], axis=1, count=bits * bands).reshape(len(p), bands, bits).any(axis=2)
                    own = np.argmin(apart, axis=1) == band[p]
                    p, q = p[own], q[own]
                    exact = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                    p, q = p[exact], q[exact]
                    np.add.at(count, at[p], copies[q])
                    np.add.at(count, at[q], copies[p])
                    a.append(at[p])
                    b.append(at[q])
        top = roots(len(nodes), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(nodes))
        edge, some = np.flatnonzero(top != np.arange(len(nodes))), np.flatnonzero(count)
        columns = [np.concatenate([nodes[edge], nodes[some]]), np.concatenate([nodes[top[edge]], nodes[some]]), np.concatenate([np.zeros(len(edge), np.int64), count[some]])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for batch in batches:
            parts.append(pa.Table.from_batches([batch]))
            if sum(len(p) for p in parts) >= AT_ONCE:
                rows = pa.concat_tables(parts).combine_chunks()
                cell = rows.column("cell").to_numpy()
                open_from = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
                if open_from:
                    yield cells(cell[:open_from], rows.slice(0, open_from))
                parts = [rows.slice(open_from)]
        if parts and sum(len(p) for p in parts):
            rows = pa.concat_tables(parts).combine_chunks()
            yield cells(rows.column("cell").to_numpy(), rows)

    return run


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of df."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.transform("vector", lambda x: x.cast("double") + 0.0)))
    once = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # Ids of classes are stable, because the classes are a checkpoint.
    once = cut(cut(once).withColumn("rid", F.monotonically_increasing_id()))
    n, dim = once.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    bits, bands = bands_for(n, threshold)
    codes = cut(once.select("rid", "vector").mapInArrow(coded(dim, bits, bands), "rid long, code binary, factor double, keys array<long>"))
    keyed = codes.select("rid", F.posexplode("keys").alias("band", "key"))
    crowd = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    places = keyed.join(crowd, ["band", "key"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    places = places.withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("chunks"))).withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1L)")))
    cell = F.xxhash64("band", "key", F.least("mine", "other"), F.greatest("mine", "other"))
    places = places.select("rid", "band", cell.alias("cell"), "mine", (F.col("mine") != F.col("other")).alias("cross"))
    full = places.join(once.select("rid", "vector", "copies").join(codes.select("rid", "code", "factor"), "rid"), "rid")
    found = cut(full.repartition("cell").sortWithinPartitions("cell", "rid").mapInArrow(linked(dim, bits, bands, threshold), "a long, b long, n long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
    nodes = components(found.where("a <> b").select("a", "b"))
    classes = once.join(counts, "rid", "left").join(nodes.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    names = cut(classes.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = cut(classes.join(names, "component").select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = rows.join(classes, "vector", "left").withColumn("component_id", F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at cosine 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
