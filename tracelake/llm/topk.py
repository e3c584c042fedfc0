"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows over integer terms. For one cell (a block of queries, a
block of candidates) every term's postings are scattered, weighted by each query
that holds the term, into a dense score array; partition selection keeps the k
best of the cell and a merge over cells keeps the k best of all. The blocks have
bounded size, so a cell has bounded memory whatever the input.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; a missing term counts as zero, so shorter and
empty vectors score zero there; repeated candidate rows count one by one; of
several query rows with one id the smallest vector is taken; ties go to the
smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import blocks, table

BLOCK, QUERY_BLOCK = 1024, 1024
SCHEMA = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision; null where the vector takes no part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an array column as a matrix, short ones filled with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries against all candidates of a cell, term by term."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(queries.shape[1]):
        weight, posting = queries[:, term], candidates[:, term]
        rows, hits = np.flatnonzero(weight), np.flatnonzero(posting)
        if 2 * len(hits) > len(posting):
            if 2 * len(rows) > len(weight):
                scores += weight[:, None] * posting[None, :]
            else:
                scores[rows] += weight[rows, None] * posting[None, :]
        elif len(rows) and len(hits):
            scores[np.ix_(rows, hits)] += weight[rows, None] * posting[None, hits]
    return scores


def cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return empty
        right = right.sort_by("id")
        width = max(int(np.diff(t["q"].combine_chunks().offsets.to_numpy()).max()) for t in (left, right))
        asked, ids = left["id"].to_numpy(), right["id"].to_numpy()
        scores = accumulate(dense(left["q"], width), dense(right["q"], width))
        out = []
        for i, query in enumerate(asked):
            other = np.flatnonzero(ids != query)
            s = scores[i, other]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                best = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
            else:
                best = np.arange(len(s))
            out.append((np.full(len(best), query), ids[other[best]], s[best]))
        return pa.table({n: pa.array(np.concatenate([o[j] for o in out]), pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best candidates of each query, as (query_id, rank, vec_id, score).

    Both inputs have id long and q array<long>. Queries are dealt to every
    candidate block, each cell being one bounded task.
    """
    n, asked = candidates.count(), queries.groupBy("id").agg(F.min("q").alias("q"))
    n_blocks, q_blocks = blocks(n, block), blocks(asked.count(), query_block)
    left = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    right = candidates.withColumn("cb", F.pmod(F.xxhash64("id", "q"), F.lit(n_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    parts = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(cell(k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of every embedding whose vec_id is divisible by 50, against all others."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding"), 256).alias("q")).where("id is not null and q is not null")
    return top_k(rows.where("id % 50 = 0"), rows)


OP9_SQL = """
WITH q AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS query_id, b.id AS vec_id,
         CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.id <> b.id WHERE a.id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
