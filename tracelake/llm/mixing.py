"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target comes from its weight and is capped at three times its
size; the excess is shared again by weight until no target is above its cap.
A target of e whole sizes and a rest is met by e complete epochs of the source,
then a fractional selection: documents in the order of exponential keys -ln(u)/w,
u from a hash of the id and w the document's quality weight, until the prefix sum
of their sizes reaches the rest. The document on that edge is taken in part, so
a source's words equal its rounded target.

Prefix sums go through bins of the key of about a thousand documents: sums over
bins first, then rows only in the bin that holds the edge. So no source, however
large, is sorted in one task. Documents are read once into a slim checkpoint.

Defined cases: null text has size zero; a null source is a source of its own and
comes last; sources of size zero have target zero; a null id hashes as empty
text; repeated rows are taken each for itself (ties by id, then size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, cut, small, table

WEIGHTS, CAP, PER_BIN = (5, 2, 1), 3, 1024


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to (skey, source_size); one row a source, skey in mixing order.

    The level at which weights are met is found in one pass: sources sorted by
    cap to weight reach their caps in that order.
    """
    by_key = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.row_number().over(by_key) - 1) % len(WEIGHTS) + 1)
    s = sources.withColumn("w", w).withColumn("cap", CAP * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.col("capped")) / F.col("open"))
    # The first source whose cap is at or above its share at this level, and all after it, are not capped.
    s = s.withColumn("free", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "skey", "level"))).over(whole))
    share = F.when(F.struct(F.col("cap") / F.col("w"), "skey") >= F.struct("free.col1", "free.skey"), F.col("w") * F.col("free.level")).otherwise(F.col("cap"))
    return s.withColumn("target", F.least(share, F.col("cap")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, epochs) of every row of docs.

    weights has (doc_id, weight), unique ids and positive weights; documents
    without one weigh 1. Texts are reduced to sizes before any row is moved.
    """
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 1) / (2.0**52 + 1)
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (-F.log(u)).alias("key"),
    )
    if weights is not None:
        w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
        slim = slim.join(weights, "doc_id", "left").withColumn("key", F.col("key") / w).drop("weight")
    slim = cut(slim)
    plan = targets(slim.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", (F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    plan = cut(plan.select("skey", "source_size", "target", "epochs", "rest", F.greatest(F.lit(1), F.ceil(F.col("n") / PER_BIN)).alias("bins")))
    dealt = slim.join(small(plan), "skey").withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("bins")), F.col("bins") - 1))
    sums = dealt.groupBy("skey", "bin", "rest").agg(F.sum("size").alias("s"))
    upto = F.sum("s").over(Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    # The edge is in the first bin whose prefix sum passes the rest; documents in earlier bins are all taken.
    edge = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("skey").agg(F.min(F.struct("bin", (F.col("upto") - F.col("s")).alias("before"))).alias("edge"))
    dealt = dealt.join(small(cut(edge)), "skey", "left")
    here = F.col("bin") == F.col("edge.bin")
    order = Window.partitionBy("skey", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("edge.before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.col("rest") - first, F.lit(0)))
    on_edge = dealt.where(here).withColumn("part", part)
    off_edge = dealt.where(~F.coalesce(here, F.lit(False))).withColumn("part", F.when(F.col("edge.bin").isNull() | (F.col("bin") < F.col("edge.bin")), F.col("size")).otherwise(0))
    return on_edge.unionByName(off_edge).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 where labels call a document good, 0.5 where bad."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.when(F.avg("quality") >= 0.5, 2.0).otherwise(0.5).alias("weight"))


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, whole: the document on a source's edge once more if half of it is taken.

    Of rows equal in id and text each is given as often as the one taken most.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    rows = docs.withColumn("__key", key)
    weights = quality_weights(labels)
    weighed = rows.select("__key", "doc_id").join(weights, "doc_id").groupBy("__key").agg(F.max("weight").alias("weight"))
    taken = mix(rows.select("__key", "text", "source"), doc_id="__key", weights=weighed.withColumnRenamed("__key", "doc_id"))
    part = F.col("taken") - F.col("epochs") * F.col("size")
    times = (F.col("epochs") + ((part > 0) & (2 * part >= F.col("size"))).cast("long")).alias("__times")
    times = cut(taken.select(F.col("doc_id").alias("__key"), times).groupBy("__key").agg(F.max("__times").alias("__times")).where("__times > 0"))
    return rows.join(times, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, weights=quality_weights(table(spark, sf_dir, "labels"))).drop("source", "epochs")


OP5_SQL = r"""
WITH q AS (
  SELECT doc_id, CASE WHEN avg(quality) >= 0.5 THEN 2.0 ELSE 0.5 END AS qw FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT d.doc_id, d.source, CASE WHEN d.source IS NULL THEN '1' ELSE '0' || d.source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 1) / (2.0::DOUBLE ** 52 + 1)) / coalesce(qw, 1.0)::DOUBLE AS key
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id
), s AS (
  SELECT skey, CAST(sum(size) AS DOUBLE) AS z, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY skey
), l AS (
  SELECT *, (sum(z) OVER () - coalesce(sum(3 * z) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level,
         row_number() OVER (ORDER BY 3 * z / w, skey) AS n
  FROM s WINDOW b AS (ORDER BY 3 * z / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT min(n) AS n, arg_min(level, n) AS level FROM l WHERE 3 * z >= level * w
), t AS (
  SELECT skey, CAST(z AS BIGINT) AS source_size, least(CASE WHEN l.n >= f.n THEN w * f.level ELSE 3 * z END, 3 * z) AS target FROM l CROSS JOIN f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), c AS (
  SELECT d.doc_id, d.size, e.*, CAST(round(target) AS BIGINT) - epochs * source_size AS rest,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior
  FROM d JOIN e ON d.skey = e.skey
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(rest - prior, 0)) AS BIGINT) AS taken FROM c
"""
