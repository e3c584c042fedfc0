"""Range lookups: which range of its key holds a point, the first one if several do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_bases(ranges: DataFrame, key: list[str], order: str = "at", size: str = "size") -> DataFrame:
    """ranges with base: the sum of the sizes of a key's earlier ranges, where a range's bytes begin in one blob."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("base", F.coalesce(F.sum(size).over(before), F.lit(0)))


def range_hits(asked: DataFrame, ranges: DataFrame, key: list[str], point: str) -> DataFrame:
    """(key, point, fields): for every distinct row (key, point) the first range (by at) with low <= point <= low + size; nulls where none has it.

    A range of up to 16**d - 1 in size lies in one or two buckets of width 16**d,
    d being the number of its hexadecimal digits, or 15 where there are more than
    eight; a point is looked for in its bucket of every width. So the join is by equality of key, width and bucket,
    and compares ranges near a point only, however many a key has and however
    much they overlap. Both sides are read once. Ranges of negative size hold
    nothing. Ranges may be as many as the points, so they are joined by shuffle and never pass through the driver.
    """
    fields = [c for c in ranges.columns if c not in key]
    bucket = lambda c: F.expr(f"shiftright({c}, 4 * __digits)")
    digits = F.length(F.hex("size"))
    held = ranges.where("size >= 0").withColumn("__digits", F.when(digits <= 8, digits).otherwise(15))
    cut = held.withColumn("__bucket", F.explode(F.sequence(bucket("low"), bucket("low + size"))))
    probes = asked.select(*key, point).withColumn("__digits", F.explode(F.array(*[F.lit(d) for d in (*range(1, 9), 15)]))).withColumn("__bucket", bucket(f"`{point}`"))
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in (*key, "__digits", "__bucket")]
    inside = F.col(f"p.{point}").between(F.col("r.low"), F.col("r.low") + F.col("r.size"))
    near = probes.alias("p").join(cut.hint("merge").alias("r"), [*same, inside], "left")
    first = near.groupBy(*[F.col(f"p.{c}").alias(c) for c in (*key, point)]).agg(F.min_by(F.struct(*[F.col(f"r.{c}").alias(c) for c in fields]), F.col("r.at")).alias("__r"))
    return first.select(*key, point, *[F.col(f"__r.{c}").alias(c) for c in fields])


def range_lookup(points: DataFrame, ranges: DataFrame, key: list[str], point: str) -> DataFrame:
    """points with the columns of the first range (by at) of their key with low <= point <= low + size."""
    fields = [c for c in ranges.columns if c not in key]
    asked = points.select(*key, point).where(F.col(point).isNotNull()).distinct()
    return points.join(range_hits(asked, ranges, key, point).hint("merge"), [*key, point], "left").select(*points.columns, *fields)
