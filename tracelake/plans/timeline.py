"""Wall-clock times of events: an as-of join on clock records.

The reading rule scans a boot's records in order and stops at the first whose
kernel time is greater than the event's; so record i counts exactly if the
greatest kernel time up to it is not above the event's time. With that running
maximum and its successor the winner is the one row with low <= t < high, an
equi-join on the boot and a time bucket with a range condition, right even for
unsorted lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boots(timesync: DataFrame) -> DataFrame:
    """(boot_uuid, boot_time, factor): the first header of each boot in path order."""
    order = F.struct(F.split("path", "/"), "boot_seq")
    first = timesync.where("seq is null").groupBy("boot_uuid").agg(F.min_by(F.struct("boot_time", "numerator", "denominator"), order).alias("b"))
    factor = F.when((F.col("b.numerator") == 125) & (F.col("b.denominator") == 3), F.lit(125.0) / F.lit(3.0)).otherwise(1.0)
    return first.select("boot_uuid", F.col("b.boot_time").alias("boot_time"), factor.alias("factor"))


def intervals(timesync: DataFrame) -> DataFrame:
    """(boot_uuid, low, high, kernel_time, walltime); high is null after the last record.

    Records of a boot are merged over all files in path order. A boot's first row
    (low null) stands for times before every record and carries the first record.
    """
    order = Window.partitionBy("boot_uuid").orderBy(F.split("path", "/"), "boot_seq", "seq")
    rows = timesync.where("seq is not null")
    rows = rows.withColumn("low", F.max("kernel_time").over(order)).withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("high", F.lead("low").over(order))
    first = rows.where("n = 1").select("boot_uuid", F.lit(None).cast("bigint").alias("low"), F.col("low").alias("high"), "kernel_time", "walltime")
    return first.unionByName(rows.where("high is null or high > low").select("boot_uuid", "low", "high", "kernel_time", "walltime"))


def fused(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a * b - c rounded once, plus d: the rounding error of the product is found by splitting the factors."""
    p = a * b
    big = F.lit(134217729.0)  # 2**27 + 1
    high = lambda x: x * big - (x * big - x)
    error = ((high(a) * high(b) - p) + high(a) * (b - high(b)) + (a - high(a)) * high(b)) + (a - high(a)) * (b - high(b))
    return ((p - c) + error) + d


def bucket_of(t: Column) -> Column:
    """The bucket of a time among __n equal ones from __from on; -1 before them and __n after."""
    return F.greatest(F.lit(-1), F.least(F.col("__n"), F.floor((t - F.col("__from")) / F.col("__step"))))


def with_time(events: DataFrame, timesync: DataFrame) -> DataFrame:
    """events (boot_uuid, continuous_time, base_time) with time: nanoseconds since 1970 as a double.

    Before the first record an event takes that record, or, if its base time is
    zero, the boot's own time; a boot without records or an unknown boot gives
    the boot time or zero. A boot's span is cut into as many buckets as it has
    records, so the join is by equality of boot and bucket and an event meets the
    few records near it, not all of its boot.
    """
    t, times = F.col("continuous_time"), intervals(timesync)
    span = times.groupBy("boot_uuid").agg(F.min("low").alias("__from"), F.max("low").alias("__to"), F.count("*").alias("__n"))
    span = span.withColumn("__step", F.greatest(F.lit(1.0), (F.col("__to") - F.col("__from")) / F.col("__n"))).drop("__to")
    known = events.join(boots(timesync), "boot_uuid", "left").join(span, "boot_uuid", "left").withColumn("__bucket", bucket_of(t))
    first = F.when(F.col("low").isNull(), F.lit(-1)).otherwise(bucket_of(F.col("low")))
    last = F.when(F.col("high").isNull(), F.col("__n")).otherwise(bucket_of(F.col("high")))
    times = times.join(span, "boot_uuid").withColumn("__bucket", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).drop("__from", "__n", "__step")
    same = (F.col("s.boot_uuid") == F.col("e.boot_uuid")) & (F.col("s.__bucket") == F.col("e.__bucket"))
    inside = same & (F.col("s.low").isNull() | (F.col("s.low") <= t)) & (F.col("s.high").isNull() | (t < F.col("s.high")))
    joined = known.alias("e").join(times.alias("s"), inside, "left").select("e.*", F.col("s.low").alias("__low"), F.col("s.kernel_time").alias("__k"), F.col("s.walltime").alias("__w"))
    own_boot = (F.col("base_time") == 0) & F.col("__low").isNull()
    k = F.when(own_boot, 0).otherwise(F.coalesce("__k", F.lit(0))).cast("double")
    w = F.when(own_boot, F.coalesce("boot_time", F.lit(0))).otherwise(F.coalesce("__w", F.lit(0))).cast("double")
    f = F.coalesce("factor", F.lit(1.0))
    time = F.when(f == 1.0, (t.cast("double") - k) + w).otherwise(fused(t.cast("double"), f, k * f, w))
    # An unknown boot has no clock at all: its events keep their own ticks.
    return joined.withColumn("time", time).drop("__low", "__k", "__w", "__from", "__n", "__step", "__bucket", "boot_time", "factor")


def iso_nanos(nanos: Column) -> Column:
    """Nanoseconds since 1970 as RFC 3339 text with nine digits."""
    seconds = F.floor(nanos / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("bigint")
    rest = F.pmod(nanos, F.lit(1_000_000_000))
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))
