"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix. Its canonical key is the reversed host, a
slash and the path (``com.example/en/``), and it covers the interval of keys
that start so: from the key itself up to the key followed by byte 0xFF. Such
intervals are nested or apart. A url gives one point for each suffix of its
host that is as deep as some rule's, because a rule also fits all subdomains.
Points and interval ends are sorted together; a sweep keeps the stack of active
rules, of which slot d is the latest start at depth d. Depth is a running sum,
and the top of the stack at a point is the latest start at the point's depth.
Both running values go through range bins with carried totals, so the sweep is
spread over many tasks, however hot a host is.

Of the rules found over a url's suffixes the longest wins, ties by rule text;
of equal rules with different actions, block wins. Defined cases: a null url or
one without ``://`` has an empty host and path; it and any url that no rule
fits get the default verdict; rules with a null part or a slash in the host fit
nothing; repeated rows are each judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, UPPER, RangeBins, cut, running, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts_of(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def key_of(reversed_host: Column, path: Column) -> Column:
    return F.concat(reversed_host, F.lit("/"), path).cast("binary")


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, top) for every distinct key of points that lies inside some rule."""
    start = rules.select("key", F.lit(1).alias("kind"), F.lit(1).alias("delta"), F.struct("size", "rule", "action").alias("rule"))
    end = rules.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("delta"), F.lit(None).cast(start.schema["rule"].dataType).alias("rule"))
    point = points.select("key").distinct().select("key", F.lit(2).alias("kind"), F.lit(0).alias("delta"), F.lit(None).cast(start.schema["rule"].dataType).alias("rule"))
    events = cut(start.unionByName(end).unionByName(point))
    bins = RangeBins(events, "key")
    events = events.withColumn("bin", bins.of(F.col("key")))
    # One row a bin, at most 4,096 of them: small enough to broadcast at any input size.
    carried = events.groupBy("bin").agg(F.sum("delta").alias("d"))
    carried = carried.select("bin", F.coalesce(F.sum("d").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    depth = F.sum("delta").over(running(["bin"], ["key", "kind"])) + F.col("before")
    deep = events.join(F.broadcast(carried), "bin").withColumn("depth", depth).where("kind > 0 and depth > 0")
    slots = deep.groupBy("bin", "depth").agg(F.max(F.when(F.col("kind") == 1, F.struct("key", "rule"))).alias("last"))
    older = F.last("last", ignorenulls=True).over(Window.partitionBy("depth").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.select("bin", "depth", older.alias("older"))
    top = F.last("rule", ignorenulls=True).over(running(["bin", "depth"], ["key", "kind"]))
    return deep.withColumn("top", top).where("kind = 2").join(slots, ["bin", "depth"]).select("key", F.coalesce("top", "older.rule").alias("top"))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict added (columns of these names are replaced).

    rules has host, path and action, and may be of any size.
    """
    own = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = parts_of(F.col("__url"))
    rows = urls.select(*own, F.col(url).alias("__url")).withColumns({"__host": host, "__path": path}).drop("__url")
    rules = rules.where("host is not null and path is not null and action is not null and not contains(host, '/')")
    rules = rules.withColumn("labels", F.reverse(F.split("host", r"\.", -1))).withColumn("rule", F.concat("host", "path"))
    rules = rules.withColumn("key", key_of(F.array_join("labels", "."), F.col("path"))).groupBy("key", "rule").agg(F.max(F.struct((F.col("action") == "block").alias("b"), "action")).getField("action").alias("action"), F.max(F.size("labels")).alias("depth"))
    rules = cut(rules.withColumn("size", F.length("rule")))
    deepest = rules.agg(F.max("depth")).first()[0] or 0
    urls_once = rows.select("__host", "__path").distinct()
    labels = F.reverse(F.split("__host", r"\.", -1))
    points = urls_once.withColumn("__labels", F.slice(labels, 1, max(deepest, 1))).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("__labels"))))
    points = points.select("__host", "__path", key_of(F.array_join(F.slice("__labels", F.lit(1), F.col("n")), "."), F.col("__path")).alias("key"))
    found = points.join(sweep(points, rules), "key")
    best = found.groupBy("__host", "__path").agg(F.max_by("top", F.struct(F.col("top.size"), F.col("top.rule"))).alias("top"))
    # The extra key makes Spark deal both sides for this join, so that it can split a hot url.
    h = F.xxhash64("__host", "__path")
    return rows.withColumn("__h", h).join(best.withColumn("__h", h), ["__h", "__host", "__path"], "left").select(*own, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("top.rule").alias("rule"), F.coalesce("top.action", F.lit(default)).alias("verdict"))


def op3_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by the five rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH r(host, path, action) AS (VALUES %s),
u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, row_number() OVER () AS i,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), f AS (
  SELECT p.*, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY i ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS n
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE n = 1
""" % ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
