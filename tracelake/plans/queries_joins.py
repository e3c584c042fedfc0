"""Queries of lookups, as-of and range joins, unions, ordering and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import codes
from tracelake.functions.tables import MISSING, UNKNOWN_SUBSYSTEM
from tracelake.operators.printf import format_log
from tracelake.operators.ranges import range_lookup, with_bases
from tracelake.plans import strings, timeline
from tracelake.plans.assemble import activity_ids, statedump_message, zone_name
from tracelake.plans.derived import EV, events, query, table
from tracelake.plans.queries_codes import ET_SQL, LT_SQL


@query("q_activity_parent", f"WITH {EV} SELECT event_id, CASE WHEN kind = 2 AND o <> 0 THEN o ELSE event_id END AS activity_id, CASE WHEN kind = 2 AND o <> 0 THEN event_id ELSE 0 END AS parent_activity_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_id * 2 ELSE 0 END AS o FROM ev)")
def activity_parent(spark: SparkSession, d: str) -> DataFrame:
    o = F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 2).otherwise(0)
    activity, parent = activity_ids(F.col("kind"), F.col("event_id"), o)
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return events(spark, d).select("event_id", activity.alias("activity_id"), parent.alias("parent_activity_id"), F.coalesce(before, F.lit(0)).alias("before"))


@query("q_process_lookup", "SELECT event_id, coalesce(c_custkey * 10, 0) AS pid, coalesce(c_nationkey, 0) AS euid FROM events LEFT JOIN customer ON user_id * 3 = c_custkey")
def process_lookup(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    joined = table(spark, d, "events").join(people, F.col("user_id") * 3 == F.col("c_custkey"), "left")
    return joined.select("event_id", F.coalesce(F.col("c_custkey") * 10, F.lit(0)).alias("pid"), F.coalesce("c_nationkey", F.lit(0)).alias("euid"))


@query("q_subsystem_lookup", f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE coalesce(n_name, '{UNKNOWN_SUBSYSTEM}') END AS subsystem, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE coalesce(c_mktsegment, '') END AS category FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey AND o_orderkey % 25 <> c_nationkey")
def subsystem_lookup(spark, d):
    dims = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "c_mktsegment", "n_name")
    joined = table(spark, d, "orders").join(dims, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderkey") % 25 != F.col("c_nationkey")), "left")
    none = F.col("o_orderkey") % 11 == 0
    return joined.select("o_orderkey", F.when(none, "").otherwise(F.coalesce("n_name", F.lit(UNKNOWN_SUBSYSTEM))).alias("subsystem"), F.when(none, "").otherwise(F.coalesce("c_mktsegment", F.lit(""))).alias("category"))


@query("q_header_tz", "SELECT page_id, string_split(url, '/')[-1] AS last_part FROM pages")
def header_tz(spark, d):
    return table(spark, d, "pages").select("page_id", zone_name(F.col("url")).alias("last_part"))


def clock(e: DataFrame, keep) -> DataFrame:
    """Clock records made of some events, in the form that archives give."""
    rows = e.where(keep).select(F.lit("a/b").alias("path"), F.lit(0).alias("boot_seq"), F.col("boot").cast("string").alias("boot_uuid"), F.lit(1).cast("bigint").alias("numerator"), F.lit(1).cast("bigint").alias("denominator"), (F.col("boot") * 1000 + 5).alias("boot_time"), F.col("event_id").alias("seq"), F.col("t").alias("kernel_time"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 7).alias("walltime"))
    heads = rows.select("path", "boot_seq", "boot_uuid", "numerator", "denominator", "boot_time").distinct()
    return rows.unionByName(heads, allowMissingColumns=True)


def asof_sql(keep: str, base: str) -> str:
    return f"""WITH {EV}, rec AS (SELECT boot, t AS k, arg_max(epoch_us(ts) * 1000 + 7, event_id) AS w FROM ev WHERE {keep} GROUP BY 1, 2),
    first AS (SELECT boot, arg_min(t, event_id) AS k, arg_min(epoch_us(ts) * 1000 + 7, event_id) AS w FROM ev WHERE {keep} GROUP BY 1)
    SELECT e.event_id, CASE WHEN r.k IS NOT NULL THEN (e.t::DOUBLE - r.k::DOUBLE) + r.w::DOUBLE WHEN {base} = 0 THEN e.t::DOUBLE + (e.boot * 1000 + 5)::DOUBLE
      ELSE (e.t::DOUBLE - f.k::DOUBLE) + f.w::DOUBLE END AS time
    FROM ev e ASOF LEFT JOIN rec r ON e.boot = r.boot AND e.t >= r.k LEFT JOIN first f ON e.boot = f.boot"""


@query("q_asof_time", asof_sql("event_id % 10 = 3", "1"))
def asof_time(spark, d):
    e = events(spark, d)
    asked = e.select("event_id", F.col("boot").cast("string").alias("boot_uuid"), F.col("t").alias("continuous_time"), F.lit(1).cast("bigint").alias("base_time"))
    return timeline.with_time(asked, clock(e, F.col("event_id") % 10 == 3)).select("event_id", "time")


@query("q_asof_fallback", asof_sql("event_id % 2500 >= 500 AND event_id % 50 = 0", "e.event_id % 2"))
def asof_fallback(spark, d):
    e = events(spark, d)
    asked = e.select("event_id", F.col("boot").cast("string").alias("boot_uuid"), F.col("t").alias("continuous_time"), (F.col("event_id") % 2).alias("base_time"))
    return timeline.with_time(asked, clock(e, (F.col("event_id") % 2500 >= 500) & (F.col("event_id") % 50 == 0))).select("event_id", "time")


@query("q_time_delta48", "SELECT l_orderkey, l_linenumber, l_orderkey + (l_partkey | (l_suppkey << 32)) AS continuous_time FROM lineitem")
def time_delta48(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + F.col("l_partkey").bitwiseOR(F.shiftleft("l_suppkey", 32))).alias("continuous_time"))


def document_ranges(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("uuid"), F.col("doc_id").alias("at"), F.col("n_chars").alias("size"))
    return with_bases(docs, ["uuid"]).withColumn("low", F.col("base") * 2)


RANGES = "ranges AS (SELECT source AS uuid, doc_id AS place, n_chars AS size, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM documents)"


@query("q_range_strings", f"WITH {RANGES}, p AS (SELECT event_id, 'src' || (user_id % 20) AS uuid, event_id * 37 % 100000 AS point FROM events), h AS (SELECT p.*, place, base, row_number() OVER (PARTITION BY event_id ORDER BY place) AS n FROM p LEFT JOIN ranges r ON p.uuid = r.uuid AND point >= base * 2 AND point <= base * 2 + size) SELECT event_id, coalesce(place, -1) AS place, CASE WHEN place IS NULL THEN 'Error: Invalid offset ' || point || ' for UUID ' || uuid ELSE CAST(base AS VARCHAR) END AS found FROM h WHERE n = 1")
def range_strings(spark, d):
    points = table(spark, d, "events").select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("uuid"), (F.col("event_id") * 37 % 100000).alias("point"))
    found = range_lookup(points, document_ranges(spark, d), ["uuid"], "point")
    wrong = F.concat(F.lit("Error: Invalid offset "), F.col("point").cast("string"), F.lit(" for UUID "), F.col("uuid"))
    return found.select("event_id", F.coalesce("at", F.lit(-1)).alias("place"), F.when(F.col("at").isNull(), wrong).otherwise(F.col("base").cast("string")).alias("found"))


@query("q_range_absolute", f"WITH {RANGES}, p AS (SELECT event_id, user_id % 25 AS proc, event_id * 13 % 12000 AS address FROM events), i AS (SELECT p.*, s_suppkey, row_number() OVER (PARTITION BY event_id ORDER BY s_suppkey) AS n FROM p LEFT JOIN supplier ON proc = s_nationkey AND address >= s_suppkey * 100 AND address <= s_suppkey * 100 + 1500), j AS (SELECT event_id, coalesce(s_suppkey, -1) AS image, address % 5000 AS point FROM i WHERE n = 1), h AS (SELECT j.*, place, row_number() OVER (PARTITION BY event_id ORDER BY place) AS n FROM j LEFT JOIN ranges r ON r.uuid = 'src' || (image % 20) AND point >= base * 2 AND point <= base * 2 + size) SELECT event_id, image, coalesce(place, -1) AS place FROM h WHERE n = 1")
def range_absolute(spark, d):
    points = table(spark, d, "events").select("event_id", (F.col("user_id") % 25).cast("int").alias("proc"), (F.col("event_id") * 13 % 12000).alias("address"))
    images = table(spark, d, "supplier").select(F.col("s_nationkey").alias("proc"), F.col("s_suppkey").alias("at"), (F.col("s_suppkey") * 100).alias("low"), F.lit(1500).alias("size"))
    found = range_lookup(points, images, ["proc"], "address").select("event_id", F.coalesce("at", F.lit(-1)).alias("image"), (F.col("address") % 5000).alias("point"))
    found = found.withColumn("uuid", F.concat(F.lit("src"), (F.col("image") % 20).cast("string")))
    return range_lookup(found, document_ranges(spark, d), ["uuid"], "point").select("event_id", "image", F.coalesce("at", F.lit(-1)).alias("place"))


@query("q_shared_offset", "SELECT l_orderkey, l_linenumber, l_partkey + CASE WHEN l = 0 THEN 0 WHEN l IN (1, 2) AND l > c THEN l * 2147483648 WHEN c <> 0 THEN (c // 2) * 4294967296 ELSE l * 4294967296 END AS shared_offset FROM (SELECT *, CAST(l_linenumber % 4 AS BIGINT) AS l, l_suppkey % 5 AS c FROM lineitem)")
def shared_offset(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", strings.shared_offset(F.col("l_partkey"), F.col("l_linenumber") % 4, F.col("l_suppkey") % 5).alias("shared_offset"))


@query("q_router", f"WITH {EV} SELECT event_id, CASE WHEN kind = 3 THEN 'main' WHEN f = 4 OR (f = 12 AND c <> 0 AND (kind = 4 OR l <> 0)) THEN 'shared' WHEN f = 8 THEN 'absolute' WHEN f = 10 THEN 'relative' ELSE 'main' END AS route FROM (SELECT *, event_id & 14 AS f, event_id % 3 AS l, event_id % 4 AS c FROM ev)")
def router(spark, d):
    e = events(spark, d).withColumn("f", F.col("event_id").bitwiseAND(14))
    e = e.withColumns({"shared_cache": F.col("f") == 4, "absolute": F.col("f") == 8, "uuid_relative": F.when(F.col("f") == 10, "x").otherwise(""), "large_offset": F.col("event_id") % 3, "large_shared_cache": F.when(F.col("f") == 12, F.col("event_id") % 4).otherwise(0)})
    return e.select("event_id", strings.route(F.col("kind")).alias("route"))


@query("q_dynamic_offset", "SELECT l_orderkey, l_linenumber, CASE WHEN (l_partkey * 3000001) & 2147483648 <> 0 THEN '%s' ELSE 'text' END AS format FROM lineitem")
def dynamic_offset(spark, d):
    bit = (F.col("l_partkey") * 3000001).bitwiseAND(strings.DYNAMIC_BIT) != 0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(bit, "%s").otherwise("text").alias("format"))


FIRST = "first AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)"


def first_texts(spark, d) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))


@query("q_oversize_first", f"WITH {FIRST} SELECT event_id, sha256(coalesce(text, '')) AS items_sha256 FROM events LEFT JOIN first ON event_id % 200 = conv_id")
def oversize_first(spark, d):
    joined = table(spark, d, "events").join(first_texts(spark, d), F.col("event_id") % 200 == F.col("conv_id"), "left")
    return joined.select("event_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("items_sha256"))


@query("q_missing_split", f"WITH {FIRST} SELECT event_id, CASE WHEN text IS NULL THEN 'missing' ELSE 'complete' END AS part, length(coalesce(text, '{MISSING}')) AS n FROM events LEFT JOIN first ON event_id % 200 = conv_id")
def missing_split(spark, d):
    from tracelake.plans.oversize import split_missing

    said = table(spark, d, "events").join(first_texts(spark, d), F.col("event_id") % 200 == F.col("conv_id"), "left").select("event_id", F.coalesce("text", F.lit(MISSING)).alias("message"))
    complete, missing = split_missing(said)
    both = complete.withColumn("part", F.lit("complete")).unionByName(missing.withColumn("part", F.lit("missing")))
    return both.select("event_id", "part", F.length("message").alias("n"))


@query("q_missing_retry", f"WITH {FIRST} SELECT event_id, coalesce(length(text), 0) AS n FROM events LEFT JOIN first ON event_id % 200 = conv_id")
def missing_retry(spark, d):
    asked = table(spark, d, "events").select("event_id", (F.col("event_id") % 200).alias("conv_id"))
    known = first_texts(spark, d)
    early = known.where("conv_id % 2 = 0")
    done = asked.join(early, "conv_id")
    late = asked.join(early, "conv_id", "left_anti").join(known, "conv_id", "left")
    return done.unionByName(late).select("event_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))


@query("q_image_path", "SELECT e.event_id, CASE WHEN k = 0 THEN '' ELSE coalesce(url, 'Failed to get path string from UUIDText file for entry: ' || k) END AS process FROM (SELECT event_id, event_id % 300 AS k FROM events) e LEFT JOIN pages ON k = page_id")
def image_path(spark, d):
    asked = table(spark, d, "events").select("event_id", (F.col("event_id") % 300).alias("k"))
    joined = asked.join(table(spark, d, "pages").select("page_id", "url"), F.col("k") == F.col("page_id"), "left")
    unknown = F.concat(F.lit("Failed to get path string from UUIDText file for entry: "), F.col("k").cast("string"))
    return joined.select("event_id", F.when(F.col("k") == 0, "").otherwise(F.coalesce("url", unknown)).alias("process"))


@query("q_timesync_merge", f"WITH {EV} SELECT boot, string_agg(t || ':' || event_id, ',' ORDER BY event_id) AS records FROM ev GROUP BY boot")
def timesync_merge(spark, d):
    e = events(spark, d)
    listed = F.sort_array(F.collect_list(F.struct("event_id", "t")))
    return e.groupBy("boot").agg(F.array_join(F.transform(listed, lambda r: F.concat(r["t"].cast("string"), F.lit(":"), r["event_id"].cast("string"))), ",").alias("records"))


@query("q_running_base", "SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, CAST(sum(n_chars) OVER (PARTITION BY source) AS BIGINT) AS total FROM documents")
def running_base(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    docs = with_bases(docs, ["source"], "doc_id", "n_chars")
    return docs.select("doc_id", "base", F.sum("n_chars").over(Window.partitionBy("source")).alias("total"))


@query("q_bookmark_filter", f"WITH {EV}, m AS (SELECT CAST(min(t) + (max(t) - min(t)) * 0.5 AS BIGINT) AS mark FROM ev) SELECT count(*) FILTER (t > mark) AS emitted, count(*) FILTER (t <= mark) AS skipped, max(t) AS bookmark, CAST(sum(event_id) FILTER (t > mark) AS BIGINT) AS ids FROM ev, m")
def bookmark_filter(spark, d):
    from tracelake.streaming.bookmark import counts

    e = events(spark, d)
    low, high = e.agg(F.min("t"), F.max("t")).first()
    mark = int(round(low + (high - low) * 0.5))
    return counts(e, "t", mark, ids="event_id")


@query("q_contains_ci", "SELECT doc_id, contains(lower(text), 'the') AS has_the, contains(text, 'http') AS has_http FROM documents")
def contains_ci(spark, d):
    return table(spark, d, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("the")).alias("has_the"), F.contains("text", F.lit("http")).alias("has_http"))


@query("q_regex_only_s", "SELECT lang, count(*) FILTER (regexp_matches(text, '^\\s*[A-Z][a-z]+\\s')) AS n_title, CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS n_numbers FROM documents GROUP BY lang")
def regex_only_s(spark, d):
    docs = table(spark, d, "documents")
    title = F.col("text").rlike(r"^\s*[A-Z][a-z]+\s")
    return docs.groupBy("lang").agg(F.count_if(title).alias("n_title"), F.sum(F.regexp_count("text", F.lit("[0-9]+"))).alias("n_numbers"))


@query("q_suffix", "SELECT page_id, ends_with(url, '.html') AS is_html FROM pages")
def suffix(spark, d):
    return table(spark, d, "pages").select("page_id", F.endswith("url", F.lit(".html")).alias("is_html"))


FLAGS = [(1, "HasCurrentAid"), (256, "HasPrivateData"), (512, "HasSubsystem"), (1024, "HasRules"), (2048, "HasOversize")]


@query("q_flags_array", "SELECT event_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN f & {b} <> 0 THEN '{n}' END" for b, n in FLAGS) + "], lambda x: x IS NOT NULL), ',') AS flags FROM (SELECT event_id, event_id * 131 % 4096 AS f FROM events)")
def flags_array(spark, d):
    f = F.col("event_id") * 131 % 4096
    names = F.array_compact(F.array(*[F.when(f.bitwiseAND(b) != 0, n) for b, n in FLAGS]))
    return table(spark, d, "events").select("event_id", F.array_join(names, ",").alias("flags"))


@query("q_item_counts", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS convs, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def item_counts(spark, d):
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("items"))
    each = nested.select("conv_id", F.explode("items").alias("i")).select("conv_id", "i.*")
    return each.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("convs"), F.sum(F.length("text")).alias("chars"))


@query("q_item_number", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN xor(v & 255, 128) - 128 WHEN 1 THEN xor(v & 65535, 32768) - 32768 WHEN 2 THEN xor(v & 4294967295, 2147483648) - 2147483648 ELSE -9999 END AS number FROM (SELECT event_id, event_id * 2654435761 AS v FROM events)")
def item_number(spark, d):
    v = F.col("event_id") * 2654435761
    signed = lambda bits: v.bitwiseAND((1 << bits) - 1).bitwiseXOR(F.lit(1 << (bits - 1))) - (1 << (bits - 1))
    n = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", F.when(n == 0, signed(8)).when(n == 1, signed(16)).when(n == 2, signed(32)).otherwise(-9999).alias("number"))


@query("q_distinct_names", "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS names FROM events GROUP BY user_id")
def distinct_names(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("names"))


@query("q_csv_projection", f"WITH {EV} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS \"Timestamp\", {ET_SQL} AS \"Event Type\", {LT_SQL} AS \"Log Type\", props AS \"Message\", user_id AS \"PID\" FROM ev")
def csv_projection(spark, d):
    from tracelake.sinks import csv_time

    e = events(spark, d)
    nanos = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    return e.select(csv_time(nanos).alias("Timestamp"), codes.event_type(F.col("kind")).alias("Event Type"), codes.log_type(F.col("lt"), F.col("kind")).alias("Log Type"), F.col("props").alias("Message"), F.col("user_id").alias("PID"))


@query("q_jsonl_projection", "SELECT event_id, '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")
def jsonl_projection(spark, d):
    from tracelake.sinks import json_line

    return table(spark, d, "events").select("event_id", json_line(["event_id", "user_id", "event_type"]).alias("line"))


@query("q_lineage_order", f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY boot ORDER BY CASE WHEN kind = 7 THEN 1 ELSE 0 END, user_id, event_id) AS place FROM ev")
def lineage_order(spark, d):
    order = Window.partitionBy("boot").orderBy(F.when(F.col("kind") == 7, 1).otherwise(0), "user_id", "event_id")
    return events(spark, d).select("event_id", F.row_number().over(order).alias("place"))


SIMPLE = "SELECT o_orderkey AS id, 'Simpledump' AS event_type, o_custkey AS pid, o_orderpriority AS subsystem, 'order ' || o_orderstatus AS message FROM orders"
STATE = "SELECT event_id AS id, 'Statedump' AS event_type, user_id AS pid, '' AS subsystem, 'title: ' || event_type || chr(10) || 'Object Type: lib' || chr(10) || 'Object Type: type' || chr(10) || props AS message FROM events"
LOGS = f"WITH {EV} SELECT event_id AS id, {ET_SQL} AS event_type, user_id AS pid, event_type AS subsystem, props AS message FROM ev"


@query("q_simpledump_row", SIMPLE)
def simpledump_row(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Simpledump").alias("event_type"), F.col("o_custkey").alias("pid"), F.col("o_orderpriority").alias("subsystem"), F.concat(F.lit("order "), "o_orderstatus").alias("message"))


@query("q_statedump_row", STATE)
def statedump_row(spark, d):
    message = statedump_message(F.col("event_type"), F.lit("lib"), F.lit("type"), F.col("props"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("Statedump").alias("event_type"), F.col("user_id").alias("pid"), F.lit("").alias("subsystem"), message.alias("message"))


@query("q_union_events", f"{LOGS} UNION ALL {SIMPLE} UNION ALL {STATE}")
def union_events(spark, d):
    logs = events(spark, d).select(F.col("event_id").alias("id"), codes.event_type(F.col("kind")).alias("event_type"), F.col("user_id").alias("pid"), F.col("event_type").alias("subsystem"), F.col("props").alias("message"))
    return logs.unionByName(simpledump_row(spark, d)).unionByName(statedump_row(spark, d))


# Extensions: analytics on the event table that Spark gives beside the engine's own operators.


@query("ext_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_windows(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


@query("ext_rollup", "SELECT coalesce(event_type, 'all') AS event_type, coalesce(CAST(user_id % 5 AS VARCHAR), 'all') AS g, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def ext_rollup(spark, d):
    e = table(spark, d, "events").withColumn("u", (F.col("user_id") % 5).cast("string")).rollup("event_type", "u").agg(F.count("*").alias("n"))
    return e.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("u", F.lit("all")).alias("g"), "n")


@query("ext_session", "WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM g GROUP BY user_id, k")
def ext_session(spark, d):
    e = table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))
    return e.select("user_id", "first_event", "n")


@query("ext_topk", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def ext_topk(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))
    return table(spark, d, "events").withColumn("n", n).where("n <= 3").select("user_id", "event_id", "value")


@query("ext_except", "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def ext_except(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id").subtract(e.where("event_type = 'error'").select("user_id"))


@query("q_flagship", f"""WITH {EV}, rec AS (SELECT boot, t AS k, arg_max(epoch_us(ts) * 1000 + 7, event_id) AS w FROM ev WHERE event_id % 10 = 0 GROUP BY 1, 2),
r AS (SELECT e.event_id, coalesce(c_mktsegment, '{UNKNOWN_SUBSYSTEM}') AS subsystem, {LT_SQL} AS log_type, coalesce(c_custkey, 0) AS pid, (e.t::DOUBLE - r.k::DOUBLE) + r.w::DOUBLE AS time, 'user ' || user_id || ' did ' || event_type AS message
  FROM ev e LEFT JOIN customer ON user_id = c_custkey ASOF LEFT JOIN rec r ON e.boot = r.boot AND e.t >= r.k)
SELECT subsystem, log_type, count(*) AS n, max(time) AS last_time, CAST(sum(length(message)) AS BIGINT) AS chars, count(DISTINCT pid) AS processes FROM r GROUP BY 1, 2""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    people = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    joined = e.join(people, F.col("user_id") == F.col("c_custkey"), "left").withColumns({"boot_uuid": F.col("boot").cast("string"), "continuous_time": F.col("t"), "base_time": F.lit(1).cast("bigint")})
    timed = timeline.with_time(joined, clock(e, F.col("event_id") % 10 == 0))
    item = lambda kind, text: F.struct(F.lit(kind).alias("item_type"), F.lit(1).alias("item_size"), text.cast("string").alias("message_strings"))
    said = format_log("user %d did %{public}s", F.array(item(2, F.col("user_id")), item(0x22, F.col("event_type"))))
    rows = timed.select(F.coalesce("c_mktsegment", F.lit(UNKNOWN_SUBSYSTEM)).alias("subsystem"), codes.log_type(F.col("lt"), F.col("kind")).alias("log_type"), F.coalesce("c_custkey", F.lit(0)).alias("pid"), "time", said.alias("message"))
    return rows.groupBy("subsystem", "log_type").agg(F.count("*").alias("n"), F.max("time").alias("last_time"), F.sum(F.length("message")).alias("chars"), F.count_distinct("pid").alias("processes"))
