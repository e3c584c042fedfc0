"""Queries of code tables, flags and simple value decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import codes as c
from tracelake.functions import net, text
from tracelake.functions import tables as t
from tracelake.plans.derived import EV, code_query, events, query, sql_case, table

TEXT = "CAST(code AS VARCHAR)"

code_query("q_bools", "event_id % 3", {
    "upper_bool": (c.upper_bool, "CASE code WHEN 0 THEN 'NO' ELSE 'YES' END"), "lower_bool": (c.lower_bool, "CASE code WHEN 0 THEN 'false' ELSE 'true' END"),
    "added": (c.added, "CASE code WHEN 1 THEN 'add' ELSE 'rmv' END"), "yes_no": (c.yes_no, "CASE code WHEN 0 THEN 'no' ELSE 'yes' END"),
    "acceptable": (c.acceptable, "CASE code WHEN 0 THEN 'unacceptable' ELSE 'acceptable' END"),
})
code_query("q_errno", "event_id % 117 - 9", {"errno": (c.errno, sql_case("code", t.ERRNO, f"'Unknown errno: ' || {TEXT}"))})
code_query("q_mach_errno", "268435456 + event_id % 20", {"errno": (c.mach_errno, sql_case("code", t.MACH_ERRNO, f"'Unknown mach errno: ' || {TEXT}"))})
code_query("q_mode", "event_id % 1000", {"mode": (c.mode, "'-' || array_to_string(list_transform(string_split(CAST(code AS VARCHAR), ''), lambda d: " + sql_case("d", t.MODE, "'---'") + "), '')")})
code_query("q_od_error", "event_id % 12 * 100 + 4000 + event_id % 7", {"od_error": (c.od_error, sql_case("code", t.OD_ERROR, TEXT))})
code_query("q_member_type", "event_id % 14", {"member": (c.od_member, sql_case("code", t.OD_MEMBER, TEXT))})
code_query("q_location_codes", "event_id % 60", {
    "authorization_status": (c.location_authorization, sql_case("code", t.LOCATION_AUTHORIZATION, "'Unknown Core Location client authorization status'")),
    "daemon_status": (c.location_daemon, sql_case("code", t.LOCATION_DAEMON, "'Unknown Core Location daemon status type'")),
    "harvester": (c.location_harvester, sql_case("code", {k: f'"{v}"' for k, v in t.LOCATION_HARVESTER.items()}, "'Unknown Core Location subhaverster identifier type'")),
})
code_query("q_sqlite_code", "event_id % 270", {"sqlite": (c.sqlite_code, sql_case("code", t.SQLITE, "'Unknown Core Location sqlite error'"))})
code_query("q_io_message", "3758096400 + event_id % 60 * 16", {"io_message": (c.location_io, sql_case("code", t.LOCATION_IO, "'Unknown IO Message'"))})
code_query("q_dns_rrtype", "event_id % 260", {"rrtype": (c.dns_type, sql_case("code", t.DNS_TYPE, "'Unknown DNS Resource Record Type'"))})
code_query("q_dns_reason", "event_id % 7", {"reason": (c.dns_reason, sql_case("code", t.DNS_REASON, "'Unknown DNS Reason'"))})
code_query("q_dns_protocol", "event_id % 6", {"protocol": (c.dns_protocol, sql_case("code", t.DNS_PROTOCOL, "'Unknown DNS Protocol'"))})
code_query("q_gaiopts", "event_id % 30", {"options": (c.dns_options, sql_case("code", t.DNS_OPTIONS, "'Unknown DNS getaddrinfo options'"))})


def sql_flags(v: str) -> str:
    """The SQL twin of codes.dns_flags."""
    bit = lambda n, mask: f"(({v}) >> {n}) & {mask}"
    return (
        f"'Opcode: ' || {sql_case(bit(11, 15), t.DNS_OPCODE, repr('UNKNOWN OPCODE'))} || ', ' || chr(10) || '    Query Type: ' || ({bit(15, 1)}) || ',' || chr(10) || '    Authoritative Answer Flag: ' || ({bit(10, 1)}) || ', '"
        f" || chr(10) || '    Truncation Flag: ' || ({bit(9, 1)}) || ', ' || chr(10) || '    Recursion Desired: ' || ({bit(8, 1)}) || ', ' || chr(10) || '    Recursion Available: ' || ({bit(7, 1)}) || ', '"
        f" || chr(10) || '    Response Code: ' || {sql_case(bit(0, 15), t.DNS_RCODE, repr('Unknown Response Code'))}"
    )


def sql_counts(v: str) -> str:
    part = lambda n: f"((({v}) >> {n}) & 65535)"
    return f"'Question Count: ' || {part(48)} || ', Answer Record Count: ' || {part(32)} || ', Authority Record Count: ' || {part(16)} || ', Additional Record Count: ' || {part(0)}"


code_query("q_dns_flags", "event_id * 7919 % 65536", {"flags": (c.dns_flags, sql_flags("code"))})
code_query("q_dns_idflags", "event_id * 2654435761 % 4294967296", {"idflags": (c.dns_id_flags, f"'id: 0x' || hex(code >> 16) || ', flags: 0x' || hex(code & 65535) || ' ' || {sql_flags('code & 65535')}")})
code_query("q_dns_counts", "event_id * 281474976710 % 9007199254740993", {"counts": (c.dns_counts, sql_counts("code"))})
code_query("q_ipv4", "event_id * 2654435761 % 4294967296", {"ip": (net.ipv4, "(code >> 24) || '.' || ((code >> 16) & 255) || '.' || ((code >> 8) & 255) || '.' || (code & 255)")})


@query("q_sockaddr4", "SELECT event_id, (a >> 24) || '.' || ((a >> 16) & 255) || '.' || ((a >> 8) & 255) || '.' || (a & 255) || CASE WHEN p = 0 THEN '' ELSE ':' || p END AS address FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS a, event_id % 3 * 443 AS p FROM events)")
def sockaddr4(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", net.sockaddr4(F.col("event_id") * 2654435761 % 4294967296, F.col("event_id") % 3 * 443).alias("address"))


@query("q_dns_header", f"SELECT event_id, 'Query ID: 0x' || hex(event_id % 65536) || ', Flags: 0x' || hex(f) || ' ' || {sql_flags('f')} || ', Question Count: 1, Answer Record Count: ' || (event_id % 4) || ', Authority Record Count: 0, Additional Record Count: ' || (event_id % 2) AS header FROM (SELECT event_id, event_id * 7919 % 65536 AS f FROM events)")
def dns_header(spark, d):
    e = table(spark, d, "events")
    n = F.col("event_id")
    return e.select("event_id", net.dns_header(n % 65536, n * 7919 % 65536, F.lit(1), n % 4, F.lit(0), n % 2).alias("header"))


@query("q_mac", "SELECT doc_id, rtrim(regexp_replace(hex(substr(sha256(text), 1, 6)), '(..)', '\\1:', 'g'), ':') AS mac FROM documents")
def mac(spark, d):
    return table(spark, d, "documents").select("doc_id", text.mac(F.base64(F.substring(F.sha2("text", 256), 1, 6).cast("binary"))).alias("mac"))


@query("q_uuid_hex", "SELECT doc_id, hex(lang || source) AS uuid FROM documents")
def uuid_hex(spark, d):
    return table(spark, d, "documents").select("doc_id", text.uuid_hex(F.base64(F.concat("lang", "source").cast("binary"))).alias("uuid"))


@query("q_domain_clean", "SELECT doc_id, sha256(regexp_replace(text, '[\\x01-\\x1F\\x7F]', '.', 'g')) AS clean_sha256, length(text) - length(regexp_replace(text, '[\\x01-\\x1F\\x7F]', '', 'g')) AS n_controls FROM documents")
def domain_clean(spark, d):
    cleaned = text.domain_clean(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(cleaned, 256).alias("clean_sha256"), F.regexp_count("text", F.lit(r"[\x01-\x1F\x7F]")).cast("bigint").alias("n_controls"))


@query("q_base64_round", "SELECT doc_id, sha256(base64(encode(text))) AS coded_sha256, true AS same FROM documents")
def base64_round(spark, d):
    # One long line, as the standard alphabet gives it.
    coded = F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\r\n]", "")
    docs = table(spark, d, "documents").withColumn("coded", coded)
    return docs.select("doc_id", F.sha2("coded", 256).alias("coded_sha256"), (text.base64_or_null(F.col("coded")) == F.col("text").cast("binary")).alias("same"))


@query("q_padding", "SELECT l_orderkey, l_linenumber, n, (4 - (n & 3)) & 3 AS pad4, (8 - (n & 7)) & 7 AS pad8 FROM (SELECT l_orderkey, l_linenumber, l_partkey + CAST(l_quantity AS BIGINT) AS n FROM lineitem)")
def pad(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("n"))
    return rows.select("*", text.padding(F.col("n"), 4).alias("pad4"), text.padding(F.col("n"), 8).alias("pad8"))


@query("q_cstring", "SELECT doc_id, CASE WHEN coalesce(length(s), 0) = 0 THEN 'Cannot extract string. Empty input.' WHEN ends_with(s, '|') THEN split_part(s, '|', 1) ELSE s END AS field FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN lang || '|' || source || '|' ELSE lang || '|' || source END AS s FROM documents)")
def cstring(spark, d):
    both = F.concat_ws("|", "lang", "source")
    s = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.concat(both, F.lit("|"))).otherwise(both)
    return table(spark, d, "documents").select("doc_id", text.c_string(s, "|").alias("field"))


@query("q_string_size", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '(null)' ELSE rtrim(substr(source || 'xx00', 1, doc_id % 9), '0') END AS field FROM documents")
def string_size(spark, d):
    s = F.concat("source", F.lit("xx00"))
    size = F.col("doc_id") % 9
    return table(spark, d, "documents").select("doc_id", F.when(size == 0, text.sized_string(s, F.lit(0))).otherwise(F.rtrim(F.substring(s, F.lit(1), size.cast("int")), F.lit("0"))).alias("field"))


@query("q_uuid_pad", "SELECT event_id, CASE WHEN length(u) BETWEEN 30 AND 32 THEN lpad(u, 32, '0') END AS uuid FROM (SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 28 + event_id % 5) AS u FROM events)")
def uuid_pad(spark, d):
    from tracelake.sources.archive import padded_uuid

    u = F.substring(F.md5(F.col("event_id").cast("string")), F.lit(1), (F.col("event_id") % 5 + 28).cast("int"))
    return table(spark, d, "events").select("event_id", padded_uuid(u).alias("uuid"))


@query("q_path_classify", """
SELECT page_id, CASE WHEN name = 'logdata.LiveData.tracev3' OR (ends_with(name, '.tracev3') AND parent IN ('HighVolume', 'Special', 'Signpost', 'Persist')) THEN 'TraceV3'
  WHEN regexp_full_match(name, '[0-9A-Fa-f]{30}') AND regexp_full_match(parent, '[0-9A-Fa-f]{2}') THEN 'UUIDText'
  WHEN regexp_full_match(name, '[0-9A-Fa-f]{32}') AND parent = 'dsc' THEN 'Dsc' WHEN ends_with(name, '.timesync') AND parent = 'timesync' THEN 'Timesync' ELSE 'Invalid' END AS kind
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Persist' WHEN 1 THEN 'timesync' WHEN 2 THEN 'dsc' WHEN 3 THEN 'AB' WHEN 4 THEN 'Other' ELSE 'Special' END AS parent,
  CASE page_id % 6 WHEN 1 THEN page_id || '.timesync' WHEN 2 THEN md5(url) WHEN 3 THEN substr(md5(url), 1, 30) ELSE page_id || '.tracev3' END AS name FROM pages)""")
def path_classify(spark, d):
    from tracelake.sources.archive import file_kind

    n = F.col("page_id") % 6
    parent = F.when(n == 0, "Persist").when(n == 1, "timesync").when(n == 2, "dsc").when(n == 3, "AB").when(n == 4, "Other").otherwise("Special")
    own = F.col("page_id").cast("string")
    name = F.when(n == 1, F.concat(own, F.lit(".timesync"))).when(n == 2, F.md5("url")).when(n == 3, F.substring(F.md5("url"), 1, 30)).otherwise(F.concat(own, F.lit(".tracev3")))
    return table(spark, d, "pages").select("page_id", file_kind(F.concat(F.lit("/root/"), parent, F.lit("/"), name)).alias("kind"))


@query("q_iso_ns", f"WITH {EV} SELECT event_id, strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) * 1000 + event_id % 1000) % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS iso FROM ev")
def iso_ns(spark, d):
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return events(spark, d).select("event_id", text.iso_nanos(nanos).alias("iso"))


@query("q_iso_ms", "SELECT event_id, strftime(make_timestamp(event_id * 86461000000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso FROM events")
def iso_ms(spark, d):
    # RFC 3339 text signs years after 9999, as the formatter does; the SQL writes their digits alone.
    return table(spark, d, "events").select("event_id", F.ltrim(text.iso_millis(F.col("event_id") * 86461), F.lit("+")).alias("iso"))


LT_SQL = "CASE WHEN lt = 1 THEN CASE WHEN kind = 2 THEN 'Create' ELSE 'Info' END ELSE " + sql_case("lt", t.LOG_TYPE, "'Default'") + " END"
ET_SQL = sql_case("kind", t.EVENT_TYPE, "'Unknown'")


@query("q_log_type", f"WITH {EV} SELECT event_id, {LT_SQL} AS log_type FROM (SELECT event_id, kind, CASE WHEN event_id % 7 = 0 THEN 128 + event_id % 3 ELSE lt END AS lt FROM ev)")
def log_type(spark, d):
    code = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 3 + 128).otherwise(F.col("lt"))
    return events(spark, d).select("event_id", c.log_type(code, F.col("kind")).alias("log_type"))


@query("q_event_type", f"WITH {EV} SELECT event_id, {ET_SQL} AS event_type FROM ev")
def event_type(spark, d):
    return events(spark, d).select("event_id", c.event_type(F.col("kind")).alias("event_type"))


@query("q_type_counts", f"WITH {EV} SELECT {LT_SQL} AS log_type, {ET_SQL} AS event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def type_counts(spark, d):
    return events(spark, d).groupBy(c.log_type(F.col("lt"), F.col("kind")).alias("log_type"), c.event_type(F.col("kind")).alias("event_type")).agg(F.count("*").alias("n"))
