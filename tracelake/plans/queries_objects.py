"""Queries of decoders that read packed bytes; the bytes are built from event ids, so SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import objects
from tracelake.plans.derived import query, table


def little(n: Column, size: int) -> Column:
    """size bytes of a number, lowest first, as hex text."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)])


def big(n: Column, size: int) -> Column:
    return F.lpad(F.hex(n.bitwiseAND((1 << 8 * size) - 1 if size < 8 else -1)), 2 * size, "0")


def packed(*parts: Column | str) -> Column:
    return F.base64(F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])))


QUAD = "(a >> 24) || '.' || ((a >> 16) & 255) || '.' || ((a >> 8) & 255) || '.' || (a & 255)"


@query("q_object_addresses", f"""
SELECT event_id, {QUAD} || CASE WHEN p = 0 THEN '' ELSE ':' || p END AS socket4, '::' || CASE WHEN p = 0 THEN '' ELSE ':' || p END || ', Flow ID: ' || (event_id % 7) || ', Scope ID: ' || (event_id % 11) AS socket6,
  'fe80::' || lower(hex(1 + event_id % 65535)) AS ipv6, {QUAD} AS resolver, 'Unknown sockaddr family: ' || (40 + event_id % 9) AS other
FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS a, event_id % 3 * 443 AS p FROM events)""")
def addresses(spark, d):
    n = F.col("event_id")
    a, p = n * 2654435761 % 4294967296, n % 3 * 443
    return table(spark, d, "events").select(
        "event_id", objects.sockaddr(packed("1002", big(p, 2), big(a, 4), "00" * 8)).alias("socket4"), objects.sockaddr(packed("1C1E", big(p, 2), big(n % 7, 4), "00" * 16, big(n % 11, 4))).alias("socket6"),
        objects.ipv6(packed("FE80" + "00" * 12, big(n % 65535 + 1, 2))).alias("ipv6"), objects.resolver_address(packed("04000000", big(a, 4))).alias("resolver"), objects.sockaddr(packed("10", big(n % 9 + 40, 1))).alias("other"),
    )


@query("q_object_directory", "SELECT event_id, 'S-1-5-21-' || event_id || '-' || (event_id * 3) AS sid, CASE event_id % 3 WHEN 0 THEN 'user: ' || event_id || '@/Local' WHEN 1 THEN 'group: ' || event_id || '@/Local' ELSE 'Unknown Member type 9: @@/Local' END AS member FROM events")
def directory(spark, d):
    n = F.col("event_id")
    path = F.concat(F.hex(F.lit("/Local")), F.lit("00"))
    kind = F.when(n % 3 == 0, "23").when(n % 3 == 1, "C3").otherwise("09")
    member = packed(kind, F.when(n % 3 == 2, "").otherwise(little(n, 4)), path)
    # One skipped block, authority 5, first part 21, then 32-bit parts.
    return table(spark, d, "events").select("event_id", objects.sid(packed("0100" + "0515000000", little(n, 4), little(n * 3, 4))).alias("sid"), objects.member_details(member).alias("member"))


@query("q_object_states", "SELECT event_id, '{\"locationRestricted\":' || CASE event_id % 2 WHEN 0 THEN 'false' ELSE 'true' END || ', \"locationServicesenabledStatus\":' || (event_id % 5) || '}' AS client, 'rdata: ' || (event_id % 100) || ' . alpn=h2, ipv4 hint:10.0.0.' || (event_id % 256) || ', ipv6 hint:' AS binding, '{\"1\":' || event_id % 128 || ',\"2\":\"' || event_type || '\"}' AS message, 'Unsupported Statedump object: x-' || base64(encode(event_type)) AS other FROM events")
def states(spark, d):
    n, name = F.col("event_id"), F.col("event_type")
    client = packed(little(n % 5, 4), little(n % 2, 4))
    binding = packed(big(n % 100, 2), "00000001", "03", "026832", "00040004", "0A0000", big(n % 256, 1))
    message = F.unhex(F.concat(F.lit("08"), big(n % 128, 1), F.lit("12"), big(F.length(name), 1), F.hex(name)))
    return table(spark, d, "events").select(
        "event_id", objects.client_state(client).alias("client"), objects.service_binding(binding).alias("binding"), objects.state(F.lit(2), F.lit(""), message).alias("message"), objects.state(F.lit(3), F.lit("x"), name.cast("binary")).alias("other"),
    )
