"""Code tables as column functions: text or number in, text out, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import tables as t


def lookup(code: Column, table: dict, default: Column | str) -> Column:
    """The table's text for a code, shown as decimal text; default for others."""
    entries = F.create_map(*[F.lit(x) for k, v in table.items() for x in (str(k), v)])
    return F.coalesce(F.element_at(entries, code.cast("string")), default if isinstance(default, Column) else F.lit(default))


def errno(code: Column) -> Column:
    return lookup(code, t.ERRNO, F.concat(F.lit("Unknown errno: "), code.cast("string")))


def mach_errno(code: Column) -> Column:
    return lookup(code, t.MACH_ERRNO, F.concat(F.lit("Unknown mach errno: "), code.cast("string")))


def mode(digits: Column) -> Column:
    """Each character of the number as a triple of permissions."""
    each = F.transform(F.split(digits.cast("string"), ""), lambda d: lookup(d, t.MODE, "---"))
    return F.concat(F.lit("-"), F.when(F.length(digits.cast("string")) > 0, F.array_join(each, "")).otherwise(""))


def od_error(code: Column) -> Column:
    return lookup(code, t.OD_ERROR, code.cast("string"))


def od_member(code: Column) -> Column:
    return lookup(code, t.OD_MEMBER, code.cast("string"))


def location_authorization(code: Column) -> Column:
    return lookup(code, t.LOCATION_AUTHORIZATION, "Unknown Core Location client authorization status")


def location_daemon(code: Column) -> Column:
    return lookup(code, t.LOCATION_DAEMON, "Unknown Core Location daemon status type")


def location_harvester(code: Column) -> Column:
    return lookup(code, {k: f'"{v}"' for k, v in t.LOCATION_HARVESTER.items()}, "Unknown Core Location subhaverster identifier type")


def location_io(code: Column) -> Column:
    return lookup(code, t.LOCATION_IO, "Unknown IO Message")


def sqlite_code(code: Column) -> Column:
    return lookup(code, t.SQLITE, "Unknown Core Location sqlite error")


def dns_type(code: Column) -> Column:
    return lookup(code, t.DNS_TYPE, "Unknown DNS Resource Record Type")


def dns_reason(code: Column) -> Column:
    return lookup(code, t.DNS_REASON, "Unknown DNS Reason")


def dns_protocol(code: Column) -> Column:
    return lookup(code, t.DNS_PROTOCOL, "Unknown DNS Protocol")


def dns_options(code: Column) -> Column:
    return lookup(code, t.DNS_OPTIONS, "Unknown DNS getaddrinfo options")


def one_of(code: Column, value: str, same: str, other: str) -> Column:
    return F.when(code.cast("string") == value, same).otherwise(other)


def upper_bool(code: Column) -> Column:
    return one_of(code, "0", "NO", "YES")


def lower_bool(code: Column) -> Column:
    return one_of(code, "0", "false", "true")


def added(code: Column) -> Column:
    return one_of(code, "1", "add", "rmv")


def yes_no(code: Column) -> Column:
    return one_of(code, "0", "no", "yes")


def acceptable(code: Column) -> Column:
    return one_of(code, "0", "unacceptable", "acceptable")


def log_type(code: Column, activity: Column) -> Column:
    return F.when(code == 1, F.when(activity == 2, "Create").otherwise("Info")).otherwise(lookup(code, t.LOG_TYPE, "Default"))


def event_type(code: Column) -> Column:
    return lookup(code, t.EVENT_TYPE, "Unknown")


def dns_flags(value: Column) -> Column:
    """The sixteen flag bits of a name-service message in words."""
    bit = lambda n, mask: F.shiftright(value, n).bitwiseAND(mask)
    parts = [
        ("Opcode: ", lookup(bit(11, 15), t.DNS_OPCODE, "UNKNOWN OPCODE"), ", "), ("Query Type: ", bit(15, 1), ","), ("Authoritative Answer Flag: ", bit(10, 1), ", "),
        ("Truncation Flag: ", bit(9, 1), ", "), ("Recursion Desired: ", bit(8, 1), ", "), ("Recursion Available: ", bit(7, 1), ", "), ("Response Code: ", lookup(bit(0, 15), t.DNS_RCODE, "Unknown Response Code"), ""),
    ]
    return F.concat_ws("\n    ", *[F.concat(F.lit(a), b.cast("string"), F.lit(c)) for a, b, c in parts])


def dns_id_flags(value: Column) -> Column:
    flags = value.bitwiseAND(65535)
    return F.concat(F.lit("id: 0x"), F.hex(F.shiftrightunsigned(value, 16)), F.lit(", flags: 0x"), F.hex(flags), F.lit(" "), dns_flags(flags))


def dns_counts(value: Column) -> Column:
    part = lambda n: F.shiftrightunsigned(value, n).bitwiseAND(65535).cast("string")
    return F.concat(F.lit("Question Count: "), part(48), F.lit(", Answer Record Count: "), part(32), F.lit(", Authority Record Count: "), part(16), F.lit(", Additional Record Count: "), part(0))
