"""Network values as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ipv4(number: Column) -> Column:
    """A 32-bit number as dotted quads."""
    return F.concat_ws(".", *[F.shiftrightunsigned(number.cast("bigint"), s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ipv4_of_base64(text: Column) -> Column:
    return ipv4(F.conv(F.hex(F.unbase64(text)), 16, 10).cast("bigint"))


def sockaddr4(number: Column, port: Column) -> Column:
    """An address with its port, which is left out if it is zero."""
    return F.when(port == 0, ipv4(number)).otherwise(F.concat(ipv4(number), F.lit(":"), port.cast("string")))


def dns_header(number: Column, flags: Column, question: Column, answer: Column, authority: Column, additional: Column) -> Column:
    from tracelake.functions.codes import dns_flags

    counts = F.concat(F.lit("Question Count: "), question.cast("string"), F.lit(", Answer Record Count: "), answer.cast("string"), F.lit(", Authority Record Count: "), authority.cast("string"), F.lit(", Additional Record Count: "), additional.cast("string"))
    return F.concat(F.lit("Query ID: 0x"), F.hex(number), F.lit(", Flags: 0x"), F.hex(flags), F.lit(" "), dns_flags(flags), F.lit(", "), counts)
