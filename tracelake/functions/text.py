"""Text, byte and time helpers as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.plans.timeline import iso_nanos

__all__ = ["base64_or_null", "c_string", "domain_clean", "iso_millis", "iso_nanos", "mac", "padding", "sized_string", "uuid_hex"]


def padding(n: Column, to: int) -> Column:
    """Bytes to the next multiple of a power of two."""
    return (F.lit(to) - n.bitwiseAND(to - 1)).bitwiseAND(to - 1)


def c_string(text: Column, end: str = "\0") -> Column:
    """All of the text if it does not end with the end mark, else what stands before the first mark."""
    cut = F.when(text.endswith(end), F.substring_index(text, end, 1)).otherwise(text)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "Cannot extract string. Empty input.").otherwise(cut)


def sized_string(text: Column, size: Column) -> Column:
    """The first size characters without zeros at their end; size zero has its own text."""
    return F.when(size == 0, "(null)").otherwise(F.rtrim(F.substring(text, 1, size.cast("int")), F.lit("\0")))


def base64_or_null(text: Column) -> Column:
    return F.try_to_binary(text, F.lit("base64"))


def uuid_hex(base64_text: Column) -> Column:
    return F.hex(F.unbase64(base64_text))


def mac(base64_text: Column) -> Column:
    return F.regexp_replace(F.hex(F.unbase64(base64_text)), "(..)(?!$)", "$1:")


def domain_clean(text: Column) -> Column:
    """Control characters as dots."""
    return F.regexp_replace(text, r"[\x01-\x1F\x7F-\x9F]", ".")


def iso_millis(seconds: Column) -> Column:
    """Seconds since 1970 as RFC 3339 text with milliseconds."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
