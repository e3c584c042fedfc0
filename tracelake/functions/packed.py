"""Values packed into base64 text, taken apart by column expressions alone.

A value is held as the hexadecimal digits of its bytes, two to a byte. Null stays null; text that is not base64, and bytes
that end too early, give the fixed texts of their kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Padded base64 without blanks.
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def size(digits: Column) -> Column:
    return F.floor(F.length(digits) / 2).cast("int")


def cut(digits: Column, at: int | Column, n: int | Column) -> Column:
    """n bytes from a place, as digits."""
    at, n = (F.lit(x) if isinstance(x, int) else x for x in (at, n))
    return F.substr(digits, at * 2 + 1, n * 2)


def rest(digits: Column, at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.substr(digits, at * 2 + 1)


def big(digits: Column, at: int | Column, n: int) -> Column:
    """The number of at most seven bytes, highest first."""
    return F.conv(cut(digits, at, n), 16, 10).cast("bigint")


def little(digits: Column, at: int | Column, n: int) -> Column:
    """The number of at most seven bytes, lowest first."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.concat(*[cut(digits, at + i, 1) for i in reversed(range(n))]), 16, 10).cast("bigint")


def guarded(text: Column, undecoded: str, unread: str, read: Callable[[Column], Column]) -> Column:
    """What read makes of a value's digits, with the two error texts; read gives null for bytes that end too early."""
    digits = F.when(text.rlike(BASE64), F.hex(F.unbase64(text)))
    return F.when(text.isNotNull(), let(digits, lambda h: F.when(h.isNull(), undecoded).otherwise(F.coalesce(read(h), F.lit(unread)))))


# Addresses


def quads(digits: Column, at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(size(digits) >= at + 4, F.concat_ws(".", *[big(digits, at + i, 1).cast("string") for i in range(4)]))


def shortened(groups: Column) -> Column:
    """Eight groups joined by colons, with the first of the longest runs of two or more zero groups left out."""

    def without(joined: Column, run: Column) -> Column:
        # A run of zeros is a prefix of every longer one, so the greatest text is the longest run.
        around, gap = F.concat(F.lit(":"), joined, F.lit(":")), F.concat(F.lit(":"), run, F.lit(":"))
        before = F.split_part(around, gap, F.lit(1))
        after = F.substr(around, F.length(before) + F.length(gap) + 1)
        return F.when(run.isNull(), joined).otherwise(F.concat(F.btrim(before, F.lit(":")), F.lit("::"), F.btrim(after, F.lit(":"))))

    runs = lambda joined: F.array_max(F.regexp_extract_all(joined, F.lit(r"\b0(?::0)+\b"), F.lit(0)))
    return let(groups, lambda joined: let(runs(joined), lambda run: without(joined, run)))


def address6(digits: Column, at: int) -> Column:
    """An address of sixteen bytes in its shortest form; mapped ones end in dotted quads."""
    groups = F.concat_ws(":", *[F.regexp_replace(F.lower(cut(digits, at + 2 * i, 2)), "^0{1,3}", "") for i in range(8)])
    mapped = cut(digits, at, 12) == "00" * 10 + "FFFF"
    said = F.when(mapped, F.concat(F.lit("::ffff:"), quads(digits, at + 12))).otherwise(shortened(groups))
    return F.when(size(digits) >= at + 16, said)


def ipv6(text: Column) -> Column:
    return guarded(text, "Failed to base64 decode ipv6 data", "Failed to get ipv6", lambda h: address6(h, 0))


def sockaddr(text: Column) -> Column:
    """A socket address of either family with its port, which is left out if it is zero."""

    def read(h: Column) -> Column:
        family, port = big(h, 1, 1), big(h, 2, 2)
        shown = F.when(port == 0, "").otherwise(F.concat(F.lit(":"), port.cast("string")))
        four = F.concat(quads(h, 4), shown)
        numbers = F.concat(F.lit(", Flow ID: "), big(h, 4, 4).cast("string"), F.lit(", Scope ID: "), big(h, 24, 4).cast("string"))
        six = F.when(size(h) >= 28, F.concat(address6(h, 8), shown, numbers))
        other = F.concat(F.lit("Unknown sockaddr family: "), family.cast("string"))
        return F.when(size(h) >= 2, F.when(family == 2, four).when(family == 30, six).otherwise(other))

    return F.when(text == "", "<NULL>").otherwise(guarded(text, "Failed to bas64 decode sockaddr data", "Failed to get sockaddr structure", read))


def resolver_address(text: Column) -> Column:
    version = lambda h: F.when(size(h) >= 4, little(h, 0, 4))
    read = lambda h: F.when(version(h) == 4, quads(h, 4)).when(version(h) == 6, address6(h, 4))
    return guarded(text, "Failed to base64 decode DNS ip address details", "Failed to parse DNS ip address data", read)


# Directory values


def sid(text: Column) -> Column:
    """A security identifier: revision, authority, first part, then 32-bit parts."""

    def read(h: Column) -> Column:
        skipped = big(h, 1, 1)
        start = (skipped + 7).cast("int")
        n = F.floor((size(h) - start) / 4).cast("int")
        parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: little(h, start + i * 4, 4).cast("string"))).otherwise(F.array().cast("array<string>"))
        head = F.concat_ws("-", F.lit("S"), big(h, 0, 1).cast("string"), big(h, start - 5, 1).cast("string"), big(h, start - 4, 1).cast("string"))
        return F.when((size(h) >= 2) & (size(h) >= start), F.concat_ws("-", head, parts))

    return guarded(text, "Failed to base64 decode open directory SID details data", "Failed to get open directory sid details", read)


def member_details(text: Column) -> Column:
    """A member of the directory by number or name, with its node."""

    def upto_zero(h: Column) -> Column:
        return F.regexp_extract(h, "^((?:(?!00)..)*)", 1)

    def words(h: Column) -> Column:
        """Text up to a zero; null if it is empty or not UTF-8. Nothing at all is an empty text."""
        said = F.try_validate_utf8(F.unhex(upto_zero(h)).cast("string"))
        return F.when(F.length(h) == 0, "").when(said != "", said)

    def placed(said: Column, left: Column) -> Column:
        return F.concat(said, F.coalesce(F.concat(F.lit("@"), words(left)), F.lit(" <not found>")))

    def read(h: Column) -> Column:
        kind = big(h, 0, 1)
        own = rest(h, 1)
        number = little(own, 0, 4)
        signed = F.when(number >= 1 << 31, number - (1 << 32)).otherwise(number).cast("string")
        name, after = words(own), rest(own, size(upto_zero(own)) + 1)
        numbered = F.when(size(h) >= 5, placed(F.concat(F.when(kind == 195, "group: ").otherwise("user: "), signed), rest(own, 4)))
        named = placed(F.concat(F.when(kind == 68, "group: ").otherwise("user: "), name), after)
        unknown = placed(F.concat(F.lit("Unknown Member type "), kind.cast("string"), F.lit(": @")), own)
        return F.when(size(h) >= 1, F.when(kind.isin(35, 163, 195), numbered).when(kind.isin(36, 160, 164, 68), named).otherwise(unknown))

    return guarded(text, "Failed to base64 decode open directory member details data", "Failed to get open directory member details", read)


# Location values


def client_state(text: Column) -> Column:
    def read(h: Column) -> Column:
        restricted = F.when(little(h, 4, 4) == 0, "false").otherwise("true")
        said = F.concat(F.lit('{"locationRestricted":'), restricted, F.lit(', "locationServicesenabledStatus":'), little(h, 0, 4).cast("string"), F.lit("}"))
        return F.when(size(h) >= 8, said)

    return guarded(text, "Failed to base64 decode client manager tracker state", "Failed to get client tracker data", read)
