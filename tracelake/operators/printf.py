"""Evaluation of printf-style format strings with annotated values."""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelake.functions.packed import let
from tracelake.functions.tables import MISSING, PRIVATE
from tracelake.operators.objects import bits, decoded, errno

#: Fixed value: what counts as a conversion. Either an annotation in braces and a conversion, or a plain conversion.
TOKEN = r"(%(?:(?:\{[^}]+}?)(?:[-+0#]{0,5})(?:\d+|\*)?(?:\.(?:\d+|\*))?(?:h|hh|l|ll|w|I|z|t|q|I32|I64)?[cmCdiouxXeEfgGaAnpsSZP@}]|(?:[-+0 #]{0,5})(?:\d+|\*)?(?:\.(?:\d+|\*))?(?:h|hh|l||q|t|ll|w|I|z|I32|I64)?[cmCdiouxXeEfgGaAnpsSZP@%]))"
TOKENS = re.compile(TOKEN)
FLOATS, INTEGERS, HEX, OCTAL, TEXTS = set("fFeEgG"), set("dDiu"), set("xXaAp"), set("oO"), set("cs@SCP")
LENGTHS = {"h", "hh", "l", "ll", "w", "I", "z", "t", "q"}
LENGTH_RUN, TYPE_RUN, DIGITS = re.compile(r"[hlwIztq]+"), re.compile(r"[cmCdiouxXeEfgGaAnpsSZP@]+"), re.compile(r"[0-9]*")
PRECISION_END = re.compile(r"[^hljzZtqLdDiuUoOcCxXfFeEgGaASspPn%@]+")
DYNAMIC, HIDDEN, HASHED = (0x10, 0x12), (0x1, 0x21, 0x31, 0x41), 0xF2


class Item(NamedTuple):
    item_type: int
    item_size: int
    text: str


class Unreadable(ValueError):
    """A conversion that does not follow the grammar; its item is shown as it is."""


@dataclass(frozen=True)
class Conversion:
    """One conversion, taken apart. A star is width or precision None with its flag set."""

    left: bool
    plus: bool
    alternate: bool
    zero: bool
    width: str
    star: bool
    precision: str | None
    kind: str


@lru_cache(maxsize=20_000)
def conversion(spec: str) -> Conversion:
    """Takes a conversion apart; its first character (a percent sign or closing brace) does not matter."""
    n = 1
    while n < len(spec) and spec[n] in "-+#0":
        n += 1
    flags, rest = (spec[1:n], spec[n:]) if n < len(spec) else (spec[1:], spec[1:])
    width = DIGITS.match(rest)[0]
    rest = rest[len(width) :]
    star = rest.startswith("*")
    rest = rest[star:]
    precision = None
    if rest.startswith("."):
        found = PRECISION_END.match(rest.lstrip("."))
        if not found:
            raise Unreadable(spec)
        precision, rest = found[0], rest.lstrip(".")[found.end() :]
    run = LENGTH_RUN.match(rest)
    if run and run[0] not in LENGTHS:
        return Conversion("-" in flags, "+" in flags, "#" in flags, "0" in flags, width, star, precision, run[0])
    kind = TYPE_RUN.match(rest[run.end() :] if run else rest)
    if not kind:
        raise Unreadable(spec)
    return Conversion("-" in flags, "+" in flags, "#" in flags, "0" in flags, width, star, precision, kind[0])


def integer(text: str) -> int:
    try:
        value = int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else 0
    except ValueError:
        return 0
    return value if -(1 << 63) <= value < 1 << 63 else 0


def float_of_bits(text: str) -> float:
    return struct.unpack("<d", struct.pack("<q", integer(text)))[0]


def digits(c: Conversion, text: str, precision: int) -> str | None:
    """The value in the conversion's form, without width; None for kinds that leave the text alone."""
    if c.kind in FLOATS:
        value = float_of_bits(text)
        if value != value or value in (float("inf"), float("-inf")):
            return bits(value)
        return f"{value:.{precision}f}" if precision else bits(value)
    if c.kind in INTEGERS:
        return str(integer(text))
    if c.kind in HEX:
        return ("0x" if c.alternate else "") + f"{integer(text) & (1 << 64) - 1:X}"
    if c.kind in OCTAL:
        return ("0o" if c.alternate else "") + f"{integer(text) & (1 << 64) - 1:o}"
    if c.kind in TEXTS:
        return text[:precision] if precision else text
    return None


def filled(c: Conversion, text: str, width: int, precision: int) -> str:
    """The value, padded to the width; the plus sign takes a column of it."""
    value = digits(c, text, precision)
    if value is None:
        return text
    sign, room = ("+", max(width - 1, 0)) if c.plus else ("", width)
    fill = "0" if c.zero else " "
    if c.kind in HEX and c.left and not c.zero:
        # Left-aligned hexadecimals are filled with zeros and lose their prefix.
        return sign + value.removeprefix("0x" if c.alternate else "").ljust(room, "0") if width else sign + value
    return sign + (value.ljust(room, fill) if c.left else value.rjust(room, fill))


def plain(spec: str, items: list[Item], at: int, kind: int) -> str:
    """A conversion without annotation applied to the item at a place."""
    precision = 0
    if kind in DYNAMIC:
        precision, at = items[at].item_size, at + 1
        if at >= len(items):
            return "Failed to format string due index length"
    text = items[at].text
    if spec[-1:].lower() == "c" and items[at].item_type in (0, 1, 2):
        if not re.fullmatch(r"\+?[0-9]+", text) or int(text) >= 1 << 32:
            return "Failed to parse number item to char string"
        text = chr(int(text) & 255)
    c = conversion(spec)
    width = c.width
    if c.star:
        if kind == 0 and items[at].item_size == 0:
            precision, at = 0, at + 1
            if at >= len(items):
                return "Failed to format precision/dynamic string due index length"
            text = items[at].text
        width = str(precision)
    if c.precision is not None:
        if c.precision != "*":
            precision = int(c.precision) if c.precision.isdigit() else precision
        elif precision:
            precision = len(items)
    if c.kind == "m":
        return errno(text)
    return filled(c, text, int(width or 0), precision)


def annotated(spec: str, items: list[Item], at: int, kind: int) -> str:
    """A conversion after an annotation in braces: decoded, or printed as a plain one."""
    if "}" not in spec:
        raise Unreadable(spec)
    annotation, rest = spec[: spec.index("}")], spec[spec.index("}") :]
    own = at + (kind == 0x12)
    if own >= len(items):
        return f"Index out of bounds for FirehoseItemInfo Vec. Got adjusted index {own}, Vec size is {len(items)}. This should not have happened"
    item = items[own]
    if ("mask.hash" in annotation and item.item_type == HASHED) or item.text == PRIVATE:
        value = item.text
    else:
        value = decoded(annotation, item.text)
    if value:
        return value
    value = plain(rest, items, at, kind)
    if "signpost" in annotation:
        parts = annotation.lstrip("%{").split(",")
        note = parts[0] if annotation.startswith("%{sign") else parts[1].strip() if len(parts) > 1 else ""
        value = f"{value} ({note})"
    return value


def render(raw: str, items: list[Item]) -> str:
    """The message of a format string and its items."""
    if not raw:
        return items[0].text if items else ""
    out, rest, at = [], raw, 0
    for found in TOKENS.finditer(raw):
        spec = found[0]
        if spec.startswith("% "):
            continue
        if spec == "%%":
            value = "%"
        elif at >= len(items):
            value = MISSING
        elif spec.startswith("%{") and spec.endswith("}"):
            value = spec
        else:
            at += items[at].item_type in DYNAMIC
            if at < len(items) and items[at].item_type == 0 and items[at].item_size == 0 and "%*" in spec:
                at += 1
            if at >= len(items):
                value = MISSING
            else:
                item = items[at]
                hidden = (item.item_type in HIDDEN and not item.text and not item.item_size) or (item.item_type == 1 and item.item_size == 0x8000)
                try:
                    value = PRIVATE if hidden else (annotated if spec.startswith("%{") else plain)(spec, items, at, item.item_type)
                except Unreadable:
                    value = item.text
                at += 1
        before, _, rest = rest.partition(spec)
        out += [before, value]
    return "".join([*out, rest])


#: What follows the percent sign of a conversion that column expressions print: no flags, width or precision, and no annotation that names a decoder.
PLAIN = r"(?:\{(?:public|private|sensitive)\})?(?:hh|h|ll|l|q|z|t)?([diuxXos@S])"
#: Stands for a percent sign written twice.
TWICE = "\0"


def is_plain(raw: Column, items: Column) -> Column:
    """Whether `spliced` can print the row: every conversion is plain, and no item holds the width of the next one.

    Written without lambdas, so that it may guard the arguments of a Python function.
    """
    marked = F.replace(raw, F.lit("%%"), F.lit(TWICE))
    plain = ~marked.rlike(f"%(?!{PLAIN})") & ~F.contains(raw, F.lit(TWICE))
    dynamic = F.coalesce(F.arrays_overlap(items["t"], F.array(*map(F.lit, DYNAMIC))), F.lit(False))
    return (raw == "") | (plain & ~dynamic)


def spliced(raw: Column, items: Column) -> Column:
    """The message of a format of plain conversions, without Python.

    Every conversion takes one item, as none has a width or a precision of its own, so the i-th conversion shows the
    i-th item.
    """

    def shown(kind: Column, noted: Column, item: Column, text: Column) -> Column:
        number = F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint")), F.lit(0))
        hidden = (item["t"].isin(*HIDDEN) & (text == "") & (item["s"] == 0)) | ((item["t"] == 1) & (item["s"] == 0x8000))
        return (
            F.when(item.isNull(), MISSING)
            .when(hidden | (noted & (text == PRIVATE)), PRIVATE)
            .when(kind.isin("s", "@", "S"), text)
            .when(kind.isin("d", "i", "u"), number.cast("string"))
            .when(kind.isin("x", "X"), F.hex(number))
            .otherwise(F.conv(F.hex(number), 16, 8))
        )

    def untwice(text: Column) -> Column:
        return F.replace(text, F.lit(TWICE), F.lit("%"))

    def piece(after: Column, i: Column) -> Column:
        """What stands from one percent sign to the next; the first piece stands before all of them."""
        kind, rest = F.regexp_extract(after, f"^{PLAIN}", 1), F.regexp_replace(after, f"^{PLAIN}", "")
        value = let(F.get(items, i - 1), lambda item: shown(kind, F.startswith(after, F.lit("{")), item, F.coalesce(item["m"], F.lit(""))))
        return F.when(i == 0, untwice(after)).otherwise(F.concat(value, untwice(rest)))

    def joined(marked: Column) -> Column:
        # In a plain format every percent sign left begins a conversion.
        return F.array_join(F.transform(F.split(marked, "%", -1), piece), "")

    first = F.coalesce(F.get(items, F.lit(0))["m"], F.lit(""))
    return F.when(raw == "", first).otherwise(let(F.replace(raw, F.lit("%%"), F.lit(TWICE)), joined))


def pieces(raw: str) -> list[tuple[str, str | None]]:
    """A format in parts (text before, conversion); the last one has none. As `render` cuts it."""
    out, rest = [], raw
    for found in TOKENS.finditer(raw):
        if not found[0].startswith("% "):
            before, _, rest = rest.partition(found[0])
            out.append((before, found[0]))
    return [*out, (rest, None)]


#: Places up to which the digits of every double, as an integer below 2**53, stay below 2**63.
PLACES = 3


def float_digits(number: Column, places: int) -> Column:
    """The double with these bits to 1 to PLACES places, ties of its exact value to even, or with 0 in its shortest digits.

    Null for what this arithmetic cannot tell: large and tiny values, those that are no numbers, and shortest digits of
    more than 15 places, which the JVM may give too long.
    """
    power = F.shiftright(number, 52).bitwiseAND(2047)
    part = number.bitwiseAND((1 << 52) - 1) + F.when(power == 0, F.lit(0).cast("bigint")).otherwise(F.lit(1 << 52))
    # The value is part / 2**down; nothing is written out twice that is not a field of a value held once a row.
    down = F.when(number.bitwiseAND((1 << 63) - 1) == 0, F.lit(1).cast("bigint")).otherwise(1075 - F.greatest(power, F.lit(1).cast("bigint"))).cast("int")
    sign = F.when(number < 0, "-").otherwise("")
    step = lambda v: F.call_function("shiftleft", F.lit(1).cast("bigint"), v["down"])

    def fixed(v: Column) -> Column:
        scaled = v["part"] * 10**places
        whole, twice = F.call_function("shiftright", scaled, v["down"]), scaled.bitwiseAND(step(v) - 1) * 2
        up = (twice > step(v)) | ((twice == step(v)) & (whole.bitwiseAND(1) == 1))
        return let((whole + F.when(up, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))).cast("string"), pointed)

    def pointed(digits: Column) -> Column:
        return let(F.lpad(digits, F.greatest(F.lit(places + 1), F.length(digits)), F.lit("0")), lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - places), F.lit("."), F.right(d, F.lit(places))))

    def shortest(v: Column) -> Column:
        # Two decimals of at most 15 digits are never one double, so a short one is the shortest.
        short = let((v["part"].cast("double") / step(v).cast("double")).cast("string"), lambda t: F.when(~F.contains(t, F.lit("E")) & (F.length(t) <= 16), t))
        return F.when(v["part"].bitwiseAND(step(v) - 1) == 0, F.call_function("shiftright", v["part"], v["down"]).cast("string")).otherwise(short)

    parts = F.struct(part.alias("part"), down.alias("down"))
    return F.concat(sign, let(parts, lambda v: F.when(v["down"].between(1, 61), (fixed if places else shortest)(v))))


def beyond(number: Column, places: int) -> Column:
    """Whether `float_digits` is null, told from the exponent alone where the places are given."""
    size = number.bitwiseAND((1 << 63) - 1)
    far = (size != 0) & ~size.between(1014 << 52, (1075 << 52) - 1)
    return far if places else far | float_digits(number, 0).isNull()


def known_conversion(spec: str, kind: Column, size: Column, given: Column, absent: Column) -> tuple[Column, Column] | None:
    """What a conversion shows of an item, and whether Python must evaluate the row; None if it must evaluate all."""
    note, rest = "", spec
    if spec.startswith("%{"):
        note, end, rest = spec.partition("}")
        if note[2:] not in ("public", "private", "sensitive") or not rest:
            return None
        rest = end + rest
    try:
        c = conversion(rest)
    except Unreadable:
        return None
    if c.star or spec[-1:] in "cC" or (c.precision is not None and not c.precision.isdigit()) or c.kind not in FLOATS | INTEGERS | HEX | OCTAL | TEXTS:
        return None
    width, places = int(c.width or 0), int(c.precision or 0)
    if c.kind in FLOATS and places > PLACES:
        return None
    text = F.coalesce(given, F.lit(""))
    number = F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint")), F.lit(0).cast("bigint"))
    hard = kind.isin(*DYNAMIC)
    if c.kind in FLOATS:
        hard = hard | let(number, lambda n: beyond(n, places))
        value = let(number, lambda n: float_digits(n, places))
    elif c.kind in INTEGERS:
        value = number.cast("string")
    elif c.kind in HEX:
        value = F.concat(F.lit("0x" if c.alternate else ""), F.hex(number))
    elif c.kind in OCTAL:
        value = F.concat(F.lit("0o" if c.alternate else ""), F.conv(F.hex(number), 16, 8))
    else:
        value = F.substring(text, 1, places) if places else text
    room, fill = max(width - 1, 0) if c.plus else width, "0" if c.zero else " "
    if c.kind in HEX and c.left and not c.zero and width:
        value, fill = F.hex(number), "0"
    elif c.kind in HEX and c.left and not c.zero:
        room = 0
    if room:
        value = let(value, lambda v: (F.rpad if c.left else F.lpad)(v, F.greatest(F.lit(room), F.length(v)), F.lit(fill)))
    value = F.concat(F.lit("+"), value) if c.plus else value
    hidden = (kind.isin(*HIDDEN) & (text == "") & (size == 0)) | ((kind == 1) & (size == 0x8000))
    if note:
        hidden = hidden | (text == PRIVATE)
    return F.when(absent, MISSING).when(hidden, PRIVATE).otherwise(value), F.coalesce(hard & ~absent, F.lit(False))


def known_format(raw: str, items: Column) -> tuple[Column, Column] | None:
    """The message of a format known with the plan, as one expression of the items' fields, and whether Python must evaluate the row; None if it must evaluate all."""
    if not raw:
        return F.coalesce(F.get(items["message_strings"], F.lit(0)), F.lit("")), F.lit(False)
    shown, at, hard = [], 0, F.lit(False)
    for before, spec in pieces(raw):
        shown.append(F.lit(before))
        if spec == "%%":
            shown.append(F.lit("%"))
        elif spec:
            kind, size, text = (F.get(items[c], F.lit(at)) for c in ("item_type", "item_size", "message_strings"))
            absent = F.coalesce(F.size(items["item_type"]), F.lit(0)) <= at
            value = known_conversion(spec, kind, size, text, absent)
            if value is None:
                return None
            shown.append(value[0])
            hard = hard | value[1]
            at += 1
    return F.concat(*shown), hard


def format_log(raw: Column | str, items: Column) -> Column:
    """The message column of a format string column, or of one format known with the plan, and an array column of items.

    It is a column expression, so a plan that does not use the message drops it. Formats of plain conversions are
    spliced in the JVM; of their rows Python sees a null only. A null format has a null message, null items are none,
    and an item's null text is empty. A format given as text is taken apart once, and each of its conversions with widths,
    places or flags is an expression of its own; Python sees rows that need it only.
    """
    kind = "array<struct<t:int,s:int,m:string>>"
    texts = F.coalesce(F.arrays_zip(items["item_type"], items["item_size"], items["message_strings"]).cast(kind), F.array().cast(kind))
    known = known_format(raw, items) if isinstance(raw, str) else None
    if isinstance(raw, str):
        raw = F.lit(raw)
    if known is not None:
        message, hard = known
        return F.coalesce(_format_rest(F.when(hard, F.to_json(F.struct(raw.alias("raw"), texts.alias("items"))))), message)
    other = F.when(~is_plain(raw, texts), F.to_json(F.struct(raw.alias("raw"), texts.alias("items"))))
    # What Python gets no row for is null there, so the formats are told apart once.
    return F.coalesce(_format_rest(other), spliced(raw, texts))


def evaluated(raw: str | None, items: list[dict] | None) -> str | None:
    return None if raw is None else render(raw, [Item(i["t"], i["s"], i["m"] or "") for i in items] if items is not None else [])


@F.pandas_udf(StringType())
def _format(raw: pd.Series, items: pd.Series) -> pd.Series:
    return pd.Series([evaluated(r, own) for r, own in zip(raw, items, strict=True)], dtype=object)


@F.arrow_udf(StringType())
def _format_rest(rows: pa.Array) -> pa.Array:
    # A row travels as one text, as nested columns are slow to hand over even where they are null.
    if rows.null_count == len(rows):
        return pa.nulls(len(rows), pa.string())
    given = (None if r is None else json.loads(r) for r in rows.to_pylist())
    return pa.array([None if r is None else render(r["raw"], [Item(i["t"], i["s"], i.get("m", "")) for i in r["items"]]) for r in given], pa.string())
