"""Formats known with the plan, as expressions of their own, against the evaluation of single rows."""

import random
import struct

from pyspark.sql import functions as F

from tests.test_splice import KINDS, ROWS, TEXTS, expected
from tracelake.operators.printf import format_log, known_format, pieces

PLAIN = ["", "a", "%d", "%08d|%-8d|%+8d", "%+d %-5u", "%#10x %-8x %-#9x %-08x %#010o %o", "[%{public}s] %.3@ %-6.2s|", "%{private}5d %{sensitive}.1f", "100%% %5u%%", "%.3f %010.1f %f", "%-9.2f|%+9.2f|%e|%G", "%lld %hhu %p %a", "%+s %+3s %05s", "%D %O %i", "x%%d %d", "%d%d %s"]
HARD = ["%*d", "%c %d", "% d %d", "%m", "%{bool}d", "%.9f", "%.*s", "%{public", "%{public}%"]
FLOATS = [0.0, -0.0, 0.125, 0.375, 2.675, 1.005, 0.0005, 0.0015, 12.5, -12.5, 0.1, 0.3, 1 / 3, 1e7, 1e15, 2.0**53, 1e22, 1e-5, 5e-324, 9007199254740991.0, 4503599627370497.5, 99999.9995, float("inf"), float("nan"), 12345678.25, 0.05, -0.0004, 2.5, 0.25]


def bits(value: float) -> str:
    return str(struct.unpack("<q", struct.pack("<d", value))[0])


def test_known_formats(spark):
    rnd = random.Random(3)
    texts = TEXTS + [bits(v) for v in FLOATS] + [bits(rnd.uniform(-100, 100)) for _ in range(40)] + [bits(rnd.randrange(-4000, 4000) / 8) for _ in range(80)] + [bits(rnd.randrange(10**6) / 10000) for _ in range(40)]
    rows = [(i, "", [(*(rnd.choice(KINDS) if rnd.random() < 0.3 else (2, 8)), rnd.choice(texts)) for _ in range(rnd.randrange(7))]) for i in range(1500)]
    df = spark.createDataFrame(rows, ROWS)
    got = df.select("n", *[format_log(f, F.col("items")).alias(f"c{i}") for i, f in enumerate(PLAIN + HARD)]).collect()
    for r in got:
        for i, f in enumerate(PLAIN + HARD):
            assert r[f"c{i}"] == expected(f, rows[r.n][2]), (f, rows[r.n][2])


def test_rows_without_python(spark):
    """Widths, places and flags need no Python; before, every row of such a format went there."""
    values = [0.125, 2.675, 12.5, -0.05, 100.0, 0.1, 0.0]
    df = spark.createDataFrame([(i, "", [(2, 8, bits(v))]) for i, v in enumerate(values)], ROWS)
    for f in ("%.3f", "%010.1f", "%f", "%-12.2f|"):
        got = {r.n: r.got for r in df.select("n", F.when(~known_format(f, F.col("items"))[1], known_format(f, F.col("items"))[0]).alias("got")).collect()}
        assert got == {i: expected(f, [(2, 8, bits(v))]) for i, v in enumerate(values)}


def test_absent_items(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", [(2, 8, None)]), (3, "", [])], ROWS)
    for f in ("%5d|%s", "%.2f", "", "%s"):
        got = {r.n: r.got for r in df.select("n", format_log(f, F.col("items")).alias("got")).collect()}
        want = {r.n: r.got for r in df.select("n", format_log(F.lit(f), F.col("items")).alias("got")).collect()}
        assert got == want


def test_pieces():
    assert pieces("a %d%% b") == [("a ", "%d"), ("", "%%"), (" b", None)]
