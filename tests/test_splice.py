"""Messages spliced by column expressions against the evaluation of single rows."""

import random

from pyspark.sql import functions as F

from tracelake.functions.tables import MISSING, PRIVATE
from tracelake.operators.printf import Item, format_log, is_plain, render, spliced

ROWS = "n int, raw string, items array<struct<item_type:int,item_size:int,message_strings:string>>"
SPECS = ["%d", "%i", "%u", "%lld", "%hhu", "%zd", "%x", "%lX", "%o", "%s", "%@", "%ls", "%{public}s", "%{private}d", "%{sensitive}@", "%{public}llx", "%%"]
HARD = ["%D", "%O", "%5d", "%.2s", "%*d", "%c", "%m", "%f", "% d", "%", "%{public", "%{bool}d", "%-4x", "%#x", "%{public}%", "%p", "%.*s", "%{signpost.description:attribute}s", "%}", "\0"]
TEXTS = ["", "7", "-12", "+5", "007", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "text", "a%d b", "%%", PRIVATE, "é中\n", " 5", "5\n", "$1 \\ {", "1e3"]
KINDS = [(0, 4), (2, 8), (0x22, 3), (1, 0), (1, 0x8000), (0x21, 0), (0x31, 0), (0x41, 2), (0xF2, 0), (0x10, 3), (0x12, 0), (0, 0)]


def made(specs: list[str], kinds: list[tuple[int, int]], n: int, seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        raw = "".join(rnd.choice(["", "", " ", "a", "x=", "é\n", "{}", "5", "$1"]) + rnd.choice(specs) for _ in range(rnd.randrange(6))) + rnd.choice(["", "end", "%%"])
        rows.append((i, raw, [(*rnd.choice(kinds), rnd.choice(TEXTS)) for _ in range(rnd.randrange(6))]))
    return rows


def expected(raw, items):
    return render(raw, [Item(*i) for i in items])


def test_plain_formats(spark):
    rows = made(SPECS, KINDS[:9] + KINDS[-1:], 3000, 1)
    df = spark.createDataFrame(rows, ROWS)
    texts = F.transform("items", lambda i: F.struct(i["item_type"].alias("t"), i["item_size"].alias("s"), i["message_strings"].alias("m")))
    got = {r.n: r.got for r in df.where(is_plain(F.col("raw"), texts)).select("n", spliced(F.col("raw"), texts).alias("got")).collect()}
    for n, raw, items in rows:
        assert got[n] == expected(raw, items), (raw, items)


def test_all_formats(spark):
    rows = made(SPECS + HARD, KINDS, 3000, 2)
    got = {r.n: r.got for r in spark.createDataFrame(rows, ROWS).select("n", format_log(F.col("raw"), F.col("items")).alias("got")).collect()}
    for n, raw, items in rows:
        assert got[n] == expected(raw, items), (raw, items)


def test_absent_values(spark):
    rows = [(1, None, [(2, 8, "1")]), (2, "a %d", None), (3, "", None), (4, "", [(0x22, 1, "only")]), (5, "%s|%5s", [(0x22, 1, None), (0x22, 1, None)]), (6, "%s", [(0x22, 1, None)]), (7, "", [(2, 8, None)])]
    got = {r.n: r.got for r in spark.createDataFrame(rows, ROWS).select("n", format_log(F.col("raw"), F.col("items")).alias("got")).collect()}
    assert got == {1: None, 2: f"a {MISSING}", 3: "", 4: "only", 5: "|     ", 6: "", 7: ""}


def test_many_conversions(spark):
    """A very long format is spliced without deep recursion."""
    raw, items = "%d,%% " * 5000, [(2, 8, str(i)) for i in range(5000)]
    got = spark.createDataFrame([(1, raw, items)], ROWS).select(format_log(F.col("raw"), F.col("items"))).first()[0]
    assert got == "".join(f"{i},% " for i in range(5000))
