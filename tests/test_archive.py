"""Archives end to end: files to event rows, by every reader, in batch and as a stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracelake import cli, sinks
from tracelake.plans import assemble, procs, strings, timeline
from tracelake.plans.oversize import split_missing, with_oversize
from tracelake.sources import archive, datasource, encode
from tracelake.streaming import bookmark as marks
from tracelake.streaming.live import stream_events

EVENTS = [(n, n % 3, 1.25 * n, ["click", "view", "error"][n % 3]) for n in range(120)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return encode.write(str(tmp_path_factory.mktemp("archive")), encode.sample(EVENTS))


def table(spark, root, **kw):
    return assemble.event_table(archive.records(spark, root, "FAILFAST"), archive.timesync(spark, root), archive.uuidtext(spark, root), archive.dsc(spark, root), **kw)


@pytest.fixture(scope="module")
def rows(spark, root):
    return [r.asDict() for r in assemble.in_order(table(spark, root)).collect()]


def test_every_event_is_a_row(rows):
    assert len(rows) == len(EVENTS) + 2
    assert sorted(r["activity_id"] for r in rows if r["section"] == 0) == list(range(120))
    assert [r["event_type"] for r in rows[-2:]] == ["Simpledump", "Statedump"]


def test_messages_of_all_routes(rows):
    by = {r["activity_id"]: r for r in rows if r["section"] == 0}
    for n, p, value, name in EVENTS:
        want = [f"user {p} did {name}", f"value {int(value * 100)} of {name}", f"hidden {name}", f"shared {name}", f"plugin says {name}", f"relative {n}", f"activity {name}", f"Signpost ID: 4D - Signpost Name: 0\n user {n} did {name}", f"hidden {name * 3}"][n % 9]
        assert by[n]["message"] == want
    assert by[3]["library"] == "/System/Library/Shared" and by[3]["library_uuid"] == "BB" * 16
    assert by[4]["library"] == "/usr/lib/plugin.dylib" and by[4]["process"] == "/usr/libexec/maind"
    assert (by[0]["pid"], by[0]["subsystem"], by[0]["category"], by[0]["timezone_name"]) == (100, "com.example.core", "events", "Paris")
    assert by[0]["message_flags"] == ["HasCurrentAid", "MainExe", "HasSubsystem"]
    assert by[0]["time"] == 1000.0 + 1_700_000_000_000_000_500.0


def test_nothing_is_null(rows):
    assert not [k for r in rows for k, v in r.items() if v is None]


def test_repartitioning_changes_nothing(spark, root, rows):
    again = assemble.event_table(archive.records(spark, root).repartition(7), archive.timesync(spark, root).repartition(3), archive.uuidtext(spark, root), archive.dsc(spark, root))
    assert [r.asDict() for r in assemble.in_order(again).collect()] == rows


def test_missing_strings_and_offsets(spark, root, tmp_path):
    files = {k: v for k, v in encode.sample(EVENTS).items() if not k.startswith(("AA/", "dsc/", "CC/"))}
    files["AA/" + "AA" * 15], _ = encode.uuidtext([(0x9000, ["x"])], "/usr/libexec/maind")
    found = {r["activity_id"]: r for r in table(spark, encode.write(str(tmp_path), files)).where("section = 0").collect()}
    assert found[0]["message"] == f"Error: Invalid offset 4096 for UUID {'AA' * 16}"
    assert found[3]["message"] == "Unknown shared string message" and found[3]["process"] == ""
    assert found[5]["message"] == f"Failed to get string message from alternative UUIDText file: {'CC' * 16}"


def test_shared_strings_of_all_kinds(spark):
    images = [("A" * 32, "/lib/first"), ("B" * 32, "/lib/second")]
    data, at = encode.shared_strings(1, images, [(0x100, 0, ["one"]), (0x80000200, 1, ["two %d"]), (0x900, 7, ["lost"])])
    dsc = archive.dsc_of(spark.createDataFrame([(f"/x/dsc/{'D' * 32}", bytearray(data))], "path string, content binary"))
    text = archive.uuidtext_of(spark.createDataFrame([], "path string, content binary"))
    cases = {1: (at["one"], 0, 0), 2: (at["two %d"] - 0x80000000, 1, 0), 3: (at["two %d"], 0, 0), 4: (0x5000, 0, 0), 5: (at["lost"], 0, 0)}
    rows = [(i, 4, raw, large, cache, True, False, "", 0, 0, "0" * 32, "D" * 32 if i < 6 else "E" * 32, "") for i, (raw, large, cache) in cases.items()] + [(6, 4, 1, 0, 0, True, False, "", 0, 0, "0" * 32, "E" * 32, "")]
    names = "i int, activity_type int, format_location long, large_offset int, large_shared_cache int, shared_cache boolean, absolute boolean, uuid_relative string, alt_index int, pc_id long, main_uuid string, dsc_uuid string, image_uuid string"
    got = {r["i"]: (r["raw_message"], r["library"], r["process"]) for r in strings.with_strings(strings.routed(spark.createDataFrame(rows, names)), text, dsc).collect()}
    assert got == {
        1: ("one", "/lib/first", ""), 2: ("two %d", "/lib/second", ""), 3: ("%s", "/lib/first", ""), 4: ("Error: Invalid shared string offset", "/lib/first", ""),
        5: ("Error: Invalid UUID index", "", ""), 6: ("Unknown shared string message", "", ""),
    }


def test_clocks_against_the_reading_rule(spark):
    import random

    rnd = random.Random(7)
    boots = {f"{b:032X}": [(rnd.randrange(60), rnd.randrange(1, 10**6)) for _ in range(rnd.randrange(7))] for b in range(40)}
    sync = archive.timesync_of(spark.createDataFrame([("a/timesync/1.timesync", bytearray(encode.timesync([(u, 125 if i % 4 == 0 else 1, 3 if i % 4 == 0 else 1, 77, r) for i, (u, r) in enumerate(boots.items())])))], "path string, content binary"))
    asked = [(i, u, rnd.randrange(70), rnd.choice([0, 5])) for i, u in enumerate([*boots, "F" * 32] * 8)]

    def want(uuid, t, base):
        k = w = 0
        factor = 1.0
        if uuid in boots:
            factor = 125 / 3 if list(boots).index(uuid) % 4 == 0 else 1.0
            w = 77 if base == 0 else 0
            for kernel, wall in boots[uuid]:
                if kernel > t:
                    if k == 0 and w == 0:
                        k, w = kernel, wall
                    break
                k, w = kernel, wall
        import math

        return math.fma(t, factor, -(k * factor)) + w

    rows = spark.createDataFrame(asked, "i long, boot_uuid string, continuous_time long, base_time long")
    got = {r["i"]: r["time"] for r in timeline.with_time(rows, sync).collect()}
    assert len(got) == len(asked)
    assert {i: got[i] for i, *_ in asked} == {i: want(u, t, b) for i, u, t, b in asked}


def test_iso(spark):
    got = spark.sql("SELECT 1650767813342574583L AS n UNION ALL SELECT -1L").select(timeline.iso_nanos(F.col("n"))).collect()
    assert {r[0] for r in got} == {"2022-04-24T02:36:53.342574583Z", "1969-12-31T23:59:59.999999999Z"}


def test_router_arithmetic(spark):
    cases = [(7, 0, 5, 7), (7, 1, 0, 7 + 0x80000000), (7, 2, 1, 7 + 0x100000000), (7, 2, 4, 7 + 0x200000000), (7, 3, 0, 7 + 0x300000000), (7, 3, 7, 7 + 0x300000000)]
    rows = spark.createDataFrame(cases, "raw long, large int, cache int, want long")
    assert not rows.where(strings.shared_offset(F.col("raw"), F.col("large"), F.col("cache")) != F.col("want")).count()


def test_oversize_over_files(spark):
    items = "array<struct<item_type:smallint,item_type_size:smallint,offset:int,item_size:int,message_strings:string,item:string>>"
    big = spark.createDataFrame([("b", 1, 1, 9, 1, 2, [(34, 4, 0, 1, "second", "String")]), ("a", 2, 5, 9, 1, 2, [(34, 4, 0, 1, "first", "String")])], f"evidence string, catalog_seq int, chunk_seq int, data_ref long, p1 long, p2 long, items {items}")
    events = spark.createDataFrame([(4, 9, 1, 2, []), (4, 8, 1, 2, []), (4, 0, 1, 2, [(0, 4, 0, 0, "own", "Number")]), (6, 9, 1, 2, [])], f"activity_type int, data_ref long, p1 long, p2 long, items {items}")
    got = {(r["activity_type"], r["data_ref"]): [i["message_strings"] for i in r["message_items"]] for r in with_oversize(events, big).collect()}
    assert got == {(4, 9): ["first"], (4, 8): [], (4, 0): ["own"], (6, 9): []}
    complete, missing = split_missing(spark.createDataFrame([("a",), ("x <Missing message data>",)], "message string"))
    assert (complete.count(), missing.count()) == (1, 1)


def test_absolute_ranges_take_the_first(spark):
    dims = spark.createDataFrame([("e", 1, 1, 2, 0, "A", 100, 50), ("e", 1, 1, 2, 1, "B", 120, 50)], "evidence string, catalog_seq int, p1 long, p2 long, at int, uuid string, low long, size long")
    rows = spark.createDataFrame([("e", 1, 1, 2, a) for a in (99, 100, 130, 150, 151, 170, 171)], "evidence string, catalog_seq int, p1 long, p2 long, address long")
    got = {r["address"]: r["image_uuid"] for r in procs.absolute_image(rows, dims, F.col("address")).collect()}
    assert got == {99: None, 100: "A", 130: "A", 150: "A", 151: "B", 170: "B", 171: None}


def test_path_kinds(spark):
    paths = {
        "/x/Persist/1.tracev3": "TraceV3", "/x/logdata.LiveData.tracev3": "TraceV3", "/x/other/1.tracev3": "Invalid", "/x/timesync/1.timesync": "Timesync", "/x/1.timesync": "Invalid",
        "/x/AB/" + "0" * 30: "UUIDText", "/x/AB/" + "0" * 31: "Invalid", "/x/dsc/" + "0" * 32: "Dsc", "/x/dsc/" + "g" * 32: "Invalid", "name": "Invalid",
    }
    rows = spark.createDataFrame(list(paths.items()), "path string, want string")
    assert not rows.where(archive.file_kind(F.col("path")) != F.col("want")).count()
    got = spark.createDataFrame([("1" * 30,), ("1" * 32,), ("1" * 29,)], "u string").select(archive.padded_uuid(F.col("u"))).collect()
    assert [r[0] for r in got] == ["00" + "1" * 30, "1" * 32, None]


def test_only_needed_string_files_are_read(spark, root):
    needed = spark.createDataFrame([("BB" * 16,)], "uuid string")
    assert [r["uuid"] for r in archive.uuidtext(spark, root, needed).collect()] == ["BB" * 16]


def test_permissive_and_failfast(spark, tmp_path):
    good = encode.sample(EVENTS)
    root = encode.write(str(tmp_path), good | {"Special/bad.tracev3": good["Persist/0000000000000001.tracev3"][:-40], "timesync/bad.timesync": b"junk", "._x/Persist/._a.tracev3": b""})
    assert archive.records(spark, root).count() > 0
    assert archive.timesync(spark, root).count() == 3
    with pytest.raises(Exception, match="Failed to parse tracev3 file: .*bad.tracev3"):
        archive.records(spark, root, "FAILFAST").count()
    with pytest.raises(Exception, match="Failed to parse timesync file: .*bad.timesync"):
        archive.timesync(spark, root, "FAILFAST").count()


def test_data_source(spark, root):
    datasource.register(spark)
    df = spark.read.format("tracelog").option("path", root).load()
    assert sorted(map(str, df.collect())) == sorted(map(str, archive.records(spark, root).collect()))
    assert {r["kind"] for r in spark.read.format("tracelog").option("path", root).option("kind", "firehose").load().select("kind").collect()} == {"firehose"}
    assert df.where("kind = 'oversize'").count() == archive.records(spark, root).where("kind = 'oversize'").count() > 0


def test_sinks_and_command_line(spark, root, tmp_path):
    out = str(tmp_path / "json")
    cli.main(["log-archive", "--input", root, "--output", out, "--ordered"], spark)
    lines = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert len(lines) == 122 and all(len(x) == 22 for x in lines)
    cli.main(["single-file", "--input", f"{root}/Persist/0000000000000001.tracev3", "--output", str(tmp_path / "one"), "--format", "csv"], spark)
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "one"))
    assert one.columns == list(sinks.CSV) and one.count() == 122
    with pytest.raises(ValueError, match="unknown output format"):
        sinks.write(one, str(tmp_path / "x"), "xml")


def test_bookmarks(spark, root, tmp_path):
    mark, outs = str(tmp_path / "mark.json"), [str(tmp_path / f"out{i}") for i in range(2)]
    for out in outs:
        cli.main(["log-archive", "--input", root, "--output", out, "--format", "parquet", "--bookmark", mark], spark)
    assert [spark.read.parquet(o).count() for o in outs] == [122, 0]
    found = marks.load(spark, mark, root)
    assert found.time > 1.7e18 and marks.load(spark, mark, "other").time == 0
    assert marks.default_path("live", "darwin").endswith("/Library/Application Support/tracelake/live.bookmark")
    for mode, text in (("log-archive", "Failed to open directory path"), ("single-file", "Failed to open file path")):
        with pytest.raises(SystemExit, match=text):
            cli.main([mode, "--input", str(tmp_path / "none"), "--output", str(tmp_path / "x")], spark)
    assert found.advanced(1.0) is found and found.advanced(2e18).time == 2e18


def test_exclude_missing(spark, tmp_path):
    files = encode.sample([(8, 0, 1.0, "click"), (0, 0, 1.0, "view")])
    parts = files["Persist/0000000000000001.tracev3"]
    root = encode.write(str(tmp_path), files)
    assert table(spark, root).count() == 4
    # Without the record of the large value its event lacks data.
    rows = archive.records(spark, root).where("kind <> 'oversize'")
    dims = archive.timesync(spark, root), archive.uuidtext(spark, root), archive.dsc(spark, root)
    said = {r["activity_id"]: r["message"] for r in assemble.event_table(rows, *dims).where("section = 0").collect()}
    assert said == {8: "hidden <Missing message data>", 0: "user 0 did view"}
    assert assemble.event_table(rows, *dims, exclude_missing=True).where("section = 0").count() == 1
    assert parts


def test_stream_waits_for_large_values(spark, tmp_path):
    root, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    files = encode.sample([(n, 0, 1.0, "click") for n in range(18)])
    name = "Persist/0000000000000001.tracev3"
    text, at = encode.uuidtext([(0x1000, ["late %s"])], "/bin/late")
    main, boot = "AA" * 16, "B0" * 16
    head = [encode.header(boot), encode.catalog([{"p1": 1, "p2": 2, "pid": 9}], [main])]
    import struct

    waiting = encode.event(4, struct.pack("<II", 5, 77), [], 0x802, at["late %s"])
    ready = encode.event(4, struct.pack("<I", 5), [encode.text_item(0x22, "now")], 0x2, at["late %s"])
    first = encode.trace_file([*head, encode.chunkset([encode.firehose(1, 2, 5, [waiting, ready])])])
    second = encode.trace_file([*head, encode.chunkset([encode.oversize(1, 2, 77, [encode.text_item(0x22, "then")])])])
    third = encode.trace_file([*head, encode.chunkset([encode.firehose(1, 2, 5, [ready])])])
    encode.write(root, {"AA/" + "AA" * 15: text, "timesync/1.timesync": files["timesync/0000000000000001.timesync"]})

    def sink(df, number):
        df.select("message", "evidence").write.mode("overwrite").parquet(f"{out}/{number}")

    got = []
    for k, data in enumerate([first, second, third]):
        encode.write(root, {f"Persist/{k}.tracev3": data})
        stream_events(spark, root, sink, check, per_batch=1).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted(r["message"] for r in spark.read.parquet(*[f"{out}/{n}" for n in os.listdir(out)]).collect()))
    assert got == [["late now"], ["late now", "late then"], ["late now", "late now", "late then"]]
    assert name in files
