"""What is not referred to is not read, what is decoded is decoded once, and what a stream carries on is bounded."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake import cli
from tracelake.operators.ranges import range_hits, range_lookup
from tracelake.plans import assemble, procs
from tracelake.sources import archive, encode
from tracelake.streaming.live import CHUNK, carried, stream_events

EVENTS = [(n, n % 2, 1.5 * n, ["click", "view"][n % 2]) for n in range(36)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """An archive with string files that nothing refers to and that can't be decoded."""
    files = encode.sample(EVENTS) | {"EE/" + "EE" * 15: b"junk", "dsc/" + "EE" * 16: b"junk", "AA/" + "AB" * 15: b""}
    return encode.write(str(tmp_path_factory.mktemp("needed")), files)


def test_files_without_references_are_never_opened(spark, root):
    records = archive.records(spark, root)
    needed = archive.referenced(records)
    assert {r["uuid"] for r in needed.collect()} == {c * 16 for c in ("AA", "BB", "CC", "DC")}
    texts, shared = archive.uuidtext(spark, root, needed, "FAILFAST"), archive.dsc(spark, root, needed, "FAILFAST")
    assert sorted(r["uuid"] for r in texts.collect()) == ["AA" * 16, "BB" * 16, "CC" * 16] and shared.count() == 1
    assert sorted(f.rsplit("/", 1)[1] for f in texts.inputFiles()) == ["AA" * 15, "BB" * 15, "CC" * 15]
    with pytest.raises(Exception, match="parse UUIDtext file"):
        archive.uuidtext(spark, root, None, "FAILFAST").count()
    assert archive.uuidtext(spark, root, needed.where("false"), "FAILFAST").count() == 0


def test_staged_records_are_pruned(spark, root, tmp_path):
    records = archive.records(spark, root)
    again = archive.staged(records, str(tmp_path / "stage"))
    assert again.columns == records.columns and sorted(map(str, again.collect())) == sorted(map(str, records.collect()))
    plan = procs.of_kind(again, "header").select("boot_uuid")._jdf.queryExecution().executedPlan().toString()
    assert "kind#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "firehose" not in plan.split("ReadSchema: ")[1] and "boot_uuid" in plan.split("ReadSchema: ")[1]


def test_command_line_stages_splits_and_prunes(spark, root, tmp_path):
    out = str(tmp_path / "out")
    cli.main(["log-archive", "--input", root, "--output", out, "--format", "parquet", "--stage", str(tmp_path / "s"), "--split-bytes", "1000"], spark)
    got = spark.read.parquet(out)
    assert got.count() == len(EVENTS) + 2 and not got.where("message LIKE '%Failed to get%'").count()


def test_range_hits_against_a_scan(spark):
    """Overlapping, nested, huge, negative and empty ranges; points on their edges."""
    rnd = random.Random(2)
    size = lambda: rnd.choice([-1, 0, 1, 15, 16, rnd.randrange(300), 1 << 20, (1 << 34) + 3])
    ranges = [(rnd.randrange(4), at, rnd.choice([rnd.randrange(2000), -rnd.randrange(2000), 1 << 40]), size(), f"r{at}") for at in range(150)]
    edges = [v for _, _, low, n, _ in ranges for v in (low - 1, low, low + n, low + n + 1)]
    points = [(k, p) for k in range(5) for p in rnd.sample(edges, 120)]
    df = spark.createDataFrame(ranges, "key int, at int, low long, size long, name string")
    asked = spark.createDataFrame(points, "key int, point long")
    want = {(k, p): next((name for key, _, low, n, name in ranges if key == k and low <= p <= low + n), None) for k, p in points}
    assert {(r["key"], r["point"]): r["name"] for r in range_hits(asked.distinct(), df, ["key"], "point").collect()} == want
    twice = asked.unionAll(asked).unionAll(spark.createDataFrame([(1, None)], "key int, point long"))
    got = range_lookup(twice, df, ["key"], "point")
    assert got.count() == 2 * len(points) + 1 and all(want[r["key"], r["point"]] == r["name"] for r in got.where("point is not null").collect())


def test_what_is_carried_on_stays_as_small(spark):
    """Fifty batches, each with a file, a large value and a chunk that waits for three batches."""
    names = "evidence string, catalog_seq int, chunk_seq int, kind string, age int"
    state, sizes = [], []
    for n in range(50):
        new = [(f"f{n}", c, k, kind, 0) for c, k, kind in [(0, 1, "header"), (1, 0, "catalog"), (1, 1, "firehose"), (1, 2, "firehose"), (1, 3, "oversize"), (2, 0, "catalog")]]
        records = spark.createDataFrame([(*r[:4], r[4] + 1) for r in state] + new, names)
        waiting = records.where("kind = 'firehose' AND chunk_seq = 1 AND age < 3").select(*CHUNK)
        state = [tuple(r) for r in carried(records, waiting, keep=5).select("evidence", "catalog_seq", "chunk_seq", "kind", "age").collect()]
        sizes.append(len(state))
    # Three waiting chunks with header and catalog each, and five large values.
    assert set(sizes[6:]) == {3 * 3 + 5}


def test_a_dump_that_holds_the_marker_is_not_held_back(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    head = [encode.header("B0" * 16), encode.catalog([], [])]
    dump = encode.simpledump(1, 2, 5, "AA" * 16, "DC" * 16, "sub", "lost: <Missing message data>")
    encode.write(root, {"Persist/1.tracev3": encode.trace_file([*head, encode.chunkset([dump])]), "timesync/1.timesync": encode.timesync([("B0" * 16, 1, 1, 0, [(0, 5)])])})

    def sink(df, number):
        df.select("message", "section").write.mode("append").parquet(out)

    stream_events(spark, root, sink, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("lost: <Missing message data>", 1)]


def test_referring_events_meet_values_apart_from_others(spark):
    """The join on large values has no key that all other events share."""
    from tracelake.plans.oversize import with_oversize

    items = "array<struct<item_type:smallint,item_type_size:smallint,offset:int,item_size:int,message_strings:string,item:string>>"
    events = spark.range(2000).selectExpr("'f' AS evidence", "1 AS catalog_seq", "CAST(id AS INT) AS chunk_seq", "0 AS event_seq", "4 AS activity_type", "0L AS data_ref", "1L AS p1", "2L AS p2", f"CAST(array() AS {items}) AS items")
    big = spark.createDataFrame([], f"evidence string, catalog_seq int, chunk_seq int, data_ref long, p1 long, p2 long, items {items}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = with_oversize(events, big).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(counts) == 4 and max(r["count"] for r in counts) < 700


def test_event_table_on_pruned_and_staged_input(spark, root, tmp_path):
    records = archive.staged(archive.records(spark, root), str(tmp_path / "stage"))
    needed = archive.referenced(records)
    rows = assemble.event_table(records, archive.timesync(spark, root), archive.uuidtext(spark, root, needed), archive.dsc(spark, root, needed))
    got = {r["activity_id"]: r["message"] for r in rows.where("section = 0").collect()}
    assert got[0] == "user 0 did click" and got[3] == "shared view" and got[4] == "plugin says click" and got[5] == "relative 5"
