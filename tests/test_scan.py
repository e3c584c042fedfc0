"""Ranged scans of large trace files, and chunksets that are never unpacked."""

import struct

import pytest
from pyspark.sql import functions as F

from tracelake.plans import assemble
from tracelake.sources import archive, codec, datasource, encode

MAIN, BOOT = "AA" * 16, "B0" * 16
TEXT, AT = encode.uuidtext([(0x1000, ["tick %d"])], "/bin/clock")
CATALOGS, SETS = 7, 3


def tick(n: int) -> bytes:
    return encode.event(4, struct.pack("<I", 5), [encode.number_item(n)], 0x2, AT["tick %d"], delta=n)


def many_catalogs(damaged: int | None = None) -> bytes:
    """A file of several catalogs, each with chunksets of ticks in a range of their own; the body of one may be bad."""
    parts, n = [encode.header(BOOT)], 0
    for c in range(CATALOGS):
        sets, spans = [], []
        for k in range(SETS):
            body = encode.padded(encode.firehose(1, 2, 1000, [tick(n + i) for i in range(5)]))
            spans.append((1000 + n, 1000 + n + 4, len(body)))
            sets.append(encode.chunkset([body], packed=k % 2 == 0))
            if damaged == n:
                sets[-1] = sets[-1][:16] + sets[-1][16:24] + bytes(len(sets[-1]) - 24)
            n += 5
        parts += [encode.catalog([{"p1": 1, "p2": 2, "pid": 9 + c}], [MAIN], spans), *sets]
    return encode.trace_file(parts)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    clock = encode.timesync([(BOOT, 1, 1, 0, [(0, 10**18)])])
    files = {"Persist/1.tracev3": many_catalogs(), "Special/2.tracev3": many_catalogs(), "timesync/1.timesync": clock, f"AA/{'AA' * 15}": TEXT}
    return encode.write(str(tmp_path_factory.mktemp("scan")), files)


def shown(df) -> list[str]:
    return sorted(map(str, df.collect()))


def test_segments_cover_the_file():
    data = many_catalogs()
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    found = list(codec.segments(read, len(data)))
    assert [f[0] for f in found] == [0, *range(CATALOGS)] and found[0][1] == 0 and found[-1][2] == len(data)
    assert all(a[2] == b[1] for a, b in zip(found, found[1:], strict=False)) and set(asked) == {16}
    whole = list(codec.trace_file(data))
    assert [r for n, a, b in found for r in codec.trace_file(data[a:b], catalogs=n)] == whole
    for size in range(0, len(data), 97):  # cut-off files lose nothing more by being cut into ranges
        cut = data[:size]
        parts = list(codec.segments(lambda at, n: data[at : at + n], size))  # noqa: B023
        assert [r for n, a, b in parts for r in codec.trace_file(cut[a:b], catalogs=n)] == list(codec.trace_file(cut))


@pytest.mark.parametrize("most", [1, 900, 1 << 30])
def test_ranges_of_bytes_give_the_same_rows(spark, root, most):
    df = datasource.ranged(spark, root, splitBytes=most)
    parts = df.rdd.getNumPartitions()
    assert parts == {1: 2 * (CATALOGS + 1), 1 << 30: 2}.get(most, parts) and (most != 900 or 2 < parts < 2 * CATALOGS)
    assert shown(df) == shown(archive.records(spark, root))


def test_events_of_a_split_file_know_its_header(spark, root):
    dims = archive.timesync(spark, root), archive.uuidtext(spark, root), archive.dsc(spark, root)
    rows = assemble.event_table(datasource.ranged(spark, root, splitBytes=1), *dims)
    assert rows.count() == 2 * CATALOGS * SETS * 5
    assert [tuple(r) for r in rows.select("boot_uuid", "timezone_name").distinct().collect()] == [(BOOT, "Paris")]
    assert shown(rows) == shown(assemble.event_table(archive.records(spark, root), *dims))


def test_file_uris(spark, root):
    assert shown(datasource.ranged(spark, f"file://{root}")) == shown(datasource.ranged(spark, root))


def ticks(df) -> list[int]:
    return sorted(r[0] for r in df.where("kind = 'firehose'").select(F.explode("firehose.events.delta")).collect())


def test_chunksets_outside_a_range_are_not_unpacked(monkeypatch):
    unpacked = []
    own = codec.unpack_chunkset
    monkeypatch.setattr(codec, "unpack_chunkset", lambda data: unpacked.append(1) or own(data))
    for since, until, sets in [(None, None, 21), (1030, 1041, 3), (1104, None, 1), (None, 999, 0), (1105, None, 0), (1034, 1034, 1)]:
        unpacked.clear()
        got = [r for r in codec.trace_file(many_catalogs(), since=since, until=until) if r[0] == "firehose"]
        assert len(unpacked) == len(got) == sets
        assert [r[0] for r in codec.trace_file(many_catalogs(), since=since, until=until)].count("catalog") == CATALOGS


def test_damage_outside_a_range_is_never_met(spark, tmp_path):
    """In a strict read a bad chunkset fails the job, unless it is left out by its zone."""
    root = encode.write(str(tmp_path), {"Persist/1.tracev3": many_catalogs(damaged=45)})
    read = lambda **kw: datasource.ranged(spark, root, "FAILFAST", splitBytes=1, **kw)
    assert ticks(read(since=1060, until=1069)) == list(range(60, 70))
    own = read(since=1060, until=1069, kind="firehose", evidence=f"{root}/Persist/1.tracev3")
    assert ticks(own) == list(range(60, 70)) and own.where("kind <> 'firehose'").count() == 0
    assert ticks(archive.records(spark, root, "FAILFAST", until=1044)) == list(range(45))
    with pytest.raises(Exception, match="LZ4|cut off|left|unknown"):
        read().count()


def test_unknown_zones_are_read():
    body = encode.padded(encode.firehose(1, 2, 1000, [tick(1)]))
    data = encode.trace_file([encode.header(BOOT), encode.catalog([], [], [(5, 6, len(body) + 8)]), encode.chunkset([body]), encode.chunkset([body])])
    assert [r[3] for r in codec.trace_file(data, since=10**6) if r[0] == "firehose"] == [(None, None)] * 2
