"""Codec: literal records, round trips through the encoder, and cut-off input."""

import struct

import pytest

from tracelake.sources import codec, encode

BOOT, MAIN, SHARED = "C3" * 16, "AA" * 16, "DC" * 16


def one_event(data: bytes) -> dict:
    return codec.event(codec.Reader(data))


def test_padding():
    assert [codec.padding(n) for n in (0, 1, 8, 13)] == [0, 7, 0, 3]
    assert [codec.padding(n, 4) for n in (4, 5, 7)] == [0, 3, 1]


def test_texts():
    assert codec.text_to_zero(b"") == "Cannot extract string. Empty input."
    assert codec.text_to_zero(b"ab\0cd\0") == "ab"
    assert codec.text_to_zero(b"ab\0cd") == "ab\0cd"
    assert codec.text_to_zero(b"\xff\0") == "Could not extract string"
    assert codec.sized_text(b"abc\0\0", 5) == "abc"
    assert codec.sized_text(b"abc", 0) == "(null)"
    assert codec.sized_text(b"\xff", 1) == "Could not find path string"


def test_header_round_trip():
    h = codec.header(encode.header(BOOT, "/var/db/timezone/zoneinfo/America/New_York", 125, 3))
    assert (h["boot_uuid"], h["numerator"], h["denominator"], h["timezone"]) == (BOOT, 125, 3, "/var/db/timezone/zoneinfo/America/New_York")


def test_catalog_round_trip():
    c = codec.catalog(encode.catalog([{"p1": 5, "p2": 6, "pid": 7, "euid": 8, "main": 0, "dsc": 1, "images": [(10, 1, 0x123456)], "subsystems": [(3, "sub", "cat"), (4, "other", "")]}], [MAIN, SHARED]))
    (p,) = c["processes"]
    assert (p["pid"], p["euid"], p["main_uuid"], p["dsc_uuid"]) == (7, 8, MAIN, SHARED)
    assert p["images"] == [{"uuid": SHARED, "size": 10, "load_address": 0x123456}]
    assert p["subsystems"][0] == {"id": 3, "subsystem": "sub", "category": "cat"}


def test_unknown_uuid_places():
    c = codec.catalog(encode.catalog([{"p1": 1, "p2": 1, "main": 9, "dsc": 9}], [MAIN]))
    assert (c["processes"][0]["main_uuid"], c["processes"][0]["dsc_uuid"]) == ("", "")
    with pytest.raises(codec.Malformed):
        codec.catalog(encode.catalog([{"p1": 1, "p2": 1, "images": [(1, 5, 0)]}], [MAIN]))


@pytest.mark.parametrize("packed", [True, False])
def test_chunkset(packed):
    part = encode.simpledump(1, 2, 3, MAIN, SHARED, "s", "message " * 50)
    data = codec.unpack_chunkset(encode.chunkset([part], packed))
    assert [tag for tag, _ in codec.chunks(data, skip_zeros=True)] == [codec.SIMPLEDUMP]


def test_bad_chunkset():
    with pytest.raises(codec.Malformed):
        codec.unpack_chunkset(encode.chunk(0x600D, b"nope" + bytes(12)))


@pytest.mark.parametrize(
    ("flags", "extra", "want", "names"),
    [
        (0x2, b"", {"main_exe": True}, ["MainExe"]),
        (0x4, b"", {"shared_cache": True, "large_offset": 0}, ["SharedCache"]),
        (0x24, b"\x03\0", {"shared_cache": True, "large_offset": 3}, ["SharedCache", "HasLargeOffset"]),
        (0x8, b"\x08\0", {"absolute": True, "alt_index": 8}, ["Absolute", "AltIndex"]),
        (0xA, bytes.fromhex(MAIN), {"uuid_relative": MAIN}, ["UuidRelative"]),
        (0xC, b"\x02\0", {"large_shared_cache": 2}, ["LargeSharedCache"]),
        (0x2C, b"\x01\0\x02\0", {"large_offset": 1, "large_shared_cache": 2}, ["HasLargeOffset", "LargeSharedCache"]),
    ],
)
def test_locations(flags, extra, want, names):
    body, found = dict(codec.BODY), []
    codec.location(codec.Reader(extra), flags, body, found)
    assert {k: body[k] for k in want} == want
    assert found == names


def test_unknown_location():
    with pytest.raises(codec.Malformed):
        codec.location(codec.Reader(b""), 0x20, dict(codec.BODY), [])


def test_log_with_all_optional_fields():
    body = struct.pack("<II", 41, 0) + struct.pack("<HH", 0xFFF, 4) + struct.pack("<I", 9) + struct.pack("<H", 12) + struct.pack("<B", 14) + struct.pack("<I", 77)
    e = one_event(encode.event(4, body, [encode.number_item(-3)], 0x1 | 0x100 | 0x2 | 0x200 | 0x400 | 0x800, 5))
    assert (e["activity_id"], e["private_offset"], e["private_size"], e["subsystem_id"], e["ttl"], e["data_ref"]) == (41, 0xFFF, 4, 12, 14, 77)
    assert e["message_flags"] == ["HasCurrentAid", "HasPrivateData", "MainExe", "HasSubsystem", "HasRules", "HasOversize"]
    assert e["items"][0]["message_strings"] == "-3"


def test_activity_and_signpost():
    e = one_event(encode.event(2, struct.pack("<IIQIIIII", 1, 0, 236, 2, 0, 3, 0, 9), [], 0x10 | 0x1 | 0x200 | 0x4, 5))
    assert (e["activity_id"], e["activity_id_2"], e["activity_id_3"], e["unique_pid"]) == (1, 2, 3, 236)
    e = one_event(encode.event(2, struct.pack("<I", 9), [], 0x4, 5, log_type=3))
    assert e["activity_id"] == 0
    e = one_event(encode.event(6, struct.pack("<IIIHQIH", 1, 0, 9, 2, (1 << 64) - 1, 5, 0), [], 0x8000 | 0x1 | 0xC, 5))
    assert (e["signpost_id"], e["signpost_name"], e["large_shared_cache"]) == (-1, 5 + 0x80000000, 2)


def test_trace_values_are_read_backwards():
    values = [(140717286580400, 8), (200, 4)]
    body = struct.pack("<I", 3) + b"".join(v.to_bytes(n, "little") for v, n in values) + bytes(n for _, n in values) + bytes([2])
    e = one_event(encode.event(3, body, None, 0x2, 5))
    assert [i["message_strings"] for i in e["items"]] == ["140717286580400", "200"]
    assert one_event(encode.event(3, struct.pack("<I", 3), None, 0x2, 5))["items"] == []


def test_loss():
    e = one_event(encode.event(7, struct.pack("<QQQ", 707475528, 3144863719, 63), None, 0, 0))
    assert (e["loss_start"], e["loss_end"], e["loss_count"]) == (707475528, 3144863719, 63)


def test_items_of_every_kind():
    given = [encode.text_item(0x22, "public"), encode.text_item(0x42, ""), (struct.pack("<BBHH", 0x1, 4, 0, 0x8000), b""), (struct.pack("<BBHH", 0x45, 4, 0, 3), b""), (struct.pack("<BBHH", 0x32, 4, 0, 2), b"\x01\x02"), (struct.pack("<BB", 0x10, 4) + bytes(4), b""), encode.number_item(-1, 8, 2)]
    r = codec.Reader(b"".join(d for d, _ in given) + b"".join(t for _, t in given))
    found, trace = codec.items(r, len(given), 0)
    assert [i["message_strings"] for i in found] == ["public", "(null)", "", "<private>", "AQI=", "", "-1"]
    assert [i["item"] for i in found] == ["String", "String", "PrivateNumber", "PrivateString", "Object", "Precision", "Number"]
    assert trace == []


def test_backtrace():
    data = b"\x01\x00\x12" + struct.pack("<BH", 1, 2) + bytes.fromhex("0" * 31 + "A") + struct.pack("<II", 5, 6) + b"\x00\x07" + bytes(2)
    r = codec.Reader(data)
    assert codec.items(r, 0, 0x1000)[1] == ['"A" +0x5', '"0" +0x6']
    assert r.left == 0


@pytest.mark.parametrize("collapsed", [0, 1])
def test_private_values(collapsed):
    secret = b"secret\0"
    body = struct.pack("<HHI", 0x1000 - len(secret), len(secret), 5)
    e = encode.event(4, body, [(struct.pack("<BBHH", 0x21, 4, 0, len(secret)), b"")], 0x102, 1)
    found = codec.firehose(encode.firehose(1, 2, 3, [e, e], secret, collapsed))
    assert [x["items"][0]["message_strings"] for x in found["events"]] == ["secret", "secret"]


def test_remnant_stops_a_chunk():
    e = encode.event(4, struct.pack("<I", 5), [], 0x2, 1)
    found = codec.firehose(encode.firehose(1, 2, 3, [e, e, bytes(24)]))
    assert len(found["events"]) == 2


def test_dumps_and_oversize():
    s = codec.statedump(encode.statedump(1, 2, 3, 3, "title", b"data", "lib", "type"))
    assert (s["title"], s["library"], s["decoder"], s["data"]) == ("title", "lib", "type", b"data")
    assert codec.statedump(encode.statedump(1, 2, 3, 1, "title", b"", "lib", "type"))["library"] == ""
    d = codec.simpledump(encode.simpledump(1, 2, 3, MAIN, SHARED, "", "hello"))
    assert (d["subsystem"], d["message"], d["sender_uuid"]) == ("", "hello", MAIN)
    o = codec.oversize(encode.oversize(1, 2, 9, [encode.text_item(0x22, "long")]))
    assert (o["data_ref"], o["items"][0]["message_strings"]) == (9, "long")


def test_timesync():
    boots = codec.timesync(encode.timesync([(BOOT, 1, 1, 10, [(1, 2), (3, 4)]), (MAIN, 125, 3, 20, [])]))
    assert [(b["boot_uuid"], len(b["records"])) for b in boots] == [(BOOT, 2), (MAIN, 0)]
    with pytest.raises(codec.Malformed):
        codec.timesync(bytes(32))


@pytest.mark.parametrize("version", [1, 2])
def test_string_files(version):
    data, at = encode.uuidtext([(0x10, ["a", "bb"]), (0x50, ["c"])], "/bin/x")
    found = codec.uuidtext(data)
    assert found["entries"] == [{"start": 0x10, "size": 5}, {"start": 0x50, "size": 2}]
    assert at == {"a": 0x10, "bb": 0x12, "c": 0x50}
    data, at = encode.shared_strings(version, [(MAIN, "/lib/a"), (SHARED, "/lib/b")], [(0x100, 1, ["s %d"]), (0x900, 0, ["t"])])
    found = codec.shared_strings(data)
    assert [(r["low"], r["image"], r["data"]) for r in found["ranges"]] == [(0x100, 1, b"s %d\0"), (0x900, 0, b"t\0")]
    assert [i["path"] for i in found["images"]] == ["/lib/a", "/lib/b"]


@pytest.mark.parametrize("parse", [codec.uuidtext, codec.shared_strings])
def test_bad_signatures(parse):
    with pytest.raises(codec.Malformed):
        parse(bytes(64))


def test_every_cut_of_a_file_ends():
    files = encode.sample([(n, n % 3, 1.5, "click") for n in range(30)])
    whole = files["Persist/0000000000000001.tracev3"]
    full = len(list(codec.trace_file(whole)))
    for n in range(0, len(whole), 97):
        assert len(list(codec.trace_file(whole[:n]))) <= full
    with pytest.raises((codec.Malformed, struct.error)):
        list(codec.trace_file(whole[:-50], strict=True))
