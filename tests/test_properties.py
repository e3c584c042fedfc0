"""Round trips of random structures through encoder and codec, and random formats against a plain model."""

import struct

from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.operators.printf import Item, render
from tracelake.sources import codec, encode

UUID = st.binary(min_size=16, max_size=16).map(lambda b: b.hex().upper())
WORD = st.text(st.characters(exclude_characters="\0", exclude_categories=["Cs"]), min_size=1, max_size=20)
TEXT = st.text(st.characters(exclude_characters="\0%", exclude_categories=["Cs"]), max_size=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0x22, 0x42, 0x20]), WORD), max_size=6), st.lists(st.integers(-(2**31), 2**31 - 1), max_size=4), st.integers(0, 2**48 - 1))
def test_events(texts, numbers, delta):
    items = [encode.text_item(k, t) for k, t in texts] + [encode.number_item(n) for n in numbers]
    e = codec.event(codec.Reader(encode.event(4, struct.pack("<I", 1), items, 0x2, 7, delta=delta)))
    assert e["delta"] == delta
    got = [i["message_strings"] for i in e["items"]]
    assert got == [t for _, t in texts] + [str(n) for n in numbers]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(UUID, st.integers(0, 2**40), st.lists(st.tuples(st.integers(0, 2**62), st.integers(0, 2**62)), max_size=5)), max_size=4))
def test_clocks(boots):
    got = codec.timesync(encode.timesync([(u, 1, 1, t, r) for u, t, r in boots]))
    assert [(b["boot_uuid"], b["boot_time"], [(r["kernel_time"], r["walltime"]) for r in b["records"]]) for b in got] == [(u, t, r) for u, t, r in boots]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(WORD, min_size=1, max_size=4), min_size=1, max_size=3), WORD)
def test_string_files(ranges, image):
    starts = [1000 * i for i in range(len(ranges))]
    data, at = encode.uuidtext(list(zip(starts, ranges, strict=True)), image)
    found = codec.uuidtext(data)
    base = 0
    for start, entry, strings in zip(starts, found["entries"], ranges, strict=True):
        assert entry["start"] == start
        assert found["footer"][base : base + entry["size"]] == b"".join(s.encode() + b"\0" for s in strings)
        base += entry["size"]
    assert codec.text_to_zero(found["footer"][base:]) == image
    assert set(at) == {s for r in ranges for s in r}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, st.sampled_from(["%d", "%s", "%{public}s", "%lld", "%%"]), st.integers(-(2**40), 2**40), TEXT), max_size=6), TEXT)
def test_plain_formats(parts, tail):
    raw = "".join(a + spec for a, spec, _, _ in parts) + tail
    items, want = [], ""
    for before, spec, number, text in parts:
        if spec == "%%":
            want += before + "%"
        elif spec.endswith("d"):
            items.append(Item(2, 8, str(number)))
            want += f"{before}{number}"
        else:
            items.append(Item(0x22, len(text) + 1, text))
            want += before + text
    # A percent sign may join with what follows it.
    if "%%" not in raw:
        assert render(raw, items) == (want + tail if raw else (items[0].text if items else ""))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_junk_never_crashes(data):
    for kind in (encode.chunk(t, data) for t in (0x6001, 0x6002, 0x6003, 0x6004)):
        list(codec.trace_file(encode.chunkset([kind]) + data))
