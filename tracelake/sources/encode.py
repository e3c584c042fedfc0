"""Encoding of synthetic archives: the inverse of the codec, for tests and benches."""

from __future__ import annotations

import os
import struct

import pyarrow as pa

from tracelake.sources.codec import padding


def chunk(tag: int, body: bytes) -> bytes:
    return struct.pack("<IIQ", tag, 0, len(body)) + body


def padded(data: bytes, to: int = 8) -> bytes:
    return data + bytes(padding(len(data), to))


def fixed(text: str, n: int) -> bytes:
    return text.encode()[: n - 1].ljust(n, b"\0")


def header(boot_uuid: str, timezone: str = "/usr/share/zoneinfo/Europe/Paris", numerator: int = 1, denominator: int = 1) -> bytes:
    body = struct.pack("<IIQQ4I", numerator, denominator, 0, 0, 0, 0, 0, 0) + struct.pack("<IIQ", 0x6100, 8, 0) + struct.pack("<IIII", 0x6101, 56, 0, 0)
    body += fixed("21A559", 16) + fixed("Model1,1", 32) + struct.pack("<II", 0x6102, 24) + bytes.fromhex(boot_uuid) + struct.pack("<II", 1, 0) + struct.pack("<II", 0x6103, 48)
    return chunk(0x1000, body + fixed(timezone, 48))


def catalog(processes: list[dict], uuids: list[str], spans: list[tuple[int, int, int]] = ((0, 1 << 40, 65536),)) -> bytes:
    """processes: p1, p2, pid, euid, main and dsc (places in uuids), images [(size, place, address)], subsystems [(id, subsystem, category)].

    spans: (first tick, last tick, unpacked size) of the chunksets that follow.
    """
    strings, places = b"", {}

    def place(text: str) -> int:
        nonlocal strings
        if text not in places:
            places[text] = len(strings)
            strings += text.encode() + b"\0"
        return places[text]

    entries = b""
    for p in processes:
        e = struct.pack("<4HQI5I", 0, 0, p.get("main", 0), p.get("dsc", 0xFFFF), p["p1"], p["p2"], p.get("pid", 0), p.get("euid", 0), 0, len(p.get("images", [])), 0)
        for size, at, address in p.get("images", []):
            e += struct.pack("<IIH", size, 0, at) + address.to_bytes(6, "little")
        subsystems = p.get("subsystems", [])
        e += struct.pack("<II", len(subsystems), 0) + b"".join(struct.pack("<3H", n, place(s), place(c)) for n, s, c in subsystems)
        entries += e + bytes(padding(6 * len(subsystems)))
    at = 16 * len(uuids)
    body = struct.pack("<5H", at, at + len(strings), len(processes), 0, len(spans)) + bytes(6) + struct.pack("<Q", 0) + b"".join(bytes.fromhex(u) for u in uuids) + strings + entries
    return chunk(0x600B, body + b"".join(struct.pack("<QQIIII", start, end, size, 0x100, 0, 0) for start, end, size in spans))


def text_item(kind: int, text: str) -> tuple[bytes, bytes]:
    data = text.encode() + b"\0" if text else b""
    return struct.pack("<BBHH", kind, 4, 0, len(data)), data


def number_item(value: int, size: int = 4, kind: int = 0) -> tuple[bytes, bytes]:
    return struct.pack("<BB", kind, size) + value.to_bytes(size, "little", signed=True), b""


def event(kind: int, body: bytes, items: list[tuple[bytes, bytes]] | None, flags: int, location: int, log_type: int = 0, thread: int = 1, delta: int = 0, backtrace: bytes = b"") -> bytes:
    """An event; items None leaves the item list out (losses and traces)."""
    if items is not None:
        body += struct.pack("<BB", 0, len(items)) + b"".join(d for d, _ in items) + backtrace + b"".join(t for _, t in items)
    return padded(struct.pack("<BBHIQIHH", kind, log_type, flags, location, thread, delta & 0xFFFFFFFF, delta >> 32, len(body)) + body)


def firehose(p1: int, p2: int, base: int, events: list[bytes], private: bytes = b"", collapsed: int = 0) -> bytes:
    public = b"".join(events)
    virtual = 0x1000 - len(private)
    return chunk(0x6001, struct.pack("<QIBBHHHHHQ", p1, p2, 0, collapsed, 0, len(public) + 16, virtual, 0, 0, base) + public + private)


def oversize(p1: int, p2: int, ref: int, items: list[tuple[bytes, bytes]]) -> bytes:
    data = struct.pack("<BB", 0, len(items)) + b"".join(d for d, _ in items) + b"".join(t for _, t in items)
    return chunk(0x6002, struct.pack("<QIBHBQIHH", p1, p2, 0, 0, 0, 0, ref, len(data), 0) + data)


def statedump(p1: int, p2: int, time: int, kind: int, title: str, data: bytes, library: str = "", decoder: str = "") -> bytes:
    return chunk(0x6003, struct.pack("<QIBHBQQ", p1, p2, 0, 0, 0, time, 7) + bytes(16) + struct.pack("<II", kind, len(data)) + fixed(library, 64) + fixed(decoder, 64) + fixed(title, 64) + data)


def simpledump(p1: int, p2: int, time: int, sender: str, shared: str, subsystem: str, message: str) -> bytes:
    texts = [x.encode() + b"\0" if x else b"" for x in (subsystem, message)]
    return chunk(0x6004, struct.pack("<QQQQIHH", p1, p2, time, 9, 0, 0, 0) + bytes.fromhex(sender) + bytes.fromhex(shared) + struct.pack("<III", 1, *map(len, texts)) + b"".join(texts))


def chunkset(parts: list[bytes], packed: bool = True) -> bytes:
    data = b"".join(map(padded, parts))
    if not packed:
        return chunk(0x600D, b"bv4-" + struct.pack("<I", len(data)) + data + b"bv4$")
    block = pa.Codec("lz4_raw").compress(data, asbytes=True)
    return chunk(0x600D, b"bv41" + struct.pack("<II", len(data), len(block)) + block + b"bv4$")


def trace_file(parts: list[bytes]) -> bytes:
    return b"".join(map(padded, parts))


def timesync(boots: list[tuple[str, int, int, int, list[tuple[int, int]]]]) -> bytes:
    """boots: (uuid, numerator, denominator, boot time, [(kernel time, wall time)])."""
    out = b""
    for uuid, numerator, denominator, boot, records in boots:
        out += struct.pack("<HHI", 0xBBB0, 48, 0) + bytes.fromhex(uuid) + struct.pack("<IIqII", numerator, denominator, boot, 0, 0)
        out += b"".join(struct.pack("<IIQqII", 0x207354, 0, k, w, 0, 0) for k, w in records)
    return out


def uuidtext(ranges: list[tuple[int, list[str]]], image: str) -> tuple[bytes, dict[str, int]]:
    """The file and the offset of each string; ranges: (start, strings)."""
    heads, footer, at = b"", b"", {}
    for start, strings in ranges:
        block = b""
        for s in strings:
            at[s] = start + len(block)
            block += s.encode() + b"\0"
        heads += struct.pack("<II", start, len(block))
        footer += block
    return struct.pack("<4I", 0x66778899, 2, 1, len(ranges)) + heads + footer + image.encode() + b"\0", at


def shared_strings(version: int, images: list[tuple[str, str]], ranges: list[tuple[int, int, list[str]]]) -> tuple[bytes, dict[str, int]]:
    """images: (uuid, path); ranges: (low, place of the image, strings)."""
    blocks, at = [], {}
    for low, _, strings in ranges:
        block = b""
        for s in strings:
            at[s] = low + len(block)
            block += s.encode() + b"\0"
        blocks.append(block)
    place = 16 + len(ranges) * (24 if version == 2 else 16) + len(images) * (32 if version == 2 else 28)
    heads = b""
    for (low, image, _), block in zip(ranges, blocks, strict=True):
        heads += struct.pack("<QIIQ", low, place, len(block), image) if version == 2 else struct.pack("<4I", image, low, place, len(block))
        place += len(block)
    tails, paths = b"", b""
    for uuid, path in images:
        tails += struct.pack("<QI" if version == 2 else "<II", 0, 0) + bytes.fromhex(uuid) + struct.pack("<I", place + len(paths))
        paths += path.encode() + b"\0"
    return struct.pack("<IHHII", 0x64736368, version, 0, len(ranges), len(images)) + heads + tails + b"".join(blocks) + paths, at


def write(root: str, files: dict[str, bytes]) -> str:
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    return root


def sample(events: list[tuple[int, int, float, str]], boot_uuid: str = "B0" * 16, per_chunk: int = 40) -> dict[str, bytes]:
    """A small archive from (id, process, value, class) rows: all four string routes and all kinds of events."""
    main, shared, plugin, other = "AA" * 16, "DC" * 16, "BB" * 16, "CC" * 16
    text, at = uuidtext([(0x1000, ["user %d did %{public}s", "value %llu of %s", "hidden %s", "mode %{darwin.mode}d"])], "/usr/libexec/maind")
    extra, at_extra = uuidtext([(0x20, ["plugin says %s"])], "/usr/lib/plugin.dylib")
    late, at_late = uuidtext([(0x10, ["relative %d"])], "/usr/lib/other.dylib")
    cache, at_cache = shared_strings(2, [(plugin, "/System/Library/Shared")], [(0x500, 0, ["shared %s", "activity %{public}s"])])
    people = sorted({p for _, p, _, _ in events})
    processes = [{"p1": p + 1, "p2": 2, "pid": 100 + p, "euid": p % 3, "main": 0, "dsc": 1, "images": [(0x10000, 2, 0x7000)], "subsystems": [(1, "com.example.core", "events"), (2, "com.example.net", "")]} for p in people]
    files = [header(boot_uuid), catalog(processes, [main, shared, plugin, other])]
    by_person: dict[int, list] = {}
    for e in events:
        by_person.setdefault(e[1], []).append(e)
    parts = []
    for p, own in by_person.items():
        for i in range(0, len(own), per_chunk):
            out, big, secrets = [], [], {}
            for n, _, _, name in own[i : i + per_chunk]:
                if n % 9 == 2 and name not in secrets:
                    secrets[name] = sum(len(x) + 1 for x in secrets)
            private = b"".join(x.encode() + b"\0" for x in secrets)
            for n, _, value, name in own[i : i + per_chunk]:
                body = struct.pack("<II", n, 0x80000000)
                kind = n % 9
                if kind == 0:
                    out.append(event(4, body + struct.pack("<IH", 5, 1), [number_item(p), text_item(0x22, name)], 0x203, at["user %d did %{public}s"], 1, delta=n))
                elif kind == 1:
                    out.append(event(4, body + struct.pack("<IH", 5, 2), [number_item(int(value * 100), 8), text_item(0x22, name)], 0x203, at["value %llu of %s"], 2, delta=n))
                elif kind == 2:
                    size = len(name) + 1
                    out.append(event(4, body + struct.pack("<HHI", 0x1000 - len(private) + secrets[name], size, 5), [(struct.pack("<BBHH", 0x21, 4, 0, size), b"")], 0x103, at["hidden %s"], 16, delta=n))
                elif kind == 3:
                    out.append(event(4, body + struct.pack("<I", 5), [text_item(0x22, name)], 0x5, at_cache["shared %s"], 17, delta=n))
                elif kind == 4:
                    out.append(event(4, body + struct.pack("<IH", 0x7100, 0), [text_item(0x22, name)], 0x9, at_extra["plugin says %s"], 0, delta=n))
                elif kind == 5:
                    out.append(event(4, body + struct.pack("<I", 5) + bytes.fromhex(other), [number_item(n)], 0xB, at_late["relative %d"], 0, delta=n))
                elif kind == 6:
                    out.append(event(2, body + struct.pack("<I", 5), [text_item(0x22, name)], 0x4, at_cache["activity %{public}s"], 1, delta=n))
                elif kind == 7:
                    out.append(event(6, body + struct.pack("<IHQ", 5, 1, 77), [number_item(n), text_item(0x22, name)], 0x203, at["user %d did %{public}s"], 0x81, delta=n))
                else:
                    big.append(oversize(p + 1, 2, n, [text_item(0x22, name * 3)]))
                    out.append(event(4, body + struct.pack("<II", 5, n), [], 0x803, at["hidden %s"], 0, delta=n))
            parts += [firehose(p + 1, 2, 1000, out, private), *big]
    parts += [simpledump(11, 12, 5000, other, shared, "com.example.dump", "simple text"), statedump(11, 12, 6000, 3, "CLClientManagerStateTracker", struct.pack("<II", 1, 0), "location", "_state")]
    files += [chunkset(parts[i : i + 64], packed=i % 128 == 0) for i in range(0, len(parts), 64)]
    return {
        "Persist/0000000000000001.tracev3": trace_file(files), "timesync/0000000000000001.timesync": timesync([(boot_uuid, 1, 1, 1_700_000_000_000_000_000, [(0, 1_700_000_000_000_000_500), (3000, 1_700_000_000_000_004_000)])]),
        f"{main[:2]}/{main[2:]}": text, f"{plugin[:2]}/{plugin[2:]}": extra, f"{other[:2]}/{other[2:]}": late, f"dsc/{shared}": cache,
    }
