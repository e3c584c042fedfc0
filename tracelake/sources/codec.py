"""Decoding of archive bytes: plain Python over memoryviews, no Spark.

Numbers are little endian unless said otherwise; 128-bit ids are big endian and
shown as 32 upper-case hex digits. A record that ends too early raises
Malformed, and callers decide whether to skip the record or the file.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa

HEADER, CATALOG, CHUNKSET = 0x1000, 0x600B, 0x600D
FIREHOSE, OVERSIZE, STATEDUMP, SIMPLEDUMP = 0x6001, 0x6002, 0x6003, 0x6004
PACKED, STORED, FOOTER = b"bv41", b"bv4-", b"bv4$"
NO_PRIVATE = 0x1000
EVENTS = {2, 3, 4, 6, 7}
PLAIN_TEXT = {0x20, 0x22, 0x40, 0x42, 0x30, 0x31, 0x32, 0xF2}
PRIVATE_TEXT = {0x21, 0x25, 0x35, 0x31, 0x41, 0x81, 0xF1}
SENSITIVE, PRECISION, NUMBERS, OBJECTS, RAW = {0x5, 0x45, 0x85}, {0x10, 0x12}, {0x0, 0x2}, {0x40, 0x42}, {0x30, 0x31, 0x32}


class Malformed(ValueError):
    """Bytes that do not follow the layout."""


class Reader:
    """A position in some bytes."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.data, self.at = memoryview(data), at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left:
            raise Malformed(f"{n} bytes wanted, {self.left} left")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def read(self, layout: str) -> tuple:
        return struct.unpack("<" + layout, self.take(struct.calcsize("<" + layout)))

    def one(self, layout: str) -> int:
        return self.read(layout)[0]

    def uuid(self) -> str:
        return self.take(16).hex().upper()

    def rest(self) -> bytes:
        return bytes(self.data[self.at :])

    def skip_zeros(self) -> int:
        n, data = self.at, self.data
        while n < len(data) and data[n] == 0:
            n += 1
        skipped, self.at = n - self.at, n
        return skipped


def padding(n: int, to: int = 8) -> int:
    return -n % to


def text_to_zero(data: bytes) -> str:
    """All of data if its last byte is not zero, else what stands before the first zero."""
    if not data:
        return "Cannot extract string. Empty input."
    try:
        return (data if data[-1] else data[: data.index(0)]).decode()
    except UnicodeDecodeError:
        return "Could not extract string"


def sized_text(data: bytes, size: int) -> str:
    """The first size bytes without zeros at their end."""
    if not size:
        return "(null)"
    try:
        return data[:size].decode().rstrip("\0")
    except UnicodeDecodeError:
        return "Could not find path string"


def signed(value: int) -> int:
    """An unsigned 64-bit number's bits as a signed one, as Spark's long holds them."""
    return value - (1 << 64) if value >> 63 else value


def header(data: bytes) -> dict:
    r = Reader(data, 16)
    numerator, denominator, *_ = r.read("IIQQ4I" + "IIQ" + "IIII")
    build, model = (sized_text(r.take(n), n) for n in (16, 32))
    r.read("II")
    boot = r.uuid()
    pid, _, _, _ = r.read("4I")
    return {"numerator": numerator, "denominator": denominator, "build": build, "model": model, "boot_uuid": boot, "logd_pid": pid, "timezone": sized_text(r.take(48), 48)}


def catalog(data: bytes) -> dict:
    """Processes (with their image ranges and subsystems) and time spans of the chunksets that follow."""
    r = Reader(data, 16)
    strings_at, processes_at, n_processes, _, n_spans = r.read("5H")
    r.take(6)
    earliest = r.one("Q")
    uuids = [r.uuid() for _ in range(strings_at // 16)]
    strings = r.take(processes_at - strings_at)
    # The last of two processes with the same ids counts.
    processes = {(p["p1"], p["p2"]): p for p in [process(r, uuids, strings) for _ in range(n_processes)]}
    return {"earliest": signed(earliest), "processes": list(processes.values()), "spans": [span(r) for _ in range(n_spans)]}


def process(r: Reader, uuids: list[str], strings: bytes) -> dict:
    _, _, main, shared = r.read("4H")
    p1, p2 = r.read("QI")
    pid, euid, _, n_images, _ = r.read("5I")
    images = []
    for _ in range(n_images):
        size, _, at = r.read("IIH")
        if at >= len(uuids):
            raise Malformed("image of an unknown id")
        images.append({"uuid": uuids[at], "size": size, "load_address": int.from_bytes(r.take(6), "little")})
    n, _ = r.read("II")
    subsystems = []
    for _ in range(n):
        number, subsystem, category = r.read("3H")
        subsystems.append({"id": number, "subsystem": text_to_zero(strings[subsystem:]), "category": text_to_zero(strings[category:])})
    r.take(padding(6 * n))
    name = lambda i: uuids[i] if i < len(uuids) else ""
    return {"p1": signed(p1), "p2": p2, "pid": pid, "euid": euid, "main_uuid": name(main), "dsc_uuid": name(shared), "images": images, "subsystems": subsystems}


def span(r: Reader) -> dict:
    start, end, size, kind, n = r.read("QQIII")
    if kind != 0x100:
        raise Malformed("unknown compression")
    r.take(2 * n)
    n_offsets = r.one("I")
    r.take(2 * n_offsets + padding(2 * (n + n_offsets)))
    return {"start": signed(start), "end": signed(end), "size": size}


def unpack_chunkset(data: bytes) -> bytes:
    r = Reader(data, 16)
    signature, size = r.take(4), r.one("I")
    if signature == STORED:
        return r.take(size)
    if signature != PACKED:
        raise Malformed("unknown chunkset signature")
    try:
        return pa.Codec("lz4_raw").decompress(r.take(r.one("I")), decompressed_size=size, asbytes=True)
    except (OSError, pa.ArrowException) as e:
        raise Malformed("LZ4 block can't be read") from e


def chunks(data: bytes, skip_zeros: bool = False) -> Iterator[tuple[int, bytes]]:
    """(tag, chunk with its 16-byte preamble); padding to eight bytes or, in chunksets, all zeros between."""
    r = Reader(data)
    while r.left >= 16:
        if skip_zeros:
            r.skip_zeros()
            if r.left < 16:
                return
        tag, _, size = struct.unpack_from("<IIQ", r.data, r.at)
        if size + 16 > r.left:
            raise Malformed("chunk is cut off")
        yield tag, r.take(size + 16)
        if not skip_zeros:
            r.at = min(len(r.data), r.at + padding(size))


def item(kind: int = 0, width: int = 0) -> dict:
    return {"item_type": kind, "item_type_size": width, "offset": 0, "item_size": 0, "message_strings": "", "item": "Unknown"}


def number(r: Reader, size: int) -> int:
    layout = {1: "b", 2: "h", 4: "i", 8: "q"}.get(size)
    return r.one(layout) if layout else -9999


def described(r: Reader) -> dict:
    """The descriptor of one item; numbers stand in it, texts come later."""
    it = item(*r.read("BB"))
    kind = it["item_type"]
    if kind in PLAIN_TEXT | PRIVATE_TEXT | SENSITIVE or kind == 1:
        it["offset"], it["item_size"] = r.read("HH")
        it["item"] = "PrivateNumber" if kind == 1 else "Sensitive" if kind in SENSITIVE else "String"
    elif kind in PRECISION:
        r.take(it["item_type_size"])
        it["item"] = "Precision"
    elif kind in NUMBERS:
        it["message_strings"], it["item"] = str(number(r, it["item_type_size"])), "Number"
    if kind in OBJECTS and not it["item_size"]:
        it["message_strings"] = "(null)"
    return it


def backtrace(r: Reader) -> list[str]:
    r.take(3)
    n_images, n_frames = r.read("BH")
    images = [int.from_bytes(r.take(16), "big") for _ in range(n_images)]
    offsets, at = r.read(f"{n_frames}I"), r.take(n_frames)
    r.take(padding(n_frames, 4))
    return [f'"{images[i] if i < n_images else 0:X}" +0x{offset}' for i, offset in zip(at, offsets, strict=True)]


def items(r: Reader, n: int, flags: int) -> tuple[list[dict], list[str]]:
    """n items and the backtrace, if there is one; r then stands at the private texts, if any."""
    found, trace = [described(r) for _ in range(n)], []
    if flags & 0x1000 or (r.left > 3 and bytes(r.data[r.at : r.at + 3]) == b"\x01\x00\x12"):
        trace = backtrace(r)
    for it in found:
        kind, size = it["item_type"], it["item_size"]
        if kind in NUMBERS | PRECISION or kind == 1:
            continue
        if kind in PRIVATE_TEXT | SENSITIVE:
            it["item"], it["message_strings"] = "PrivateString", "<private>"
            continue
        if not size and it["message_strings"]:
            continue
        if not r.left:
            break
        if kind in PLAIN_TEXT:
            if size > r.left:
                it["message_strings"] = sized_text(r.take(r.left), size)
                continue
            data = r.take(size)
            if kind in RAW:
                it["item"] = "Object"
            it["message_strings"] = base64.b64encode(data).decode() if kind in RAW or kind == 0xF2 else sized_text(data, size)
    return found, trace


def fill_private(r: Reader, found: list[dict]) -> None:
    """Gives private items their texts and numbers."""
    for it in found:
        kind, size = it["item_type"], it["item_size"]
        if kind in (0x35, 0x31):
            it["message_strings"] = base64.b64encode(r.take(min(size, r.left))).decode()
        elif kind in PRIVATE_TEXT:
            it["message_strings"] = sized_text(r.take(min(size, r.left)), size) if size else "<private>"
        elif kind == 1:
            it["message_strings"] = "<private>" if size == 0x8000 else str(number(r, size))


BODY = {
    "activity_id": 0, "activity_id_2": 0, "activity_id_3": 0, "unique_pid": 0, "private_offset": 0, "private_size": 0, "pc_id": 0, "subsystem_id": 0, "ttl": 0,
    "data_ref": 0, "signpost_id": 0, "signpost_name": 0, "loss_start": 0, "loss_end": 0, "loss_count": 0, "main_exe": False, "shared_cache": False, "absolute": False,
    "uuid_relative": "", "alt_index": 0, "large_offset": 0, "large_shared_cache": 0,
}


def location(r: Reader, flags: int, body: dict, names: list[str]) -> None:
    """Where the format string is, by flag bits 1 to 3, of which some bring a field."""

    def large() -> None:
        if flags & 0x20:
            body["large_offset"] = r.one("H")
            names.append("HasLargeOffset")

    where = flags & 0xE
    if where == 0x2:
        body["main_exe"] = True
        names.append("MainExe")
    elif where == 0x4:
        body["shared_cache"] = True
        names.append("SharedCache")
        large()
    elif where == 0x8:
        body["absolute"], body["alt_index"] = True, r.one("H")
        names.extend(["Absolute", "AltIndex"])
    elif where == 0xA:
        body["uuid_relative"] = r.uuid()
        names.append("UuidRelative")
    elif where == 0xC:
        large()
        body["large_shared_cache"] = r.one("H")
        names.append("LargeSharedCache")
    else:
        raise Malformed(f"unknown location of a format string: {flags}")


def optional(r: Reader, flags: int, names: list[str], body: dict, bit: int, name: str, layout: str, *fields: str | None) -> None:
    if flags & bit:
        for field, value in zip(fields, r.read(layout), strict=True):
            if field:
                body[field] = signed(value)
        names.append(name)


def activity_body(r: Reader, flags: int, log_type: int) -> tuple[dict, list[str]]:
    body, names = dict(BODY), []
    if log_type != 3:
        body["activity_id"], _ = r.read("II")
    optional(r, flags, names, body, 0x10, "HasUniquePid", "Q", "unique_pid")
    optional(r, flags, names, body, 0x1, "HasCurrentAid", "II", "activity_id_2", None)
    optional(r, flags, names, body, 0x200, "HasOtherAid", "II", "activity_id_3", None)
    body["pc_id"] = r.one("I")
    location(r, flags, body, names)
    return body, names


def log_body(r: Reader, flags: int, signpost: bool = False) -> tuple[dict, list[str]]:
    body, names = dict(BODY), []
    optional(r, flags, names, body, 0x1, "HasCurrentAid", "II", "activity_id", None)
    optional(r, flags, names, body, 0x100, "HasPrivateData", "HH", "private_offset", "private_size")
    body["pc_id"] = r.one("I")
    location(r, flags, body, names)
    optional(r, flags, names, body, 0x200, "HasSubsystem", "H", "subsystem_id")
    if signpost:
        body["signpost_id"] = signed(r.one("Q"))
    optional(r, flags, names, body, 0x400, "HasRules", "B", "ttl")
    optional(r, flags, names, body, 0x800, "HasOversize", "I", "data_ref")
    if signpost and flags & 0x8000:
        body["signpost_name"] = r.one("I")
        if (body["shared_cache"] and body["large_offset"]) or body["large_shared_cache"]:
            r.take(2)
            body["signpost_name"] += 0x80000000
    return body, names


def trace_items(data: bytes) -> list[dict]:
    """Values of a trace: the bytes backwards are a count, sizes and big-endian values, last value first."""
    r, out = Reader(data[::-1]), []
    if r.left < 4:
        return []
    try:
        for size in r.take(r.take(1)[0]):
            value = r.take(size)
            if not size:
                raise Malformed("empty value")
            out.append(item() | {"message_strings": str(int.from_bytes(value, "big") if size in (1, 2, 4, 8) else value[0])})
    except Malformed:
        return []
    return out[::-1]


def event(r: Reader) -> dict:
    kind, log_type, flags, where, thread, low, high, size = r.read("BBHIQIHH")
    out = {"activity_type": kind, "log_type": log_type, "flags": flags, "format_location": where, "thread_id": signed(thread), "delta": low | high << 32, "items": [], "backtrace": [], "message_flags": []} | BODY
    body = Reader(r.take(size))
    if kind == 2:
        fields, out["message_flags"] = activity_body(body, flags, log_type)
        out |= fields
    elif kind in (4, 6):
        fields, out["message_flags"] = log_body(body, flags, kind == 6)
        out |= fields
    elif kind == 7:
        out["loss_start"], out["loss_end"], out["loss_count"] = map(signed, body.read("QQQ"))
    elif kind == 3:
        out["pc_id"] = body.one("I")
        out["items"] = trace_items(body.rest()) if body.left >= 4 else []
        body.at = len(body.data)
    else:
        return out
    if body.left < 6:
        r.skip_zeros()
        return out
    _, n = body.read("BB")
    out["items"], out["backtrace"] = items(body, n, flags)
    begin = r.at
    zeros, pad = r.skip_zeros(), padding(size)
    if pad <= zeros:
        r.at = begin + pad
    elif begin + pad > len(r.data):
        raise Malformed("padding is cut off")
    return out


def firehose(data: bytes) -> dict:
    """A chunk of events of one process, with private values filled in."""
    r = Reader(data, 16)
    p1, p2, ttl, collapsed, _, public, virtual, _, _, base = r.read("QIBBHHHHHQ")
    body = r.rest()
    if public < 16:
        raise Malformed("public size is too small")
    events, area, after = [], Reader(r.take(public - 16)), r.rest()
    while area.left:
        e = event(area)
        if e["activity_type"] in EVENTS and area.left >= 24:
            events.append(e)
            continue
        if not e["activity_type"]:
            break
        if virtual != NO_PRIVATE:
            size = NO_PRIVATE - virtual
            if size < 0:
                raise Malformed("private data lie outside the chunk")
            if len(after) > size and not area.left:
                after = after[len(after) - size :]
            else:
                begin = (virtual if len(body) == public - 16 else public) - 16 - area.left
                if begin < 0 or begin > len(body):
                    raise Malformed("private data lie outside the chunk")
                after = body[begin:]
        events.append(e)
        break
    if virtual != NO_PRIVATE:
        private = after.lstrip(b"\0")
        private = after if not private or collapsed == 1 else private
        for e in events:
            if e["activity_type"] == 4 and e["private_size"]:
                begin = e["private_offset"] - virtual
                if begin < 0 or begin > len(private):
                    raise Malformed("private data lie outside the chunk")
                try:
                    fill_private(Reader(private, begin), e["items"])
                except Malformed:
                    pass  # the items before stay filled
    return {"p1": signed(p1), "p2": p2, "base_time": signed(base), "ttl": ttl, "events": events}


def oversize(data: bytes) -> dict:
    r = Reader(data, 16)
    p1, p2, _, _, _, time, ref, public, private = r.read("QIBHBQIHH")
    area = Reader(r.take(min(public + private, r.left)))
    _, n = area.read("BB")
    found, _ = items(area, n, 0)
    fill_private(area, found)
    return {"p1": signed(p1), "p2": p2, "time": signed(time), "data_ref": ref, "items": found}


def statedump(data: bytes) -> dict:
    r = Reader(data, 16)
    p1, p2, _, _, _, time, activity = r.read("QIBHBQQ")
    uuid = r.uuid()
    kind, size = r.read("II")
    library, decoder, title = r.take(64), r.take(64), r.take(64)
    own = kind == 3
    return {
        "p1": signed(p1), "p2": p2, "time": signed(time), "activity_id": signed(activity), "uuid": uuid, "data_type": kind, "library": text_to_zero(library) if own else "",
        "decoder": text_to_zero(decoder) if own else "", "title": text_to_zero(title), "data": r.take(size),
    }


def simpledump(data: bytes) -> dict:
    r = Reader(data, 16)
    p1, p2, time, thread, _, _, _ = r.read("QQQQIHH")
    sender, shared = r.uuid(), r.uuid()
    _, n_subsystem, n_message = r.read("III")
    texts = [r.take(n) for n in (n_subsystem, n_message)]
    subsystem, message = (text_to_zero(t) if t else "" for t in texts)
    return {"p1": signed(p1), "p2": signed(p2), "time": signed(time), "thread_id": signed(thread), "sender_uuid": sender, "dsc_uuid": shared, "subsystem": subsystem, "message": message}


INNER = {FIREHOSE: ("firehose", firehose), OVERSIZE: ("oversize", oversize), STATEDUMP: ("statedump", statedump), SIMPLEDUMP: ("simpledump", simpledump)}


def segments(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int, int]]:
    """(catalogs before, from, to) of the parts of a trace file, each of which begins with a catalog, but for the first.

    read gives so many bytes from a place on; only the 16 bytes before each chunk
    are asked for. Where chunks can't be followed any more the last part goes on to
    the end of the file.
    """
    begin = at = catalogs = 0
    while at + 16 <= size:
        tag, _, length = struct.unpack("<IIQ", read(at, 16))
        if at + 16 + length > size:
            break
        if tag == CATALOG:
            if at > begin:
                yield max(0, catalogs - 1), begin, at
            begin, catalogs = at, catalogs + 1
        at += 16 + length + padding(length)
    yield max(0, catalogs - 1), begin, size


def zone_of(chunk: bytes, spans: list[dict], place: int) -> tuple[int | None, int | None]:
    """First and last tick of a chunkset by its catalog; unknown where the catalog has another size for it."""
    if place < len(spans) and len(chunk) >= 24 and struct.unpack_from("<I", chunk, 20)[0] == spans[place]["size"]:
        return spans[place]["start"], spans[place]["end"]
    return None, None


def outside(zone: tuple[int | None, int | None], since: int | None, until: int | None) -> bool:
    """Whether a known zone has nothing in common with a range of ticks, both ends included."""
    start, end = zone
    return start is not None and ((since is not None and end < since) or (until is not None and start > until))


Record = tuple[str, int, int, tuple[int | None, int | None], dict]


def trace_file(data: bytes, strict: bool = False, catalogs: int = 0, since: int | None = None, until: int | None = None) -> Iterator[Record]:
    """(kind, catalog number, chunk number, zone, record) of a trace file or a part of one, before which there are so many catalogs.

    Catalogs are counted from one, chunks within their catalog. Chunksets that lie
    outside since and until by their catalog are not unpacked. A bad record is left
    out unless strict; a file that is cut off ends there.
    """
    of_catalog, place, sets, spans, unknown = catalogs, 0, 0, [], (None, None)
    try:
        for tag, chunk in chunks(data):
            place += 1
            try:
                if tag == HEADER:
                    yield "header", of_catalog, place, unknown, header(chunk)
                elif tag == CATALOG:
                    of_catalog, place, sets, spans = of_catalog + 1, 0, 0, []
                    found = catalog(chunk)
                    spans = found["spans"]
                    yield "catalog", of_catalog, place, unknown, found
                elif tag == CHUNKSET:
                    zone = zone_of(chunk, spans, sets)
                    sets += 1
                    if outside(zone, since, until):
                        continue
                    for inner, part in chunks(unpack_chunkset(chunk), skip_zeros=True):
                        place += 1
                        if inner in INNER:
                            kind, parse = INNER[inner]
                            try:
                                record = parse(part)
                            except (Malformed, struct.error):
                                if strict:
                                    raise
                                continue
                            yield kind, of_catalog, place, zone, record
            except (Malformed, struct.error):
                if strict:
                    raise
    except Malformed:
        if strict:
            raise


def timesync(data: bytes) -> list[dict]:
    """Boots with their clock records, in order."""
    r, boots = Reader(data), []
    while r.left:
        if r.left >= 2 and struct.unpack_from("<H", r.data, r.at)[0] == 0xBBB0:
            r.read("HHI")
            uuid = r.uuid()
            numerator, denominator, boot, zone, saving = r.read("IIqII")
            boots.append({"boot_uuid": uuid, "numerator": numerator, "denominator": denominator, "boot_time": boot, "zone": zone, "saving": saving, "records": []})
            continue
        signature, flags, kernel, wall, zone, saving = r.read("IIQqII")
        if signature != 0x207354:
            raise Malformed("unknown clock record")
        if not boots:
            raise Malformed("clock record before any boot")
        boots[-1]["records"].append({"kernel_time": signed(kernel), "walltime": wall, "flags": flags})
    return boots


def uuidtext(data: bytes) -> dict:
    r = Reader(data)
    signature, major, minor, n = r.read("4I")
    if signature != 0x66778899:
        raise Malformed("unknown string file")
    entries = [dict(zip(("start", "size"), r.read("II"), strict=True)) for _ in range(n)]
    return {"entries": entries, "footer": r.rest()}


def shared_strings(data: bytes) -> dict:
    r = Reader(data)
    signature, major, _, n_ranges, n_images = r.read("IHHII")
    if signature != 0x64736368:
        raise Malformed("unknown shared string file")
    ranges = []
    for _ in range(n_ranges):
        if major == 2:
            low, at, size, image = r.read("QIIQ")
        else:
            image, low, at, size = r.read("4I")
        ranges.append({"low": signed(low), "size": size, "image": signed(image), "data_at": at, "data": Reader(data, min(at, len(data))).take(size)})
    images = []
    for _ in range(n_images):
        r.read("QI" if major == 2 else "II")
        uuid, at = r.uuid(), r.one("I")
        if at > len(data):
            raise Malformed("path lies outside the file")
        images.append({"uuid": uuid, "path": text_to_zero(bytes(memoryview(data)[at:]))})
    return {"ranges": ranges, "images": images}
