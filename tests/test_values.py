"""Value decoders and printf: the rules one by one, on values of our own."""

import base64
import ipaddress
import json
import plistlib
import struct

import pytest

from tracelake.operators import objects
from tracelake.operators.printf import Item, plain, render


def b64(*parts: bytes) -> str:
    return base64.b64encode(b"".join(parts)).decode()


def ip(text: str) -> bytes:
    return ipaddress.ip_address(text).packed


def hint(kind: int, value: bytes) -> bytes:
    return struct.pack(">HH", kind, len(value)) + value


def bits(value: float) -> int:
    """A double as the signed number that its bits make."""
    return struct.unpack("<q", struct.pack("<d", value))[0]


@pytest.mark.parametrize(
    ("token", "value", "want"),
    [
        ("BOOL", "0", "NO"), ("BOOL", "1", "YES"), ("bool", "1", "true"), ("bool", "0", "false"),
        ("uuid_t", b64(bytes(range(16))), "000102030405060708090A0B0C0D0E0F"),
        ("darwin.errno", "13", "Permission denied"), ("darwin.errno", "4000", "Unknown errno: 4000"), ("%{errno", "1", "Operation not permitted"),
        ("mach.errno", "268435465", "invalid reply"), ("darwin.mode", "111", "---x--x--x"), ("darwin.mode", "448", "-r--r-----"), ("darwin.mode", "777", "-rwxrwxrwx"), ("darwin.mode", "400", "-r--------"),
        ("odtypes:ODError", "1101", "ODErrorSessionProxyVersionMismatch"), ("odtypes:ODError", "77", "77"), ("odtypes:mbridtype", "12", "KERBEROS"),
        ("odtypes:mbr_details", b64(b"#", struct.pack("<i", 88), b"/Own/Node\0"), "user: 88@/Own/Node"),
        ("odtypes:mbr_details", b64(b"D", b"staff.example\0", b"/Own/Node\0"), "group: staff.example@/Own/Node"),
        ("odtypes:nt_sid_t", b64(bytes([1, 5, 0, 0, 0, 0, 0, 5]), struct.pack("<5I", 21, 7, 80, 900, 1001)), "S-1-5-21-7-80-900-1001"),
        ("location:CLClientAuthorizationStatus", "4", "Authorized When In Use"), ("location:CLClientAuthorizationStatus", "9", "Unknown Core Location client authorization status"),
        ("location:CLDaemonStatus_Type::Reachability", "56", "Reachability Unachievable"), ("location:CLSubHarvesterIdentifier", "2", '"Wifi"'),
        ("location:SqliteResult", b64(bytes(4)), "SQLITE OK"), ("location:_CLClientManagerStateTrackerState", b64(struct.pack("<II", 3, 1)), '{"locationRestricted":true, "locationServicesenabledStatus":3}'),
        ("network:in6_addr", b64(ip("2001:db8::17")), "2001:db8::17"), ("network:in_addr", b64(ip("10.1.2.3")), "10.1.2.3"), ("network:in_addr", "!", "Failed to base64 decode ipv4 data"), ("network:in_addr", "AA==", "Failed to get ipv4"),
        ("network:sockaddr", b64(bytes([16, 2, 0, 0]), ip("10.9.8.7"), bytes(8)), "10.9.8.7"), ("network:sockaddr", b64(bytes([28, 30, 0, 0]), bytes(4), ip("2001:db8::5"), bytes(4)), "2001:db8::5, Flow ID: 0, Scope ID: 0"), ("network:sockaddr", "", "<NULL>"),
        ("time_t", "90061", "1970-01-02T01:01:01.000Z"), ("time_t", "x", "Failed to parse timestamp"),
        ("mdns:rd.svcb", b64(b"\0\1\0", hint(1, b"\2h3"), hint(4, ip("10.0.0.1") + ip("10.0.0.2")), hint(6, ip("2001:db8::5") + ip("2001:db8::6"))), "rdata: 1 . alpn=h3, ipv4 hint:10.0.0.1,10.0.0.2, ipv6 hint:2001:db8::5,2001:db8::6"),
        ("location:IOMessage", "3758096981", "SystemPagingOff"), ("mdnsresponder:domain_name", b64(b"\3www\7example\3org\0"), ".www.example.org"),
        ("mdnsresponder:mac_addr", b64(bytes([2, 0, 0, 17, 52, 9])), "02:00:00:11:34:09"), ("mdnsresponder:ip_addr", b64(bytes([4, 0, 0, 0]), ip("10.20.30.40"), bytes(12)), "10.20.30.40"),
        ("mdns:addrmv", "1", "add"), ("mdns:rrtype", "65", "HTTPS"), ("mdns:nreason", "2", "nxdomain"), ("mdns:protocol", "4", "HTTPS"), ("mdns:yesno", "0", "no"), ("mdns:acceptable", "1", "acceptable"),
        ("mdns:gaiopts", "8", "0x8 {use-failover}"), ("mdns:dns.counts", str(3 << 48), "Question Count: 3, Answer Record Count: 0, Authority Record Count: 0, Additional Record Count: 0"),
        ("nothing", "x", ""),
    ],
)
def test_decoders(token, value, want):
    assert objects.decoded(token, value) == want


def test_dns_header():
    text = objects.decoded("mdns:dnshdr", b64(struct.pack(">6H", 0x1234, 0x100, 2, 0, 0, 0)))
    assert text.startswith("Query ID: 0x1234, Flags: 0x100 Opcode: QUERY, \n    Query Type: 0,\n")
    assert text.endswith("    Response Code: No Error, Question Count: 2, Answer Record Count: 0, Authority Record Count: 0, Additional Record Count: 0")
    assert objects.dns_id_flags(str(0x12340100)).startswith("id: 0x1234, flags: 0x100 Opcode: QUERY")


def test_location_tracker():
    text = objects.decoded("location:_CLLocationManagerStateTrackerState", b64(struct.pack("<dd", 25.0, 10.0), bytes(56)))
    assert text.startswith('{\n            "distanceFilter":25, \n            "desiredAccuracy":10, \n')
    assert '            "allowsMapCorrection":false,\n' in text
    assert text.endswith('"isAuthorizedForWidgetUpdates":false,\n        }')


def test_daemon_tracker():
    # Level, charged, connected, two flags, charger, a flag, spare, reachability, thermal level, and four switches.
    data = struct.pack("<dBBBBIIIIiBBBB", 50.0, 1, 0, 1, 1, 2, 1, 0, 2, 7, 1, 0, 1, 0)
    text = objects.state(3, "CLDaemonStatusStateTracker", data)
    assert text.startswith('{"thermalLevel": 7, "reachability": "kReachability') and '"airplaneMode": true, ' in text
    assert '"batteryData":{"wasConnected": true, "charged": true, "level": 50, "connected": false, "chargerType": "kChargerType' in text
    assert text.endswith('"restrictedMode": false, "batterySaverModeEnabled": false, "push_service":true}')
    assert '"wasConnected": false' in objects.state(3, "CLDaemonStatusStateTracker", bytes(40))


def test_states():
    assert objects.state(1, "x", b"") == "Empty plist data"
    assert objects.state(1, "x", b"junk") == "Failed to get plist data"
    assert json.loads(objects.state(1, "x", plistlib.dumps({"a": [1, b"\x01"]}))) == {"a": [1, [1]]}
    assert json.loads(objects.state(2, "x", b"\x08\x96\x01\x12\x02hi")) == {"1": 150, "2": "hi"}
    assert objects.state(2, "x", b"\x07").startswith("Failed to parse StateDump protobuf: ")
    assert objects.state(3, "Other", b"ab") == f"Unsupported Statedump object: Other-{base64.b64encode(b'ab').decode()}"
    assert objects.state(3, "DNS Configuration", b"") == "Failed to parse statedump object: DNS Configuration"
    assert objects.state(9, "x", b"text\0") == "text"


def test_dns_configuration():
    option = lambda kind, value: struct.pack(">II", kind, len(value) + 8) + value
    options = option(0xC, b"home\0") + option(0xB, bytes(4) + bytes([10, 0, 0, 1]) + bytes(8)) + option(0x10, b"en0\0") + option(0xF, b"id\0")
    own = bytes(56) + struct.pack(">5I", 5, 0, 4, 6, 0x20002) + bytes(20) + struct.pack(">I", len(options)) + options
    data = struct.pack(">I", 1) + bytes(8) + struct.pack(">I", 0) + bytes(40) + struct.pack(">II", 1, len(own) + 8) + own
    text = objects.state(3, "DNS Configuration", data)
    assert text.count("DNS Configuration\n") == 4
    assert "resolver #0\n  search domain[0] : home\n  nameserver[0] : 10.0.0.1\n  if_index : 4 (en0)\n  timeout  : 5\n  flags    : 0x00000006 (Request A records, Request AAAA records)\n  reach    : 0x00020002 (Reachable, Directly Reachable Address)\n  config id: id\n\n" in text


def test_network_information():
    one = b"en0".ljust(16, b"\0") + struct.pack("<QiII", 4, 0, 0x1000002, 2) + bytes([10, 0, 0, 7]) + bytes(12) + struct.pack("<QI", 9, 2) + bytes(28) + bytes(20)
    data = struct.pack("<8IQ", 1, 1, 1, 0, 1, 0, 0, 0, 77) + one + bytes(112)
    text = objects.state(3, "Network information", data)
    assert text.startswith(f"Network information (generation 77 size={len(data)})\nIPv4 network interface information\n     en0 : flags      : 0x5 (IPv4,DNS)\n           address    : 10.0.0.7\n")
    assert "rank       : 0x01000002 (Default, 0x2)\n" in text
    assert text.endswith("IPv6 network interface information\nNetwork interfaces: en0\n")


def number(value: int | str) -> Item:
    return Item(2, 0, str(value))


@pytest.mark.parametrize(
    ("raw", "items", "want"),
    [
        ("%+04d", [number(2)], "+002"), ("%04d", [number(2)], "0002"), ("%#4x", [number(2)], " 0x2"), ("%#04o", [number(100)], "0o144"), ("%07o", [number(100)], "0000144"), ("%x", [number(10)], "A"), ("%d", [number(-248)], "-248"),
        ("%{public}s", [Item(0x22, 5, "test")], "test"), ("%{public, signpost.description:begin_time}llu", [number(1)], "1 (signpost.description:begin_time)"),
        ("%+09.4f", [number(bits(0.0125))], "+000.0125"), ("%9.4f", [number(bits(0.0125))], "   0.0125"), ("%-8.4f", [number(bits(0.0125))], "0.0125  "),
        ("%f", [number(bits(2.718281))], "2.718281"), ("%f", [number(bits(-8.0))], "-8"), ("%f", [number(bits(-1234567.5))], "-1234567.5"), ("%f", [number(bits(7.3))], "7.3"),
        ("%.2@", [Item(0x22, 8, "aaabbbb")], "aa"), ("", [], ""), ("", [Item(0x22, 2, "hi")], "hi"), ("100% done", [], "100% done"), ("100%%", [], "100%"),
        ("%s and %s", [Item(0x22, 2, "a")], "a and <Missing message data>"), ("%s %d", [Item(0x22, 3, "%d"), number(7)], "%d 7"),
        ("x %{public}%@", [Item(0x22, 2, "v")], "x %{public}v"), ("%s", [Item(0x21, 0, "")], "<private>"), ("%d", [Item(1, 0x8000, "")], "<private>"), ("%s", [Item(0x12, 0, ""), Item(0x22, 2, "b")], "b"),
        ("%m", [number(2)], "No such file or directory"), ("%c", [number(65)], "A"), ("%c", [number(-1)], "Failed to parse number item to char string"), ("%-8x|", [number(10)], "A0000000|"), ("%#-8x|", [number(10)], "A0000000|"),
        ("%{mask.hash}s", [Item(0xF2, 4, "hash")], "hash"), ("%{uuid_t}.16P", [Item(0x22, 6, "<private>")], "<private>"), ("%{darwin.errno}d", [number(2)], "No such file or directory"), ("%u", [Item(0x22, 3, "All")], "0"), ("%+d", [number(-5)], "+-5"),
        # A text where a number is asked for counts as zero, and a number stands where a text is asked for.
        ("link.c:%d] port[%d] %s of %s set %s, speed = %u", [Item(0, 0, "12"), Item(0, 0, "3"), Item(32, 5, "lane"), Item(32, 5, "card"), Item(0, 0, "44"), Item(32, 5, "fast"), Item(0, 0, "9")], "link.c:12] port[3] lane of card set 44, speed = 0"),
    ],
)
def test_render(raw, items, want):
    assert render(raw, items) == want


def test_dynamic_width_given_directly():
    assert plain("%*s", [Item(0x10, 10, ""), Item(0x22, 3, "hi")], 0, 0x10) == "        hi"
