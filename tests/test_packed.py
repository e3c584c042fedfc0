"""Packed values as column expressions against the decoders of single values, whole and broken."""

import base64
import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from tracelake.functions import packed
from tracelake.operators import objects

KINDS = {
    "network:in6_addr": packed.ipv6,
    "network:sockaddr": packed.sockaddr,
    "mdnsresponder:ip_addr": packed.resolver_address,
    "odtypes:nt_sid_t": packed.sid,
    "odtypes:mbr_details": packed.member_details,
    "location:_CLClientManagerStateTrackerState": packed.client_state,
}


def whole(rnd, n=400):
    """Well formed values of all kinds; addresses with runs of zeros of all lengths and places."""
    six = lambda: b"".join(struct.pack(">H", rnd.choice([0, 0, 0, 1, 0x10, 0xAB0, 0xFFFF])) for _ in range(8))
    name = lambda: rnd.choice(["staff", "wörter 中", "", "a\nb"]).encode() + rnd.choice([b"\0", b""])
    for _ in range(n):
        yield six()
        yield bytes(10) + b"\xff\xff" + rnd.randbytes(4)
        yield bytes([28, 30]) + struct.pack(">HI", rnd.choice([0, 443]), rnd.getrandbits(32)) + six() + struct.pack(">I", rnd.getrandbits(32))
        yield bytes([16, 2]) + struct.pack(">H", rnd.choice([0, 65535])) + rnd.randbytes(12)
        yield struct.pack("<I", rnd.choice([4, 6, 5])) + six()
        yield bytes([1, rnd.randrange(8)]) + rnd.randbytes(rnd.randrange(40))
        yield bytes([rnd.choice([35, 163, 195])]) + struct.pack("<i", rnd.randrange(-(2**31), 2**31)) + name()
        yield bytes([rnd.choice([36, 160, 164, 68, 9])]) + name() + name()
        yield bytes([36]) + b"\xff\xfe\0" + name()
        yield struct.pack("<II", rnd.getrandbits(32), rnd.choice([0, 1, 2]))


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(5)
    made = list(whole(rnd))
    made += [m[: rnd.randrange(len(m) + 1)] for m in made] + [rnd.randbytes(rnd.randrange(30)) for _ in range(300)]
    texts = [base64.b64encode(m).decode() for m in made]
    return [*dict.fromkeys(texts), "", "!", "AA", "AA=A", "AAAA\n", " AAAA", "AAA", "====", "äAAA", None]


@pytest.mark.parametrize("kind", KINDS)
def test_as_single_values(spark, values, kind):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", KINDS[kind](F.col("v")).alias("got")).collect()
    assert len(rows) == len(values)
    for v, got in rows:
        assert got == (None if v is None else objects.decoded(kind, v)), (v, v and base64.b64decode(v + "=="))


def test_shortest_addresses(spark):
    given = ["::", "::1", "1::", "1:0:0:2::3", "1::2:0:0:3", "10:0:0:10::", "0:1:2:3:4:5:6:7", "1:2:3:4:5:6:7:0", "0:0:1::", "100:0:10:0:1:0:a0:0", "::ffff:1.2.3.4", "::1.2.3.4"]
    rows = [(g, base64.b64encode(ipaddress.ip_address(g).packed).decode()) for g in given]
    want = {g: "::ffff:1.2.3.4" if g.startswith("::ffff") else ipaddress.ip_address(g).compressed for g in given}
    assert dict(spark.createDataFrame(rows, "g string, v string").select("g", packed.ipv6(F.col("v"))).collect()) == want


def test_no_python(spark, capsys):
    df = spark.createDataFrame([("AAAA",)], "v string").select(*[f(F.col("v")) for f in KINDS.values()])
    df.explain()
    assert "EvalPython" not in capsys.readouterr().out
