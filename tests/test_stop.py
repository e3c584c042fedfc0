"""Runs that end early: a stop between batches, an interrupt, a reader that goes away."""

import csv
import io
import json
import os
import signal
import struct
import threading
import time

import pytest

from tracelake import cli, sinks
from tracelake.sources import encode
from tracelake.streaming import bookmark as marks
from tracelake.streaming import live

TEXT, AT = encode.uuidtext([(0x1000, ["file %d"])], "/bin/clock")


def one_file(n: int) -> bytes:
    said = encode.event(4, struct.pack("<I", 5), [encode.number_item(n)], 0x2, AT["file %d"], delta=n)
    body = encode.chunkset([encode.firehose(1, 2, 5, [said])])
    return encode.trace_file([encode.header("B0" * 16), encode.catalog([{"p1": 1, "p2": 2, "pid": 9}], ["AA" * 16]), body])


@pytest.fixture
def root(tmp_path):
    files = {f"Persist/{n}.tracev3": one_file(n) for n in range(2)} | {"AA/" + "AA" * 15: TEXT, "timesync/1.timesync": encode.timesync([("B0" * 16, 1, 1, 0, [(0, 1000)])])}
    return encode.write(str(tmp_path / "in"), files)


def test_a_stop_between_batches_loses_and_repeats_nothing(spark, root, tmp_path):
    out, mark, asked, batches = str(tmp_path / "out"), str(tmp_path / "mark"), threading.Event(), []

    def sink(df, number):
        batches.append(number)
        df.select("message").write.mode("append").parquet(out)
        asked.set()  # asked for while the batch is at work

    def stream():
        writer = live.stream_events(spark, root, sink, str(tmp_path / "check"), per_batch=1, stopping=asked.is_set, bookmark=mark)
        return live.run(writer.trigger(availableNow=True), asked.is_set)

    assert stream() is False and batches == [0] and spark.read.parquet(out).count() == 1
    first = marks.load(spark, mark, root).time
    assert first >= 1005
    asked.clear()
    assert stream() is False and batches == [0, 1]
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["file 0", "file 1"]
    assert marks.load(spark, mark, root).time == 1006 >= first
    assert sorted(os.listdir(str(tmp_path / "check-state" / "records"))) == ["0", "1"]


def test_other_errors_are_not_taken_for_a_stop(spark, root, tmp_path):
    def sink(df, number):
        raise ValueError("disk is full")

    with pytest.raises(Exception, match="disk is full"):
        live.run(live.stream_events(spark, root, sink, str(tmp_path / "check")).trigger(availableNow=True), lambda: False)


def test_follow_ends_at_an_interrupt(spark, root, tmp_path):
    out = str(tmp_path / "out")
    own = signal.getsignal(signal.SIGINT)

    def interrupt():
        while not os.path.exists(out):
            time.sleep(0.2)
        os.kill(os.getpid(), signal.SIGINT)

    threading.Thread(target=interrupt, daemon=True).start()
    cli.main(["log-archive", "--input", root, "--output", out, "--format", "parquet", "--follow", "--bookmark", str(tmp_path / "mark")], spark)
    assert sorted(r["message"] for r in spark.read.parquet(out).collect()) == ["file 0", "file 1"]
    assert signal.getsignal(signal.SIGINT) is own


class Reader(io.StringIO):
    """A pipe whose other end closes after some lines."""

    def __init__(self, lines: int):
        super().__init__()
        self.lines = lines

    def write(self, text):
        if not self.lines:
            raise BrokenPipeError
        self.lines -= 1
        return super().write(text)


def test_rows_are_printed_until_the_reader_leaves(spark):
    columns = {c: 'a "b",\nc' if c == "message" else f"{c}" for c in sinks.CSV.values()} | {"timestamp": "2024-01-02T03:04:05.123456789Z"}
    events = spark.createDataFrame([columns] * 50).repartition(5)
    whole, part = Reader(1000), Reader(7)
    assert sinks.print_rows(events, whole, "csv") is True
    rows = list(csv.reader(io.StringIO(whole.getvalue())))
    assert rows[0] == list(sinks.CSV) and len(rows) == 51 and rows[1][0] == "2024-01-02T03:04:05.123Z" and rows[1][14] == 'a "b",\nc'
    assert sinks.print_rows(events, part, "csv") is False and part.getvalue().count("2024-01-02") == 6
    with pytest.raises(ValueError, match="unknown format"):
        sinks.print_rows(events, whole, "xml")


def test_command_line_prints(spark, root, capsys):
    cli.main(["log-archive", "--input", root, "--output", "-"], spark)
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert sorted(x["message"] for x in lines) == ["file 0", "file 1"]
