"""``spark.read.format("tracelog")``: archive records as a Python data source.

Options: path (a directory, or mode=live for the system's own), kind (firehose,
oversize, statedump, simpledump, header or catalog; all without it), evidence (one
file), mode (PERMISSIVE or FAILFAST), since and until (ticks; chunksets outside of them by
their catalog are not unpacked) and splitBytes. A file of more than splitBytes is
read by several tasks: its chunks are followed once, 16 bytes each, to find where
catalogs begin, and a partition is a range of bytes from one catalog to another.
What a range does not hold, the file's header, comes from the first range, and
plans join it by evidence. Paths may be on any file system that Arrow opens;
``tracelake.sources.archive`` reads whole files on any that Spark opens.

Only options narrow a read. Spark keeps what a Python source was told to filter
with the loaded table, not with its use, so where one query uses a table twice
with different conditions, as the event table does, one would narrow the other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tracelake import schemas
from tracelake.sources import codec
from tracelake.sources.archive import LIVE_ROOTS, record_row

PARENTS = ("HighVolume", "Special", "Signpost", "Persist")
SPLIT_BYTES, LISTERS = 64 << 20, 16


def is_trace(path: str) -> bool:
    *_, parent, name = ["", *path.split("/")]
    return name == "logdata.LiveData.tracev3" or (name.endswith(".tracev3") and not name.startswith("._") and parent in PARENTS)


class FileSystem:
    """Listing and ranged reads of a root's files, by paths as the root is written."""

    def __init__(self, root: str):
        if "://" in root:
            self.system, self.base = arrow_fs.FileSystem.from_uri(root)
            self.prefix = "" if root.startswith("file:") else root[: len(root) - len(self.base)] if root.endswith(self.base) else ""
        else:
            self.system, self.base, self.prefix = arrow_fs.LocalFileSystem(), root, ""

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of every trace file below the root."""
        found = self.system.get_file_info(arrow_fs.FileSelector(self.base, recursive=True))
        return [(self.prefix + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and is_trace(f.path)]

    def open(self, path: str) -> pa.NativeFile:
        return self.system.open_input_file(path.removeprefix(self.prefix))


class ByteRange(InputPartition):
    """Bytes of a file, before which there are so many catalogs."""

    def __init__(self, root: str, path: str, begin: int, end: int, catalogs: int):
        self.root, self.path, self.begin, self.end, self.catalogs = root, path, begin, end, catalogs


def ranges_of(root: str, path: str, size: int, most: int) -> list[ByteRange]:
    """A file's partitions: the whole, or runs of catalogs of some most bytes each."""
    if size <= most:
        return [ByteRange(root, path, 0, size, 0)]
    out: list[ByteRange] = []
    with FileSystem(root).open(path) as f:
        for catalogs, begin, end in codec.segments(lambda at, n: f.read_at(n, at), size):
            if out and out[-1].end - out[-1].begin < most:
                out[-1].end = end
            else:
                out.append(ByteRange(root, path, begin, end, catalogs))
    return out


class TraceReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        number = lambda name: int(options[name]) if options.get(name) else None
        self.names = schema.names
        self.roots = LIVE_ROOTS if options.get("mode", "").lower() == "live" else [options["path"]]
        self.kind, self.strict = options.get("kind"), options.get("mode", "").upper() == "FAILFAST"
        self.since, self.until, self.most = number("since"), number("until"), number("splitbytes") or SPLIT_BYTES
        self.evidence = options.get("evidence")

    def partitions(self) -> Sequence[InputPartition]:
        found = [(root, *f) for root in self.roots for f in FileSystem(root).files() if self.evidence in (None, f[0])]
        found.sort(key=lambda f: f[1].split("/"))
        with ThreadPoolExecutor(LISTERS) as pool:
            return [r for own in pool.map(lambda f: ranges_of(*f, self.most), found) for r in own]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        with FileSystem(partition.root).open(partition.path) as f:
            data = f.read_at(partition.end - partition.begin, partition.begin)
        try:
            for found in codec.trace_file(data, self.strict, partition.catalogs, self.since, self.until):
                if self.kind in (None, found[0]):
                    row = record_row(partition.path, found)
                    yield tuple(row.get(n) for n in self.names)
        except (codec.Malformed, struct.error):
            if self.strict:
                raise


class TraceLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracelog"

    def schema(self) -> str:
        return schemas.RECORD_DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return TraceReader(schema, {k.lower(): v for k, v in dict(self.options).items()})


def ranged(spark: SparkSession, roots: str | list[str], mode: str = "PERMISSIVE", **options) -> DataFrame:
    """Records below the roots, large files by ranges of their catalogs. options: those of the source."""
    register(spark)
    parts = [spark.read.format("tracelog").options(mode=mode, **options).load(path=r) for r in ([roots] if isinstance(roots, str) else roots)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def register(spark) -> None:
    """Makes the source and the SQL function format_log known to a session."""
    spark.dataSource.register(TraceLog)
    spark.udf.register("format_log", _format_log())


def _format_log():
    from tracelake.operators.printf import _format

    return _format
