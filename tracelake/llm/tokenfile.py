"""Token ids in Parquet files, in document order, for selective reading.

A token file is a folder. ``ids`` holds one row a document in ascending order of
its id: the ids as a list column (dictionary encoded, so 16 bits an id for usual
vocabularies), and doc_id, part, at, upto and n_tokens (delta encoded). Row groups and
pages have bounded sizes, and pages are indexed, so a reader that asks for some
documents or some token positions skips the other pages, and one that asks for
no ids reads none. ``parts`` holds, for every file in order, how many tokens lie
before it; a document's place among all tokens is that number plus ``at``.

Documents are dealt by ranges of their id, each range is sorted and encoded in
one task, and a task writes one file; nothing is numbered on one machine but the
files themselves. Ids are those of the tokenizers library. Texts are handed to
it in pieces that end where a match of the usual pattern always ends, and pieces
seen lately are remembered, up to a bound. A batch is cut into pieces, its different
pieces are found and its ids are put in their places by Arrow and numpy, so Python
looks at each different piece of a batch once.

Defined cases: null text counts as empty and gives the end id alone; null ids
come first; equal ids are ordered by a hash of their texts, and rows equal in
both are interchangeable; empty tables give empty folders that read as empty
tables; other columns are not written.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import shared_folder, small, small_batches, table, thin, tidy

ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 64 << 10, 1000
SLICE, CACHE_PIECES, ENCODED_AT_ONCE, IN_A_ROW = 2 << 20, 300_000, 10_000, 50
#: Begins a piece that stands by itself; other pieces have a blank before them, or begin with their line feed.
ALONE = "\x01"
#: A blank between two other characters than white space begins a match of the pattern, whatever else the text holds.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: A run of one or two blanks and line feeds has its last character with the next word and a match of its own for the one before;
#: three or more, two at the end, other white space and the mark itself are left to SAFE_CUT.
UNUSUAL = r"[ \n]{3}|[ \n]{2}\z|[\x01\t\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A match of the pattern ends between a letter and a sign, so a word is the same piece with and without its punctuation.
WORD_AND_SIGN = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-/:-@\[-`{-~])"
FORMAT = {
    "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "at", "upto", "n_tokens")}, "compression": "zstd",
}
ROWS = "part int, at long, upto long, n_tokens long, ids array<int>"


class Encoder:
    """Ids of texts by one tokenizer of the library."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has as many tasks as cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        own = json.loads(definition)
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        #: Only with the usual pattern, and nothing else that looks at a text, are pieces independent of each other.
        self.cuts = own.get("normalizer") is None and usual.items() <= (own.get("pre_tokenizer") or {}).items()
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token: in a byte-level vocabulary a character stands for a byte.
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.known: dict[str, bytes] = {}
        self.old = self.known

    def pieces(self, texts: pa.Array) -> pa.Array:
        """What each text is cut into."""
        if not self.cuts:
            return pa.array([[ALONE + t] for t in texts.to_pylist()], pa.list_(texts.type))
        unusual = pc.match_substring_regex(texts, UNUSUAL)
        rest = texts.filter(unusual)
        usual = pc.replace_substring(texts.filter(pc.invert(unusual)) if len(rest) else texts, "\n", " \n")
        usual = pc.replace_substring_regex(usual, WORD_AND_SIGN, rf"\1 {ALONE}\2")
        found = pc.split_pattern(pc.binary_join_element_wise(ALONE, usual, ""), " ")
        if not len(rest):
            return found
        others = pa.array([[ALONE + p for p in SAFE_CUT.split(t)] for t in rest.to_pylist()], found.type)
        place = np.empty(len(texts), np.int64)
        own = unusual.to_numpy(zero_copy_only=False)
        place[~own], place[own] = np.arange(len(found)), len(found) + np.arange(len(others))
        return pa.concat_arrays([found, others]).take(pa.array(place))

    def one_by_one(self, pieces: list[str]) -> list[bytes]:
        """The ids of texts that stand by themselves."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def in_a_row(self, pieces: list[str]) -> list[bytes]:
        """The ids of words, each with the blank or line feed before it: encoded many to a text, which costs less, and told apart by their bytes."""
        lines = ["".join(pieces[i : i + IN_A_ROW]) for i in range(0, len(pieces), IN_A_ROW)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in pieces])) + 1
        packed, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [packed[i:j] for i, j in zip(at, at[1:], strict=False)]

    def remember(self, keys: list[str]) -> None:
        """Makes pieces known that are not.

        Of the pieces seen lately two generations are kept, so frequent ones stay while the number is bounded.
        """
        known, old = self.known, self.old
        ids = list(map(old.get, keys))
        known.update([(k, v) for k, v in zip(keys, ids, strict=True) if v is not None])
        new = [k for k, v in zip(keys, ids, strict=True) if v is None]
        words = [k for k in new if k[:1] != ALONE and k not in ("", "\n")]
        rest = [k for k in new if k[:1] == ALONE or k in ("", "\n")]
        for some, ids_of in ((words, self.in_a_row), (rest, self.one_by_one)):
            for i in range(0, len(some), ENCODED_AT_ONCE):
                part = some[i : i + ENCODED_AT_ONCE]
                known.update(zip(part, ids_of([k[1:] if k[:1] == ALONE else k if k[:1] == "\n" else " " + k for k in part]), strict=True))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many of them each text has."""
        split = self.pieces(texts)
        met = split.flatten().dictionary_encode()
        keys, at = met.dictionary.to_numpy(zero_copy_only=False).tolist(), met.indices.to_numpy()
        if len(self.known) > CACHE_PIECES:
            self.known, self.old = {}, self.known
        each = list(map(self.known.get, keys))
        absent = [k for k, v in zip(keys, each, strict=True) if v is None]
        self.remember(absent)
        rest = map(self.known.__getitem__, absent)
        each = [next(rest) if v is None else v for v in each]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        begins, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.append(0, np.cumsum(n))
        ids = np.frombuffer(b"".join(each), "<u4")[np.repeat(begins - ends[:-1], n) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))])

    def block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers."""
        ids, n = self.batch(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(n)[:-1])] if texts else []


@lru_cache(maxsize=1)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


def encoded(docs: DataFrame, definition: str, end_id: int | None) -> DataFrame:
    """(doc_id, part, at, upto, n_tokens, ids) of documents (doc_id, text); at and upto count a partition's tokens in its order."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = encoder(shared.value), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in thin(whole, SLICE):
                ids, n = own.batch(pc.fill_null(batch.column("text"), ""))
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view("<i4")))
                columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(at + ends), pa.array(n), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "part", "at", "upto", "n_tokens", "ids"])
                at += int(ends[-1]) if len(ends) else 0

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, {ROWS}")


def write(docs: DataFrame, folder: str, definition: str, end_id: int | None = None) -> None:
    """Writes the ids of documents (doc_id, text) to a new folder. definition: the content of a tokenizer's JSON file."""
    order = ["doc_id", "__text_hash"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("__text_hash")).repartitionByRange(*order).sortWithinPartitions(*order)
    encoded(dealt, definition, end_id).write.options(**FORMAT).parquet(f"{folder}/ids")
    # As many rows as files: numbering them in one task is no burden.
    sizes = docs.sparkSession.read.parquet(f"{folder}/ids").groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a token file; what is not selected is not read, and conditions on doc_id skip pages."""
    parts = small(spark.read.parquet(f"{folder}/parts").select("part", "before"))
    return spark.read.parquet(f"{folder}/ids").join(parts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def tokens_between(spark: SparkSession, folder: str, first: int, count: int) -> DataFrame:
    """(start, ids): the tokens from place first on, count of them, in runs by document; start is the place of a run.

    All conditions reach the scan: files by their number, pages by their range of at and upto.
    """
    last, parts = first + count, spark.read.parquet(f"{folder}/parts")
    touched = parts.where((F.col("before") < last) & (F.col("before") + F.col("tokens") > first))
    at_edge = lambda pick: pick(F.struct("part", "before"))
    low, high = touched.agg(at_edge(F.min), at_edge(F.max)).first()
    if low is None:
        return spark.createDataFrame([], "start long, ids array<int>")
    part = F.col("part")
    after_first = (part > low[0]) | ((part == low[0]) & (F.col("upto") > first - low[1]))
    before_last = (part < high[0]) | ((part == high[0]) & (F.col("at") < last - high[1]))
    rows = spark.read.parquet(f"{folder}/ids").where(after_first & before_last).join(small(parts.select("part", "before")), "part")
    rows = rows.select((F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
    skip = F.greatest(F.lit(0), F.lit(first) - F.col("start"))
    length = F.least(F.col("start") + F.col("n_tokens"), F.lit(last)) - F.col("start") - skip
    return rows.select((F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), length.cast("int")).alias("ids")).where(F.size("ids") > 0)


def with_crc32(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read() gives: unsigned crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def public_definition(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op12_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document, read back from a token file of all of them."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, public_definition(), end_id=0)
    return with_crc32(read(spark, folder))
