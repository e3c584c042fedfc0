"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a block of documents form a corpus of linked byte tokens.
An inverted index holds, for every mergeable pair by its rank, the positions
where it stands. Ranks are replayed in order: all positions of the lowest rank
are merged at once and only the two pairs beside each merge are looked up again.
A rank of which no product can be merged at a lower rank is replayed in one go
(leftmost first where positions overlap); otherwise one position a word at a
time, so the result is the one of the greedy rule word by word even for
vocabularies whose ranks are not monotone. Words of one block never influence
each other, so blocks of bounded size give the same ids as one corpus would,
without moving any text between tasks.

Defined cases: null text counts as empty and gives no ids; empty tables give
empty results; equal texts get equal ids; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import small_batches, table, tidy

BLOCK_CHARS, CACHE_WORDS = 4_000_000, 250_000
NONE = np.int64(1 << 62)
#: A space or line feed after any other character always begins a new match of the pattern, if no other white space is near.
USUAL = r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE, OTHER_SPACE = re.compile(r"[ \n]*[^ \n]+|[ \n]+"), re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


class Replay:
    """Merge replay over one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.n = ranks, max(ranks.values()) + 1
        self.bytes_of = [b""] * self.n
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]] * self.n + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, to = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.keys, self.to = np.append(keys, np.int64(-1)), np.append(to, NONE)
        self.size = len(keys)
        # lowest[t]: the lowest rank that a pair with the token t on either side makes.
        lowest = np.full(self.n, NONE)
        np.minimum.at(lowest, keys // self.n, to)
        np.minimum.at(lowest, keys % self.n, to)
        self.in_one_go = (lowest > np.arange(self.n)).tolist()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where they don't merge or right is -1."""
        want = left * self.n + right
        at = np.searchsorted(self.keys[: self.size], want)
        return np.where((self.keys[at] == want) & (right >= 0), self.to[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        todo = []
        for i, w in enumerate(words):
            if w in self.ranks:
                out[i] = self.ranks[w].to_bytes(4, "little")
            elif w:
                todo.append(i)
        if todo:
            token, of, alive = self.replay([words[i] for i in todo])
            ids = token[alive].astype("<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(of[alive], minlength=len(todo)))).tolist()
            start = 0
            for i, end in zip(todo, ends, strict=True):
                out[i] = ids[start:end]
                start = end
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens by position, the word of each position, and which positions are left."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lengths.sum())
        token = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], -1)
        of = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.cumsum(lengths) - 1
        after[last], before[last - lengths + 1] = n, n
        rank = np.append(self.rank_of(token[:n], token[after[:n]]), NONE)
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(positions: np.ndarray) -> None:
            found = rank[positions]
            positions, found = positions[found < NONE], found[found < NONE]
            if len(positions) > 1:
                order = np.argsort(found, kind="stable")
                positions, found = positions[order], found[order]
            cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)] if len(found) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                r = int(found[a])
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heapq.heappush(heap, r)

        post(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            p = p[rank[p] == r]
            if not len(p):
                continue
            if len(p) > 1:
                if self.in_one_go[r]:
                    chained = after[p[:-1]] == p[1:]
                    if chained.any():
                        place = np.arange(len(p))
                        head = np.append(True, ~chained)
                        p = p[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
                else:
                    first = np.append(True, of[p[1:]] != of[p[:-1]])
                    if not first.all():
                        index[r] = [p[~first]]
                        heapq.heappush(heap, r)
                        p = p[first]
            q = after[p]
            beyond = after[q]
            token[p], after[p], before[beyond], rank[q], alive[q] = r, beyond, p, NONE, False
            left = before[p]
            touched = np.concatenate([p, left[left < n]])
            if len(p) > 1:
                touched = np.unique(touched)
            rank[touched] = self.rank_of(token[touched], token[after[touched]])
            post(touched)
        return token[:n], of, alive


class Encoder:
    """Encodes texts block by block, keeping the ids of pieces seen before."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.replay = Replay({base64.b64decode(a): int(b) for a, b in pairs})
        self.pattern, self.known = regex.compile(pattern), {}
        #: Whether the shortcuts below hold: words of letters, numbers or signs, each with a space before it at most.
        self.usual = pattern.endswith(USUAL)

    def pieces(self, text: str) -> list[str]:
        return PIECE.findall(text) if self.usual and not OTHER_SPACE.search(text) else self.pattern.findall(text)

    def words(self, piece: str) -> list[str]:
        # A run of letters, alone or after a space, is one match of the usual pattern.
        letters = self.usual and (piece.isalpha() or (piece[0] == " " and piece[1:].isalpha()))
        return [piece] if letters else self.pattern.findall(piece)

    def block(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = set().union(*split).difference(known)
        if new:
            parts = {p: self.words(p) for p in new}
            words = list(set().union(*parts.values()))
            ids = dict(zip(words, self.replay.encode([w.encode() for w in words]), strict=True))
            for p, found in parts.items():
                known[p] = ids[found[0]] if len(found) == 1 else b"".join([ids[w] for w in found])
        return [b"".join(map(known.__getitem__, s)) for s in split]


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose column holds about as many bytes as most."""
    size = batch.column(column).nbytes
    step = max(1, int(batch.num_rows * most / max(size, most))) if batch.num_rows else 1
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


Batches = Iterator[pa.RecordBatch]
Step = Callable[[Batches], Batches]


def encoding(ranks: Broadcast, pattern: str, text: str, ids: str) -> Step:
    def run(batches: Batches) -> Batches:
        own = encoder(ranks.value, pattern)
        for whole in batches:
            for batch in slices(whole, text, BLOCK_CHARS):
                yield with_column(batch, ids, pa.array(own.block([t or "" for t in batch.column(text).to_pylist()]), pa.binary()))
        own.known.clear()

    return run


def decoding(ranks: Broadcast, pattern: str, ids: str, decoded: str) -> Step:
    def run(batches: Batches) -> Batches:
        of = encoder(ranks.value, pattern).replay.bytes_of.__getitem__
        for whole in batches:
            for batch in slices(whole, ids, 4 * BLOCK_CHARS):
                values = [None if v is None else b"".join(map(of, np.frombuffer(v, "<u4").tolist())) for v in batch.column(ids).to_pylist()]
                yield with_column(batch, decoded, pa.array(values, pa.binary()))

    return run


def mapped(docs: DataFrame, steps: list[Step], names: list[str]) -> DataFrame:
    """docs through the steps in one Python worker, with the binary columns they add."""

    def run(batches: Batches) -> Batches:
        for step in steps:
            batches = step(batches)
        yield from batches

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *(T.StructField(n, T.BinaryType()) for n in names)]))


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of ids as little-endian unsigned 32-bit integers.

    ranks is the content of a rank file, bounded by the vocabulary and read on the
    driver, so executors need no file.
    """
    return mapped(docs, [encoding(docs.sparkSession.sparkContext.broadcast(ranks), pattern, text, ids)], [ids])


def decode(docs: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with a binary column of the bytes that the ids stand for; null ids give null."""
    return mapped(docs, [decoding(docs.sparkSession.sparkContext.broadcast(ranks), pattern, ids, decoded)], [decoded])


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() then decode() in one pass of the rows through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    return mapped(docs, [encoding(shared, pattern, text, ids), decoding(shared, pattern, ids, decoded)], [ids, decoded])


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def digests(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Encodes and decodes docs (with a text column) and adds token count and digests."""
    ranks, pattern = public_ranks()
    both = round_trip(docs.select(*keep, "text"), ranks, pattern)
    return both.select(*keep, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
