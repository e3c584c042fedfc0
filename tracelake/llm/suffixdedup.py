"""Removal of repeated 400-byte strings.

The method dealt for this operator, merging shard Burrows-Wheeler transforms by
iterative interleave refinement, takes one pass over all bytes per symbol of
common prefix, so 400 passes here; README.md has the figures. This operator
finds the same repeated strings by content-defined runs of suffixes instead:

1. The suffixes of a text are grouped into runs: neighbours whose first 400
   bytes share the smallest hash among their 200-byte strings. Equal 400-byte
   strings always have equal smallest hashes, so a repeat can only lie in runs
   of equal key. About one run per hundred bytes leaves the scan. A run of one
   phrase over and over is folded to one turn of it.
2. Runs are dealt and sorted by key. A run whose whole text is found again is
   repeated throughout. Keys with several different texts are ragged: there,
   the edge of a repeat lies inside the run. Other runs are dropped.
3. The texts of ragged runs (one of each) are dealt by key, and their 400-byte
   strings compared by two 64-bit hashes. Keys with very many texts or strings
   are dealt by string hash instead, equal strings of a block as one row, so none is
   gathered in one task. What is found travels packed to buckets of documents.
4. Every document gets its repeated starts back and loses the bytes they cover.

The same method runs over words in place of bytes: a text is then the sequence of its
words' 64-bit hashes, and lengths and starts count words. The pipeline's stage removes what
a repeated 400-byte string or a repeated passage of 51 words covers; the query removes the strings
alone, which its contract fixes, and says beside that what strings and passages cover.

Equality is by 128 bits of polynomial hashes. Work and memory are linear in the
bytes; equal runs of a block are one row before any shuffle.

Defined cases: null text counts as empty; texts under 400 bytes keep every byte;
matches never cross documents; equal rows are each treated (and remove each
other, if long enough); ids are never looked at, so they may be null, repeated or of any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.bpe import slices
from tracelake.llm.common import blocks, cut, release, small_batches, table, thin, tidy

LENGTH, WORDS = 400, 51
BLOCK, BATCH_BYTES, MANY, MANY_STRINGS, AT_ONCE, SPANS_AT_ONCE, TEXTS_PER_BUCKET = 1 << 18, 1_000_000, 20_000, 1_000_000, 4_000_000, 500_000, 1024
RUNS = "key long, s1 long, s2 long, size int, again boolean, n long, places binary"
FOUND = "t1 long, t2 long, start int, size int, key long, texts long"
NAME = ["__t1", "__t2"]
BYTE, WORD = np.dtype(np.uint8), np.dtype(np.uint64)
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
PLACE = np.dtype([("t1", "<i8"), ("t2", "<i8"), ("start", "<i4")])


@lru_cache(maxsize=1)
def tables(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For two polynomial hashes: values of bytes, powers of an odd base, and its inverse's powers, modulo 2**64."""
    rng, out = np.random.default_rng(20240501), []
    for _ in range(2):
        values = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(0, 1 << 62, dtype=np.uint64)) * 2 + 1
        powers = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))]
        out.append((values, *powers))
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of each hash, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def units(text: str | None, kind: np.dtype) -> bytes:
    """The text's bytes, or the hashes of its words."""
    data = (text or "").encode()
    if kind == BYTE:
        return data
    own = data.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, own), WORD, len(own)).tobytes()


class Hashed:
    """Hashes of any substring of some bytes or words from prefix sums."""

    def __init__(self, data: np.ndarray):
        room = 1 << max(19, int(len(data)).bit_length())
        self.parts = []
        for values, powers, inverse in tables(room):
            prefix = np.zeros(len(data) + 1, np.uint64)
            own = values[data] if data.dtype == BYTE else mixed(data ^ values[0])
            np.cumsum(own * powers[: len(data)], out=prefix[1:])
            self.parts.append((prefix, inverse))

    def all(self, which: int, length: int) -> np.ndarray:
        """Hash of the string of that length at every start."""
        prefix, inverse = self.parts[which]
        return mixed((prefix[length:] - prefix[:-length]) * inverse[: len(prefix) - length])

    def at(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        prefix, inverse = self.parts[which]
        return mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every window of that width."""
    w = 1
    while 2 * w <= width:
        values = pick(values[:-w], values[w:])
        w *= 2
    return pick(values[: len(values) - (width - w)], values[width - w :]) if w < width else values


def folded(data: np.ndarray, strings: np.ndarray, least: int) -> int:
    """For a run's units and the hashes of its strings: a number of starts, least or more, that hold all
    its strings and after which the run only repeats itself, at least once more; 0 if there is none."""
    same = np.flatnonzero(strings[1 : 2 * least] == strings[0])
    if not len(same):
        return 0
    period = int(same[0]) + 1
    q = period * -(-least // period)
    return q if len(strings) >= 2 * q and np.array_equal(data[period:], data[:-period]) else 0


def runs_of(texts: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, size, key, s1, s2, again) of every run of the texts, each of that many units at least.

    again: the run may hold one string at two of its starts.
    """
    gram = length // 2
    width = length - gram + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.concatenate(texts)
    begin = np.cumsum(sizes) - sizes
    hashed = Hashed(data)
    grams = hashed.all(0, gram)
    least = sliding(grams, width, np.minimum)
    # A run ends where the smallest hash changes and at the last start of a text.
    heads = np.zeros(len(least) + 1, bool)
    heads[1:-1] = least[1:] != least[:-1]
    heads[begin] = True
    heads[begin + sizes - length + 1] = True
    valid = np.zeros(len(least) + 1, np.int8)
    valid[begin] = 1
    np.subtract.at(valid, begin + sizes - length + 1, 1)
    valid = np.cumsum(valid, dtype=np.int8)[:-1] > 0
    start = np.flatnonzero(heads[:-1] & valid)
    heads[-1] = True
    ends = np.flatnonzero(heads)
    end = ends[np.searchsorted(ends, start, side="right")]  # exclusive
    key = least[start]
    # Values that are smallest at two places near each other: their runs may repeat themselves.
    pad = np.zeros(width - 1, np.uint64)
    place = np.flatnonzero(grams == sliding(np.concatenate([pad, least, pad]), width, np.maximum))
    order = np.lexsort((place, grams[place]))
    place = place[order]
    close = (grams[place[1:]] == grams[place[:-1]]) & (place[1:] - place[:-1] < 2 * length)
    again = np.isin(key, np.unique(grams[place[1:]][close]))
    run, first = [np.arange(len(start))], [start]
    for i in np.flatnonzero(again & (end - start > 2 * width)):
        at = np.arange(start[i], end[i])
        q = folded(data[start[i] : end[i] - 1 + length], hashed.at(0, at, at + length), width)
        if q:
            # The other parts stand beside the first one: what is found twice is repeated throughout.
            first.append(np.append(np.arange(start[i] + q, end[i] - q, q), end[i] - q))
            run.append(np.full(len(first[-1]), i))
            end[i], again[i] = start[i] + q, False
    run, first, stop = np.concatenate(run), np.concatenate(first), end - 1 + length
    text = np.searchsorted(begin, first, side="right") - 1
    return text, first - begin[text], (end - start)[run], key[run], hashed.at(0, start, stop)[run], hashed.at(1, start, stop)[run], again[run]


def parts_of(batches: Iterator[pa.RecordBatch], length: int, kind: np.dtype) -> Iterator[list[tuple[int, int, int, np.ndarray]]]:
    """Lists of (t1, t2, start, units) of at most some BLOCK units in all; long texts are cut, with an overlap of length - 1.

    Which run a start is in follows from its own string alone, so a cut can only split a run in two.
    """
    parts, size = [], 0
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            for t1, t2, text in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text")), strict=True):
                data = np.frombuffer(units(text, kind), kind)
                for at in range(0, len(data) - length + 1, BLOCK):
                    part = data[at : at + BLOCK + length - 1]
                    if parts and size + len(part) > BLOCK:
                        yield parts
                        parts, size = [], 0
                    parts.append((t1, t2, at, part))
                    size += len(part)
    if parts:
        yield parts


def scan(length: int, kind: np.dtype):
    def block(parts: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        text, start, size, key, s1, s2, again = runs_of([p[3] for p in parts], length)
        place = np.empty(len(text), PLACE)
        for i, c in enumerate(("t1", "t2", "start")):
            place[c] = np.array([p[i] for p in parts])[text]
        place["start"] += start.astype(np.int32)
        order = np.lexsort((s2, s1, key))
        key, s1, s2, size, again, place = (x[order] for x in (key, s1, s2, size, again, place))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        first = np.flatnonzero(new)
        columns = [key[first].view(np.int64), s1[first].view(np.int64), s2[first].view(np.int64), size[first].astype(np.int32), again[first], np.diff(np.append(first, len(key)))]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), grouped(new, place)], names=["key", "s1", "s2", "size", "again", "n", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in parts_of(batches, length, kind):
            yield block(parts)

    return run


class Portion(NamedTuple):
    """Rows sorted by key and text. More of the first key or text came before (key_before, text_before)
    or more of the last key comes after (key_after) only where a key alone is larger than a portion."""

    rows: pa.Table
    key_before: bool
    text_before: bool
    key_after: bool


def portions(batches: Iterator[pa.RecordBatch], text: list[str], at_once: int, whole_if: str | None = None) -> Iterator[Portion]:
    """Sorted rows in portions of about at_once bytes, cut between keys, within a key between texts
    (equal in all columns of text, which begin with the key), and within a text only if it fills a portion.

    A key of which a row has a value in the column whole_if is never cut.
    """
    parts: list[pa.Table] = []
    size, last = 0, None

    def portion(rows: pa.Table, after: bool) -> Portion:
        nonlocal last
        first = tuple(rows.column(c)[0].as_py() for c in text)
        same = (last is not None and first[0] == last[0], last is not None and first == last)
        last = tuple(rows.column(c)[-1].as_py() for c in text) if after else None
        return Portion(rows, *same, after)

    def last_from(rows: pa.Table, columns: list[str]) -> int:
        other = np.zeros(len(rows), bool)
        for c in columns:
            values = rows.column(c).to_numpy()
            other |= values != values[-1]
        return int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0

    for batch in (part for whole in batches for part in thin(whole, at_once)):
        if batch.num_rows:
            parts.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
        # A text is only cut apart where two of its rows are there, so it is known to be found twice.
        if size >= at_once and sum(map(len, parts)) > 1:
            whole = pa.concat_tables(parts).combine_chunks()
            at, after = last_from(whole, text[:1]), False
            if not at and (whole_if is None or whole.column(whole_if).null_count == len(whole)):
                at, after = last_from(whole, text) or len(whole), True
            if at:
                yield portion(whole.slice(0, at), after)
            parts = [whole.slice(at).combine_chunks()] if at < len(whole) else []
            size = sum(p.nbytes for p in parts)
    if parts:
        yield portion(pa.concat_tables(parts).combine_chunks(), False)


def unpacked(column: pa.ChunkedArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the given rows and how many each row has."""
    values = column.take(pa.array(rows)).combine_chunks()
    values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(values) else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), PLACE), np.diff(offsets) // PLACE.itemsize


def classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are repeated throughout (texts 0) and one of each ragged text (texts: how many its key has).

    A key larger than a portion counts as one of very many texts, so its rows need
    not be together.
    """
    for rows, key_before, text_before, key_after in portions(batches, ["key", "s1", "s2"], AT_ONCE):
        key, s1, s2 = (rows.column(c).to_numpy() for c in ("key", "s1", "s2"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        n = np.bincount(group, rows.column("n").to_numpy(), len(first)).astype(np.int64)
        n[0] += text_before
        again = np.zeros(len(first), bool)
        np.logical_or.at(again, group, rows.column("again").to_numpy(zero_copy_only=False))
        of_key = np.cumsum(np.append(True, key[first][1:] != key[first][:-1])) - 1
        size = rows.column("size").to_numpy()
        apart = ((of_key == 0) & key_before) | ((of_key == of_key[-1]) & key_after)
        # A task may hold MANY_STRINGS strings of a key, some 120 MB; keys of more are dealt by string.
        long = np.bincount(of_key, size[first])[of_key] > MANY_STRINGS
        count = np.bincount(of_key)[of_key]
        texts = np.where(apart | long, MANY + 1, count)
        full = np.flatnonzero(n[group] > 1)
        place, each = unpacked(rows.column("places"), full)
        one = (count > 1) | again | apart
        one[0] &= not text_before
        ragged = first[one]
        head, head_n = unpacked(rows.column("places"), ragged)
        head = head[np.cumsum(head_n) - head_n]
        columns = [np.concatenate([place[c], head[c]]) for c in ("t1", "t2", "start")]
        columns += [np.concatenate([np.repeat(size[full], each), size[ragged]]), np.concatenate([np.repeat(key[full], each), key[ragged]])]
        columns += [np.concatenate([np.zeros(len(place), np.int64), texts[group[ragged]]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t1", "t2", "start", "size", "key", "texts"])


SPANS = "key long, w2 long, size int, bytes binary, places binary"
PACKED = "bucket int, packed binary"
SPAN = np.dtype([("t1", "<i8"), ("t2", "<i8"), ("start", "<i4"), ("size", "<i4")])


def grouped(new: np.ndarray, values: np.ndarray) -> pa.Array:
    """Records of a sorted array packed into one binary value for each group; new marks the first of each."""
    bounds = np.append(np.flatnonzero(new), len(values))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.dtype.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def spans(length: int, kind: np.dtype):
    """Rows of (t1, t2, text, runs) to the texts of the runs.

    Runs of keys with very many texts become their single strings instead, equal
    ones of a block in one row, dealt by their own hash.
    """

    def texts(parts: list[tuple]) -> pa.RecordBatch:
        places = np.array([(t1, t2, r["start"]) for t1, t2, r, _ in parts], PLACE)
        columns = [pa.array([r["key"] for _, _, r, _ in parts], pa.int64()), pa.array(np.zeros(len(parts), np.int64)), pa.array([r["size"] for _, _, r, _ in parts], pa.int32())]
        columns += [pa.array([d.tobytes() for *_, d in parts], pa.binary()), grouped(np.ones(len(parts), bool), places)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "w2", "size", "bytes", "places"])

    def strings(parts: list[tuple]) -> pa.RecordBatch:
        size = np.array([r["size"] for _, _, r, _ in parts])
        lengths = np.array([len(d) for *_, d in parts])
        row = np.repeat(np.arange(len(parts)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        at = (np.cumsum(lengths) - lengths)[row] + step
        hashed = Hashed(np.concatenate([d for *_, d in parts]))
        w1, w2 = hashed.at(0, at, at + length), hashed.at(1, at, at + length)
        place = np.array([(t1, t2, r["start"]) for t1, t2, r, _ in parts], PLACE)[row]
        place["start"] += step.astype(np.int32)
        order = np.lexsort((w2, w1))
        w1, w2, place = w1[order], w2[order], place[order]
        new = np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))
        n = int(new.sum())
        return pa.RecordBatch.from_arrays([pa.array(w1[new].view(np.int64)), pa.array(w2[new].view(np.int64)), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.binary()), grouped(new, place)], names=["key", "w2", "size", "bytes", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, many, held = [], [], [0, 0]
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                for t1, t2, text, runs in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "runs")), strict=True):
                    data = np.frombuffer(units(text, kind), kind)
                    for r in runs:
                        own = data[r["start"] : r["start"] + r["size"] - 1 + length]
                        which = r["texts"] > MANY
                        (many if which else few).append((t1, t2, r, own))
                        held[which] += len(own)
                        if held[which] > BLOCK:
                            yield strings(many) if which else texts(few)
                            (many if which else few).clear()
                            held[which] = 0
        if few:
            yield texts(few)
        if many:
            yield strings(many)

    return run


def twice(*keys: np.ndarray) -> np.ndarray:
    """Which entries have another one with equal keys."""
    order = np.lexsort(keys)
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def resolved(length: int, buckets: int, kind: np.dtype):
    """Starts of strings that are found twice among the rows of a key, as runs packed for buckets of documents."""

    def of_texts(rows: pa.Table) -> np.ndarray:
        key, size = rows.column("key").to_numpy(), rows.column("size").to_numpy()
        data = rows.column("bytes").to_pylist()
        lengths = np.fromiter(map(len, data), np.int64, len(data)) // kind.itemsize
        place, _ = unpacked(rows.column("places"), np.arange(len(rows)))
        row = np.repeat(np.arange(len(key)), size)
        step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        hashed = Hashed(np.frombuffer(b"".join(data), kind))
        at = (np.cumsum(lengths) - lengths)[row] + step
        found = np.flatnonzero(twice(hashed.at(1, at, at + length), hashed.at(0, at, at + length), key[row]))
        head = np.append(True, (found[1:] != found[:-1] + 1) | (row[found[1:]] != row[found[:-1]])) if len(found) else np.zeros(0, bool)
        first = found[head]
        out = np.empty(len(first), SPAN)
        out["t1"], out["t2"], out["start"] = place["t1"][row[first]], place["t2"][row[first]], place["start"][row[first]] + step[first]
        out["size"] = np.diff(np.append(np.flatnonzero(head), len(found)))
        return out

    def of_strings(rows: pa.Table, before: bool) -> np.ndarray:
        place, each = unpacked(rows.column("places"), np.arange(len(rows)))
        key, w2 = rows.column("key").to_numpy(), rows.column("w2").to_numpy()
        again = twice(w2, key) | (each > 1) | (before & (key == key[0]) & (w2 == w2[0]))
        place = place[np.repeat(again, each)]
        out = np.empty(len(place), SPAN)
        out["t1"], out["t2"], out["start"], out["size"] = place["t1"], place["t2"], place["start"], 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, text_before, _ in portions(batches, ["key", "w2"], SPANS_AT_ONCE, "bytes"):
            single = rows.column("bytes").is_null()
            texts, strings = rows.filter(pc.invert(single)), rows.filter(single)
            found = np.concatenate([np.empty(0, SPAN), *([of_texts(texts)] if len(texts) else []), *([of_strings(strings, text_before)] if len(strings) else [])])
            if len(found):
                bucket = (found["t1"].astype(np.uint64) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order].astype(np.int32)
                new = np.append(True, bucket[1:] != bucket[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[new]), grouped(new, found[order])], names=["bucket", "packed"])

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs of a bucket's documents to joined runs; rows come sorted by bucket."""

    def joined(parts: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(parts), SPAN)
        x = x[np.lexsort((x["start"], x["t2"], x["t1"]))]
        own = np.append(True, (x["t1"][1:] != x["t1"][:-1]) | (x["t2"][1:] != x["t2"][:-1]))
        # Ends grow along a document's runs once each document is lifted above the ones before.
        lift = np.cumsum(own) * (1 << 32)
        begin, reach = x["start"] + lift, np.maximum.accumulate(x["start"].astype(np.int64) + x["size"] + lift)
        head = np.append(True, own[1:] | (begin[1:] > reach[:-1]))
        first = np.flatnonzero(head)
        size = reach[np.append(first[1:], len(x)) - 1] - begin[first]
        return pa.RecordBatch.from_arrays([*(pa.array(x[c][first]) for c in ("t1", "t2", "start")), pa.array(size.astype(np.int32))], names=["t1", "t2", "start", "size"])

    now, parts = None, []
    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if bucket != now and parts:
                yield joined(parts)
                parts = []
            now = bucket
            parts.append(packed)
    if parts:
        yield joined(parts)


def removed(starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed spans [begin, end) that runs of repeated starts cover."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order].astype(np.int64), (starts[order] + sizes[order]).astype(np.int64) - 1 + length
    reach = np.maximum.accumulate(end)
    head = np.append(True, begin[1:] > reach[:-1])
    return begin[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(begin) - 1)]


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    inside = np.concatenate([[False], ~WHITE[np.frombuffer(data, np.uint8)], [False]])
    return np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1


def gone_of(data: bytes, runs: list[dict], copied: bool, length: int, words: int | None) -> list[tuple[int, int]]:
    """Spans of bytes that repeated strings and repeated passages of words cover; all of a copied text's are."""
    begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if copied and len(data) >= length:
        return [(0, len(data))]
    for by_word in (False, True) if words else (False,):
        own = [r for r in runs if r["by_word"] == by_word]
        first, last = word_edges(data) if by_word and (own or copied) else (begin[0], end[0])
        if own:
            a, b = removed(np.array([r["start"] for r in own]), np.array([r["size"] for r in own]), words if by_word else length)
            begin.append(first[a] if by_word else a)
            end.append(last[b - 1] if by_word else b)
        if by_word and copied and len(first) >= words:
            begin.append(first[:1])
            end.append(last[-1:])
    a, b = np.concatenate(begin), np.concatenate(end)
    if not len(a):
        return []
    a, b = removed(a, b - a, 1)
    return list(zip(a.tolist(), b.tolist(), strict=True))


GONE = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
OWN = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])))]


def cleaned(length: int, as_text: bool, words: int | None, apart: bool):
    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5 if apart else 4)]
        for text, runs, copied in zip(*(batch.column(c).to_pylist() for c in ("__text", "__runs", "__copied")), strict=True):
            data = (text or "").encode()
            gone = gone_of(data, runs or [], bool(copied), length, None if apart else words)
            edges = [0, *[x for g in gone for x in g], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            row = [len(data), len(data) - len(kept), named(gone), kept.decode(errors="ignore") if as_text else kept]
            if apart:
                row.append(named(gone_of(data, runs or [], bool(copied), length, words)))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        types, names = [pa.int64(), pa.int64(), GONE, pa.string() if as_text else pa.binary()], ["n_bytes", "n_removed", "spans", "kept"]
        if apart:
            types, names = [*types, GONE], [*names, "passages"]
        kept = batch.drop_columns(["__text", "__runs", "__copied"])
        return pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, out, types)], names=[*kept.schema.names, *names])

    def named(spans: list[tuple[int, int]]) -> list[dict]:
        return [{"begin": a, "end": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text", BATCH_BYTES):
                yield block(batch)

    return run


def repeated(rows: DataFrame, length: int, kind: np.dtype, n_buckets: int) -> DataFrame:
    """(t1, t2, start, size) of the repeated starts of rows of (t1, t2, text), in units of that kind."""
    rows = rows.where(F.octet_length("text") >= (length if kind == BYTE else 2 * length - 1))
    runs = rows.mapInArrow(tidy(scan(length, kind)), RUNS)
    found = cut(runs.repartition("key").sortWithinPartitions("key", "s1", "s2").mapInArrow(tidy(classified), FOUND))
    ragged = found.where("texts > 0").groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "size", "key", "texts")).alias("runs"))
    # One of equal texts is enough, and fewer before the join than after it: no text is too common for one task.
    pieces = rows.dropDuplicates(["t1", "t2"]).join(ragged, ["t1", "t2"]).select("t1", "t2", "text", "runs").mapInArrow(tidy(spans(length, kind)), SPANS)
    edges = pieces.repartition("key").sortWithinPartitions("key", "w2").mapInArrow(tidy(resolved(length, n_buckets, kind)), PACKED)
    edges = edges.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(merged), "t1 long, t2 long, start int, size int")
    return found.where("texts = 0").select("t1", "t2", "start", "size").unionByName(edges)


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH, as_text: bool = False, words: int | None = None, apart: bool = False) -> DataFrame:
    """Every row of docs with n_bytes, n_removed, spans (array of begin, end) and kept.

    keep names the columns passed through, all but the text if absent; they may not have
    the names that are added. kept is binary; as_text makes it a string, without the bytes of
    characters that were cut apart. With words, repeated passages of that many words go too,
    whatever white space is between the words; with apart they stay, and one column more, passages, has
    the spans that strings and passages cover together.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    small_batches(docs.sparkSession)
    value = F.coalesce(F.col(text), F.lit(""))
    # Texts are named by 128 bits of hash: rows need no id of their own.
    t1, t2 = F.xxhash64(value).alias("t1"), F.xxhash64(F.lit(2), value).alias("t2")
    rows = docs.select(t1, t2, value.alias("text"))
    names = cut(docs.select(t1, t2).groupBy("t1", "t2").agg((F.count("*") > 1).alias("copied")))
    n_buckets = blocks(names.count(), TEXTS_PER_BUCKET)
    repeats = repeated(rows, length, BYTE, n_buckets).withColumn("by_word", F.lit(False))
    if words is not None:
        # One after the other, each one's shuffle files deleted before what follows: the two and the last join never hold memory or disk at once.
        repeats = cut(repeats)
        release(docs.sparkSession, told=True)
        repeats = repeats.unionByName(cut(repeated(rows, words, WORD, n_buckets).withColumn("by_word", F.lit(True))))
        release(docs.sparkSession, told=True)
    repeats = repeats.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "size", "by_word")).alias("runs"))
    marks = names.where("copied").join(repeats, ["t1", "t2"], "full").select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("runs").alias("__runs"), F.col("copied").alias("__copied"))
    whole = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], value.alias("__text"), t1.alias("__t1"), t2.alias("__t2"))
    whole = whole.join(marks, NAME, "left").drop(*NAME)
    fields = [T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    more = [T.StructField("passages", OWN[-1].dataType)] if apart else []
    out = whole.mapInArrow(tidy(cleaned(length, as_text, words, apart)), T.StructType([*fields, *OWN, T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *more]))
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "spans", "kept", *[m.name for m in more])


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated strings and passages of over 50 words of their texts; n_chars, where there is one, follows."""
    others = [c for c in docs.columns if c != "text"]
    found = remove_repeats(docs, as_text=True, words=WORDS)
    found = found.toDF(*[f"__{i}" for i in range(len(others))], "n_bytes", "n_removed", "spans", "kept")
    place = {c: F.col(f"__{i}") for i, c in enumerate(others)} | {"text": F.col("kept")}
    if "n_chars" in place:
        place["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*[place[c].alias(c) for c in docs.columns])


def op10_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated 400-byte strings, and how many bytes these and repeated passages of over 50 words cover."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], words=WORDS, apart=True)
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    own = found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passages")
    return own.withColumns({"n_repeated": size(F.col("passages")), "n_passages": F.size("passages").cast("long")}).drop("passages")
