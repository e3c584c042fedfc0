"""Texts with a Jaccard similarity of 0.8 or more over five-word shingles.

Candidates come from two indexes over the distinct sets of shingles:

* SimHash: fingerprints of the sets that differ in at most four bits, by the deletion
  variants of simhash.py. At a similarity of 0.8 fingerprints differ in some ten bits,
  so this finds the close copies only.
* Prefixes: two sets of similarity 0.8 share one of the first n - ceil(0.8 n) + 1
  shingles of each, in any order that is the same for all sets. Sets are dealt to
  buckets by all those shingles. The order puts shingles that are common in a sample of
  the texts last; the sample decides how full buckets get, never what is found.

In a bucket each set first meets the one with the smallest name, so a group of many
near copies costs as many tests as it has members. Then all pairs of a bucket are tested
that are not yet in one component; buckets of one component leave before that. Two bounds, which every pair of
similarity 0.8 meets, leave pairs out without their texts:

* Sets of n and m shingles share 4 (n + m) / 9 of them, so the first one they share has at least that many
  after it in both, itself included (may_link). That holds the sizes together as well.
* Their other shingles are (n + m) / 9 at most. Each set has BITS bits, each the parity of the number of its
  shingles there; two sets differ in no more bits than they have other shingles. Before a pair meets its texts
  the same is tested on two bits a shingle and more, since BITS say little of long texts.

Buckets are cut into chunks of CROWD sets, whose pairs are cells of their own, and give the pairs that are
left, which meet their texts like those before. Dense buckets, of more than SMALL sets with a cell that has more than SMALL / 16
such pairs a set, come again with all bits. To those that still are dense the sets themselves go, each pair is tested in the first bucket it shares, and a forest of links comes
out. Every link is tested on the whole sets.

Sets are told apart by 64-bit hashes, texts by 128 bits. A text of at most five words is one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.bpe import slices
from tracelake.llm.common import blocks, components, cut, equal_runs, roots, small_batches, thin, tidy

SHINGLE, SEED, BITS = 5, 42, 512
SAMPLE_DOCS, COMMON, MOST_COMMON = 20_000, 8, 100_000
BLOCK_BYTES, CELL_BYTES, SMALL, CROWD, CHUNK_SHINGLES, CACHE_SHINGLES, BROADCAST_NAMES = 1_000_000, 8_000_000, 128, 2_048, 200_000, 2_000_000, 500_000
#: Pairs meet their texts in rounds of that many, up to so many rounds; beyond, rounds grow to MOST_PAIRS, which ask for so few texts
#: that their names are broadcast and only those texts are shuffled. Keys and rows of buckets likewise, in up to ROUNDS rounds.
PAIRS_A_ROUND, ROUNDS, MOST_PAIRS = 100_000, 8, 250_000
KEYS_A_ROUND, ROWS_A_ROUND = 4_000_000, 1_000_000


def shingle_hashes(text: str | None, n: int) -> list[int]:
    """XXH64 of each n-word shingle of the lower-cased text, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return [hashed(line, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - n]]]
    return [hashed(line[a:b], SEED) for a, b in zip(starts, ends[n - 1 :], strict=True)]


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """The shingles found in the most texts of a sample of bounded size, rarer first; only those of the lowest
    quarter of hashes, since a set is found by its lowest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
                every = np.concatenate(sets)
                yield pa.RecordBatch.from_arrays([pa.array(every[every < np.uint64(1 << 62)].view(np.int64))], names=["shingle"])

    each = max(1, math.ceil(texts.count() / SAMPLE_DOCS))
    sample = texts.where(F.pmod("t1", F.lit(each)) == 0).dropDuplicates(["t1", "t2"]).select("text")
    count = sample.mapInArrow(tidy(run), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = count.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()
    return np.array([r["shingle"] for r in reversed(rows)], np.int64).view(np.uint64)


def keys_of(own: np.ndarray, values: np.ndarray, rank_of: np.ndarray) -> np.ndarray:
    """The shingles of a set that it is found by, in the order of all sets: so many that no similar set shares none."""
    if not len(own):
        return own
    rank = np.zeros(len(own), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        rank = np.where(values[at] == own, rank_of[at] + 1, 0)
    return own[np.lexsort((own, rank))][: len(own) - (4 * len(own) + 4) // 5 + 1]


def parities(own: np.ndarray) -> np.ndarray:
    """BITS bits, doubled until they are two a shingle: the parity of the number of shingles at each place, which the hash gives."""
    size = BITS
    while size < 2 * len(own):
        size *= 2
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parities at so many words' places."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def with_sets(texts: DataFrame, common: np.ndarray, fingerprints) -> DataFrame:
    """(id, t1, t2, node, n, fp, bits, wide, keys): name, size, fingerprint and parities, few and all, of each text's set and what it is found by."""
    rank_of = np.argsort(common)
    values = common[rank_of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                found = pa.array([keys_of(s, values, rank_of).view(np.int64) for s in sets], pa.list_(pa.int64()))
                fp = fingerprints(sets).view(np.int64)
                odd = [parities(s) for s in sets]
                bits, wide = (pa.array(x, pa.list_(pa.int64())) for x in ([folded(w, BITS // 64) for w in odd], odd))
                kept = batch.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), bits, wide, found], names=[*kept.schema.names, "node", "n", "fp", "bits", "wide", "keys"])

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(tidy(run), f"id {id_type}, t1 long, t2 long, node long, n long, fp long, bits array<long>, wide array<long>, keys array<long>")


def may_link(n: Column, m: Column, at: Column, other: Column) -> Column:
    """Whether sets of n and m shingles can be similar if the first one they share is at those places in their keys."""
    return (9 * (n - at) >= 4 * (n + m)) & (9 * (m - other) >= 4 * (n + m))


def near_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose parities differ in as few bits as those of similar sets do."""
    for batch in batches:
        most = batch.column("n").to_numpy() + batch.column("m").to_numpy()
        differ = np.zeros(batch.num_rows, np.int64)
        for row, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = (w.values.to_numpy() for w in (x, y))
            size = min(len(x), len(y))
            differ[row] = np.bitwise_count((folded(x, size) ^ folded(y, size)).view(np.uint64)).sum(dtype=np.int64)
        yield batch.select(["a", "b"]).filter(pa.array(9 * differ <= most, pa.bool_()))


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that parities do not show to differ."""
    own = nodes.select("node", "n", "wide")
    both = pairs.join(own.toDF("a", "n", "x"), "a").join(own.toDF("b", "m", "y"), "b")
    return both.mapInArrow(tidy(near_bits), "a long, b long")


def whole_cells(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by cell in tables of about that many bytes, cut between cells."""
    parts: list[pa.Table] = []
    for whole in batches:
        for batch in thin(whole, most):
            parts.append(pa.Table.from_batches([batch]))
            if sum(p.nbytes for p in parts) >= most:
                rows = pa.concat_tables(parts).combine_chunks()
                cell = rows.column("cell").to_numpy()
                at = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
                if at:
                    yield rows.slice(0, at)
                parts = [rows.slice(at).combine_chunks()]
    if parts:
        yield pa.concat_tables(parts).combine_chunks()


def fitting(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with equal cells, in different components, that may be similar; of a cell of two chunks, pairs across them."""
    cell, n, at, own, mine = (rows.column(c).to_numpy() for c in ("cell", "n", "at", "component", "mine"))
    within = rows.column("within").to_numpy(zero_copy_only=False)
    bits = [x.values.to_numpy().view(np.uint64) for x in rows.column("bits")]
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    alike_at = {}  # by width: the rows' places and bits
    for size in np.unique(width).tolist():
        held = np.flatnonzero(width >= size)
        place = np.zeros(len(bits), np.int64)
        place[held] = np.arange(len(held))
        alike_at[size] = place, np.stack([folded(bits[k], size) for k in held])
    for i, j in equal_runs(cell):
        shared = 4 * (n[i] + n[j])
        keep = (own[i] != own[j]) & (within[i] | (mine[i] != mine[j])) & (9 * (n[i] - at[i]) >= shared) & (9 * (n[j] - at[j]) >= shared)
        i, j = i[keep], j[keep]
        least = np.minimum(width[i], width[j])
        for size in np.unique(least).tolist():
            p, q = i[least == size], j[least == size]
            place, held = alike_at[size]
            for begin in range(0, len(p), step := max(1, 1_000_000 // size)):
                x, y = p[begin : begin + step], q[begin : begin + step]
                keep = 9 * np.bitwise_count(held[place[x]] ^ held[place[y]]).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
                yield x[keep], y[keep]


def edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], names=["a", "b"])


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of each cell that may be similar; of a crowded bucket with very many of them in a cell its key alone."""
    for rows in whole_cells(batches, CELL_BYTES):
        cell, node, size = (rows.column(c).to_numpy() for c in ("cell", "node", "size"))
        which = np.cumsum(np.append(0, cell[1:] != cell[:-1]))
        most = np.bincount(which) * SMALL // 16
        most[which[size <= SMALL]] = len(node) * SMALL
        count, a, b = np.zeros(len(most), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in fitting(rows):
            count += np.bincount(which[i], minlength=len(most))
            keep = (count <= most)[which[i]]
            a.append(i[keep])
            b.append(j[keep])
        i, j = np.concatenate(a), np.concatenate(b)
        keep = (count <= most)[which[i]]
        i, j = i[keep], j[keep]
        dense = np.unique(rows.column("key").to_numpy()[(count > most)[which] & (size > SMALL)])
        pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
        none, no_key = pa.nulls(len(dense), pa.int64()), pa.nulls(pairs.shape[1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(pairs[k]), none]) for k in (0, 1)] + [pa.concat_arrays([no_key, pa.array(dense)])], names=["a", "b", "key"])


def bits_of(lists: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each list: which of the values that several lists have it has."""
    value, count = np.unique(np.concatenate(lists), return_counts=True)
    value = value[count > 1]
    out = np.zeros((len(lists), -(-max(1, len(value)) // 64)), np.uint64)
    for row, own in zip(out, lists, strict=True):
        at = np.flatnonzero(np.isin(value, own, assume_unique=True))
        np.bitwise_or.at(row, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return out


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest (a, b) over the similar sets of each cell."""

    def forest(rows: pa.Table) -> pa.RecordBatch:
        node, n, at = (rows.column(c).to_numpy() for c in ("node", "n", "at"))
        found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        shingles = earlier = None
        for i, j in fitting(rows):
            if len(i) and shingles is None:
                shingles = bits_of([np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()])
                earlier = bits_of([np.array(k[:place], np.int64) for k, place in zip(rows.column("keys").to_pylist(), at.tolist(), strict=True)])
            for begin in range(0, len(i), step := max(1, 1_000_000 // (shingles.shape[1] if len(i) else 1))):
                p, q = i[begin : begin + step], j[begin : begin + step]
                first = ~(earlier[p] & earlier[q]).any(axis=1)
                p, q = p[first], q[first]
                shared = np.bitwise_count(shingles[p] & shingles[q]).sum(axis=1, dtype=np.int64)
                near = 5 * shared >= 4 * (n[p] + n[q] - shared)
                found = np.append(found[0], p[near]), np.append(found[1], q[near])
        top = roots(len(node), *found)
        edge = np.flatnonzero(top != np.arange(len(node)))
        return edges([node[edge]], [node[top[edge]]])

    for rows in whole_cells(batches, BLOCK_BYTES):
        cell = rows.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield forest(rows.slice(begin, end - begin).combine_chunks())


def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets have 0.8 of their union in common."""
    known: dict[str, np.ndarray] = {}
    held = 0

    def of(text: str) -> np.ndarray:
        nonlocal held
        if text not in known:
            if held > CACHE_SHINGLES:
                known.clear()
                held = 0
            known[text] = shingle_set(text)
            held += len(known[text])
        return known[text]

    for whole in batches:
        for batch in slices(whole, "x", BLOCK_BYTES):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.sort(np.concatenate([of(x), of(y)]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(5 * shared >= 4 * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def texts_of(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the asked nodes, one of their texts each."""
    names = cut(nodes.join(asked, "node", "left_semi").select("node", "text.*"))
    # Three numbers a row: broadcast only while few; beyond, Spark joins by shuffle.
    names = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    return texts.select("t1", "t2", "text").join(names, ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", BLOCK_BYTES):
            # 32 bits of each hash tell the shingles of two sets apart, and halve what is moved.
            sets = [np.unique(shingle_set(t) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])


def tested(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar. pairs should be a checkpoint.

    A text is shuffled once for each of its pairs that the parities leave, so the pairs are tested in rounds, and what one
    round shuffled is deleted before the next shuffles.
    """
    count = pairs.count()
    rounds = max(min(ROUNDS, blocks(count, PAIRS_A_ROUND)), blocks(count, MOST_PAIRS))
    parts = [pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k) for k in range(rounds)]
    return reduce(DataFrame.unionByName, [tested_at_once(p, nodes, texts) for p in parts])


def tested_at_once(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    pairs = cut(alike(pairs, nodes))
    own = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts)
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(tidy(similar), "a long, b long"), told=True)


def in_rounds(rows: DataFrame, rounds: int, run) -> DataFrame:
    """What run makes of the rows, whole keys at a time; what a round shuffled is deleted before the next one."""
    parts = [cut(run(rows.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)), told=True) for k in range(rounds)]
    return reduce(DataFrame.unionByName, parts)


def buckets_of(nodes: DataFrame) -> DataFrame:
    """(key, size, node, n, at, first): each set in the buckets of its keys, at being the key's place; buckets of two and more sets."""

    def run(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition("key")  # one shuffle for both sides of the join
        full = dealt.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n", "at")).alias("first")).where("size > 1")
        return dealt.join(full, "key")

    keys = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    return in_rounds(nodes.select(F.posexplode("keys").alias("at", "key"), "node", "n"), min(ROUNDS, blocks(keys, KEYS_A_ROUND)), run)


def in_cells(rows: DataFrame, chunks: Column) -> DataFrame:
    """Each row in the cells of its bucket: one for each pair of its chunks, and for each chunk itself."""
    dealt = rows.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1L)")))
    cell = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.withColumns({"cell": cell, "within": F.col("mine") == F.col("other")}).drop("chunks", "other")


def links(nodes: DataFrame, texts: DataFrame, near_links) -> DataFrame:
    """Edges (a, b) that connect all nodes with similar sets; nodes has node, n, fp, bits, wide, keys and text, the (t1, t2) of a text."""
    # Fingerprints: each set with the first of its fingerprint, and those with the first ones of fingerprints nearby.
    slim = nodes.select("node", "fp")
    heads = cut(slim.groupBy("fp").agg(F.min("node").alias("head")))
    close = near_links(heads.select("fp")).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    close = close.unionByName(slim.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")))
    # Prefixes: buckets of two and more sets, each set with the first one.
    buckets = buckets_of(nodes)
    stars = buckets.where((F.col("node") != F.col("first.node")) & may_link(F.col("n"), F.col("first.n"), F.col("at"), F.col("first.at")))
    stars = stars.select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    pairs = cut(close.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), told=True)
    near = tested(pairs, nodes, texts)
    own = components(near).select("node", "component")
    rest = buckets.select("key", "size", "node", "n", "at").join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rest = cut(rest.join(mixed, "key", "left_semi"))

    def compared(rows: DataFrame, bits: str) -> tuple[DataFrame, DataFrame]:
        own = nodes.select("node", F.col(bits).alias("bits"))

        def run(part: DataFrame) -> DataFrame:
            cells = in_cells(part.join(own, "node"), F.ceil(F.col("size") / CROWD))
            return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(across), "a long, b long, key long").distinct()

        found = in_rounds(rows, min(ROUNDS, blocks(rows.count(), ROWS_A_ROUND)), run)
        return found.where("key is null").select("a", "b"), found.where("key is not null").select("key").distinct()

    few, dense = compared(rest, "bits")
    if not dense.isEmpty():
        many = cut(rest.join(dense, "key", "left_semi"))
        more, dense = compared(many, "wide")
        few = few.unionByName(more)
    near = near.unionByName(tested(cut(few.distinct().join(pairs, ["a", "b"], "left_anti"), told=True), nodes, texts))
    if dense.isEmpty():
        return near
    many = cut(many.join(dense, "key", "left_semi"))
    crowd = many.groupBy("key").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).alias("most"))
    cells = in_cells(many.join(crowd, "key"), F.col("most")).drop("most", "size")
    sets = texts_of(many.select("node").distinct(), nodes, texts).mapInArrow(tidy(sets_of), "node long, shingles binary")
    cells = cells.join(sets.join(nodes.select("node", "bits", "keys"), "node"), "node")
    crowded = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(linked), "a long, b long")
    return near.unionByName(cut(crowded, told=True))


def first_of_groups(docs: DataFrame, doc_id: str, text: str, fingerprints, near_links) -> DataFrame:
    """(id, t1, t2) of the row with the smallest id (null first; ties by hash) of each group of near copies."""
    small_batches(docs.sparkSession)
    value = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(value).alias("t1"), F.xxhash64(F.lit(2), value).alias("t2"), value.alias("text"))
    sets = with_sets(texts, common_shingles(texts), fingerprints)
    nodes = sets.groupBy("node").agg(F.min(F.struct("id", "t1", "t2")).alias("least"), F.min(F.struct("t1", "t2")).alias("text"), F.min(F.struct("n", "fp", "bits", "wide", "keys")).alias("set"))
    nodes = cut(nodes.select("node", "least", "text", "set.*"))
    found = components(links(nodes, texts, near_links))
    nodes = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return nodes.groupBy("component").agg(F.min("least").alias("least")).select("least.*")
