"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class). Frequent words and the
end of a text are classes of their own; other words are classed by their last
bytes. P(class | history) is a softmax over n-gram and skip features of the
history's classes (the class before, the one before that, and both together),
hashed to rows of one weight matrix. P(word | class, history) is a softmax over
the class's words. Its prior is the word's share of the class's training tokens
after absolute discounting (the discounted mass belongs to the class's unseen
words). Its features are pairs of a frequent word and this word: n-grams if the
word before is frequent or the text starts here, else skips if the one before
that is. Every pair seen in training has a weight of its own, named by a hash,
so the weights grow with the corpus. A pair without a weight has weight zero, so
the normaliser needs the seen pairs of a row (frequent word, class) only, and
all sums to one.

All counts cover all training documents. Documents are dealt to blocks of about
a thousand, or fewer if they are long. A block's distinct words travel as packed arrays of word hashes, by
shards of the hash, whose number grows with the blocks; a shard adds up the
counts of all blocks and sends each block the corpus counts of its words back.
So no vocabulary is gathered in one place. Counts of class trigrams (at most CLASSES ** 3 numbers) are the training
set; every gradient step is a sum over tasks that each hold a share of the
histories. Scoring gathers from arrays, a block at a time. Pairs travel packed
with their places in the block's documents, by shards of their rows; a shard
adds the pairs up, fits a row's weights by gradient steps, which no other row
concerns, and sends each block what its documents gain or lose.

Words are told apart by 64-bit hashes. Defined cases: null text counts as empty
and is scored as an end only; an unseen word has count zero; without training
documents the base score of every token is zero and the model knows no word;
repeated rows are documents of their own; a null id hashes as empty text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.bpe import slices
from tracelake.llm.common import blocks, crc_mod, cut, release, small_batches, table, tidy

CLASSES, OWN = 128, 63  # class 0: end; 1..OWN: one word each; the rest: by last bytes
SHAPES = CLASSES - OWN - 1
PAIR_ROWS = 2048
ROWS = 1 + 2 * CLASSES + PAIR_ROWS
DOCS_PER_BLOCK, BLOCKS_PER_SHARD, LEAST_SHARDS, GROUPS, COUNT_TASKS, STEP_TASKS = 1024, 4, 64, 256, 4096, 4
STEPS, RATE, RIDGE = 30, 0.25, 1e-7
BLOCK_BYTES, DOC_BYTES = 2_000_000, 4_000_000  # in a slice; of a block's documents
PAIR_BLOCKS_PER_SHARD, HASH_BITS = 8, 49
PAIR_RIDGE, PAIR_STEPS = 0.5, 40
ADDED = 0.1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shape(word: bytes) -> int:
    """Class of a word that has none of its own."""
    return OWN + 1 + xxhash.xxh32_intdigest(word[-3:]) % SHAPES


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def sorted_words(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of distinct words in the order they are packed in (shard, then hash), and that order."""
    h = hashes(words)
    order = np.lexsort((h, h % np.uint64(shards)))
    return h[order], order


def packed(shards: int):
    """Rows sorted by block to (block, shard, words, counts, shapes), packed; counts are of training documents."""

    def rows(block: int, seen: Counter) -> pa.RecordBatch:
        words = list(seen)
        h, order = sorted_words(words, shards)
        n = np.fromiter(seen.values(), np.uint32, len(words))[order]
        kind = np.fromiter(map(shape, words), np.uint8, len(words))[order]
        shard = (h % np.uint64(shards)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(h)]
        parts = [(int(shard[a]), h[a:b].tobytes(), n[a:b].tobytes(), kind[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int64()), *(pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary())))], names=["block", "shard", "words", "counts", "shapes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, Counter()
        for batch in batches:
            for block, train, text in zip(*(batch.column(c).to_pylist() for c in ("block", "train", "text")), strict=True):
                if block != now:
                    if seen:
                        yield rows(now, seen)
                    now, seen = block, Counter()
                words = words_of(text)
                if train:
                    seen.update(words)
                else:
                    for w in words:
                        if w not in seen:
                            seen[w] = 0
        if seen:
            yield rows(now, seen)

    return run


SUMMED = "block long, shard long, counts binary, top binary, per_class binary"


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: corpus counts for each block (packed as its words are), and for each
    shard (block null) its OWN most frequent words and per class: tokens, words, words seen once, twice."""
    def rows(shard: int, parts: list[tuple]) -> pa.RecordBatch:
        h = np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts])
        n = np.concatenate([np.frombuffer(p[2], np.uint32) for p in parts])
        kind = np.concatenate([np.frombuffer(p[3], np.uint8) for p in parts])
        word, first, at = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(at, n, len(word)).astype(np.int64)
        kind = kind[first]
        per = np.stack([np.bincount(kind, x, CLASSES) for x in (total, total > 0, total == 1, total == 2)]).astype(np.int64)
        best = np.lexsort((word, -total))[:OWN]
        top = np.zeros(len(best), TOP)
        top["n"], top["word"], top["shape"] = total[best], word[best], kind[best]
        sizes = np.cumsum([len(p[1]) // 8 for p in parts])[:-1]
        back = [x.astype(np.int64).tobytes() for x in np.split(total[at], sizes)]
        return pa.RecordBatch.from_arrays([pa.array([*(p[0] for p in parts), None], pa.int64()), pa.array([shard] * (len(parts) + 1), pa.int64()), pa.array([*back, None], pa.binary()), pa.array([None] * len(parts) + [top[top["n"] > 0].tobytes()], pa.binary()), pa.array([None] * len(parts) + [per.tobytes()], pa.binary())], names=["block", "shard", "counts", "top", "per_class"])

    now, parts = None, []
    for batch in batches:
        for shard, *part in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "words", "counts", "shapes")), strict=True):
            if shard != now:
                if parts:
                    yield rows(now, parts)
                now, parts = shard, []
            parts.append(tuple(part))
    if parts:
        yield rows(now, parts)


TOP = np.dtype([("n", "<i8"), ("word", "<u8"), ("shape", "<i8")])


def best_of(parts: list[np.ndarray]) -> np.ndarray:
    """The OWN most frequent words, ties by hash."""
    top = np.concatenate(parts) if parts else np.empty(0, TOP)
    return top[np.lexsort((top["word"], -top["n"]))][:OWN]


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the shards of a task: their most frequent words and the sums of their totals."""
    tops, totals = [], np.zeros((4, CLASSES), np.int64)
    for batch in batches:
        for top, per in zip(batch.column("top").to_pylist(), batch.column("per_class").to_pylist(), strict=True):
            tops = [best_of([*tops, np.frombuffer(top, TOP)])]
            totals += np.frombuffer(per, np.int64).reshape(4, CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array([best_of(tops).tobytes()], pa.binary()), pa.array([totals.tobytes()], pa.binary())], names=["top", "per_class"])


class Classes:
    """Which class a word is in, remembered up to a bound."""

    def __init__(self, own: dict[int, int]):
        self.own, self.known = own, {}

    def of(self, word: bytes) -> int:
        if len(self.known) > 300_000:
            self.known.clear()
        c = self.own.get(xxhash.xxh64_intdigest(word))
        self.known[word] = c = shape(word) if c is None else c
        return c

    def sequence(self, words: list[bytes]) -> list[int]:
        known, of = self.known, self.of
        return [known[w] if w in known else of(w) for w in words]


def trigrams(own: dict[int, int]):
    """Counts of (class two before, class before, class) over the task's rows, packed by groups of histories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, count = Classes(own), np.zeros(CLASSES**3, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                flat: list[int] = []
                sizes = []
                for text in batch.column("text").to_pylist():
                    kinds = classes.sequence(words_of(text))
                    flat += [0, 0, *kinds, 0]
                    sizes.append(len(kinds) + 3)
                if flat:
                    c = np.array(flat, np.int64)
                    code = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
                    # The last two places of a text would reach into the next one.
                    inside = np.ones(len(c), bool)
                    last = np.cumsum(sizes)
                    inside[last - 1] = inside[last - 2] = False
                    at, n = np.unique(code[inside[:-2]], return_counts=True)
                    count[at] += n
        code = np.flatnonzero(count)
        group = code // CLASSES % GROUPS
        order = np.argsort(group, kind="stable")
        code, cuts = code[order], np.searchsorted(group[order], np.arange(GROUPS + 1))
        parts = [(g, code[a:b].astype(np.uint32).tobytes(), count[code[a:b]].tobytes()) for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["g", "codes", "counts"])

    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts added up; one row for all groups of the task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for codes, counts in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            code, n = np.frombuffer(codes, np.uint32).astype(np.int64), np.frombuffer(counts, np.int64)
            g = int(code[0]) // CLASSES % GROUPS
            if g not in total:
                total[g] = np.zeros(CLASSES**3 // GROUPS, np.int64)
            history = code // CLASSES
            total[g][(history // GROUPS) * CLASSES + code % CLASSES] += n
    for g, n in total.items():
        at = np.flatnonzero(n)
        code = ((at // CLASSES) * GROUPS + g) * CLASSES + at % CLASSES
        yield pa.RecordBatch.from_arrays([pa.array([code.astype(np.uint32).tobytes()], pa.binary()), pa.array([n[at].tobytes()], pa.binary())], names=["codes", "counts"])


def feature_rows(history: np.ndarray) -> np.ndarray:
    """The weight rows of a history (class two before * CLASSES + class before): bias, n-gram, skip, both hashed."""
    far, near = history // CLASSES, history % CLASSES
    both = (history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(PAIR_ROWS)
    return np.stack([np.zeros_like(history), 1 + near, 1 + CLASSES + far, 1 + 2 * CLASSES + both.astype(np.int64)])


def log_softmax(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    x = weights[feature_rows(history)].sum(axis=0)
    x -= x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def gradient(shared):
    """Sum over the task's histories of the log-likelihood's gradient, with the log-likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, np.float64).reshape(ROWS, CLASSES)
        out, value = np.zeros_like(weights), 0.0
        for batch in batches:
            for codes, counts in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                code, n = np.frombuffer(codes, np.uint32).astype(np.int64), np.frombuffer(counts, np.int64).astype(float)
                history, at = np.unique(code // CLASSES, return_inverse=True)
                for a in range(0, len(history), 2048):
                    own = (at >= a) & (at < a + 2048)
                    seen = np.zeros((min(2048, len(history) - a), CLASSES))
                    np.add.at(seen, (at[own] - a, code[own] % CLASSES), n[own])
                    h = history[a : a + 2048]
                    lp = log_softmax(weights, h)
                    value += float((seen * lp).sum())
                    diff = seen - seen.sum(axis=1, keepdims=True) * np.exp(lp)
                    for rows in feature_rows(h):
                        np.add.at(out, rows, diff)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()], pa.binary()), pa.array([value])], names=["g", "value"])

    return run


def train(counts: DataFrame, prior: np.ndarray, tokens: int) -> np.ndarray:
    """Weights after STEPS distributed gradient steps (Adam on the mean log-likelihood)."""
    sc = counts.sparkSession.sparkContext
    weights = np.zeros((ROWS, CLASSES))
    weights[0] = np.log(prior)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    best, kept = -np.inf, weights
    for step in range(1, STEPS + 1):
        shared = sc.broadcast(weights.tobytes())
        # One matrix of fixed size from each of STEP_TASKS tasks.
        parts = counts.mapInArrow(gradient(shared), "g binary, value double").collect()
        shared.destroy()
        value = sum(p["value"] for p in parts)
        if value > best:
            best, kept = value, weights
        g = sum((np.frombuffer(p["g"], np.float32).reshape(ROWS, CLASSES) for p in parts), np.zeros_like(weights)) / max(tokens, 1) - RIDGE * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = RATE * (1 - (step - 1) / STEPS)
        weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return kept


class Model:
    """own: hash of a frequent word to its class; per_class: tokens, words, seen once, seen twice."""

    def __init__(self, own: dict[int, int], per_class: np.ndarray, weights: np.ndarray, tokens: int, words: int):
        self.own, self.tokens, self.words = own, tokens, words
        self.table = np.concatenate([log_softmax(weights, np.arange(a, a + CLASSES)) for a in range(0, CLASSES**2, CLASSES)]).astype(np.float32) / np.float32(np.log(10))
        n, v, once, twice = per_class.astype(float)
        self.n = n
        # Only classes of many words are discounted; a class without words is all unseen.
        self.discount = np.where(np.arange(CLASSES) > OWN, np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.9), 0.0)
        self.unseen = np.where(n > 0, self.discount * v / np.maximum(n, 1), 1.0)

    def shares(self, kind: np.ndarray, count: np.ndarray) -> np.ndarray:
        """P(word | class) without a history, by class and corpus count."""
        share = np.where(count > 0, (count - self.discount[kind]) / np.maximum(self.n[kind], 1), self.unseen[kind])
        return np.where(kind <= OWN, 1.0, share)

    def word_logs(self, kind: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.log10(self.shares(kind, count))

    def base_logs(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADDED) / (self.tokens + ADDED * (self.words + 1)))


SCORED = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: A document of a block, or a shard's pairs in it, or (place, sums) what they add to documents.
MIXED = "block long, shard long, place long, " + SCORED + ", keys binary, seen binary, held binary, prior binary, places binary, sums binary"
PACKED = ["keys", "seen", "held", "prior", "places", "sums"]


def planes(values: np.ndarray) -> bytes:
    """An array byte by byte of its values, so that bytes which hardly vary compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def contexts(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The history's frequent word: the one before (n-gram), else the one before that (skip), else -1."""
    return np.where(near <= OWN, near, np.where(far <= OWN, OWN + 1 + far, -1))


def row_width(shards: int) -> int:
    """Rows (context, class) of a shard."""
    return -(-2 * (OWN + 1) * CLASSES // shards)


def row_codes(context: np.ndarray, kind: np.ndarray, shards: int) -> np.ndarray:
    """Numbers of rows, ordered by shard."""
    row = context * CLASSES + kind
    return row % shards * row_width(shards) + row // shards


def fit_pairs(row: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Natural logs by which each pair's history changes its word's share; rows are sorted.

    Gradient steps on the log-likelihood of n[i] of a row's tokens being word i,
    with a ridge, scaled by the inverse of the curvature, which is a diagonal less
    one product; pairs with n = 0 have no weight.
    """
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    sizes = np.diff(np.append(starts, len(row)))
    wide = lambda x: np.repeat(x, sizes)
    total, seen = wide(np.add.reduceat(n, starts)), n > 0
    with np.errstate(divide="ignore"):
        a = np.where(seen, np.clip(np.log(n / np.maximum(total * prior, 1e-300)), -5, n / PAIR_RIDGE), 0.0)
    for _ in range(PAIR_STEPS):
        part = np.where(seen, prior * np.exp(a), 0.0)
        z = 1 + np.add.reduceat(np.where(seen, part - prior, 0.0), starts)
        part /= wide(z)
        slope = np.where(seen, n - total * part - PAIR_RIDGE * a, 0.0)
        curve = total * part + PAIR_RIDGE
        along = np.add.reduceat(part * slope / curve, starts) / (1 - np.add.reduceat(total * part * part / curve, starts))
        step = np.where(seen, np.clip((slope + total * part * wide(along)) / curve, -1, 1), 0.0)
        a += step
        if np.abs(step).max() < 1e-5:
            break
    z = 1 + np.add.reduceat(np.where(seen, prior * np.expm1(a), 0.0), starts)
    return a - np.log(wide(z))


def mixed(rows: int, schema: pa.Schema, **columns) -> pa.Table:
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def mixed_schema(kind: pa.DataType) -> pa.Schema:
    names = ["block", "shard", "place", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", *PACKED]
    types = [pa.int64()] * 3 + [kind, pa.bool_()] + [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.binary()] * len(PACKED)
    return pa.schema(list(zip(names, types, strict=True)))


def scorer(shared, ends: int, shards: int, pair_shards: int):
    """A block's documents and the corpus counts of its words to scores without pairs, and its pairs."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        model: Model = shared.value
        schema = mixed_schema(docs.schema.field("doc_id").type)
        if not docs.num_rows:
            return schema.empty_table()
        index: dict[bytes, int] = {}
        flat, sizes, known = [], [], index.setdefault
        for text in docs["text"].to_pylist():
            words = words_of(text)
            flat += [known(w, len(index)) for w in words]
            flat.append(-1)
            sizes.append(len(words) + 1)
        words = list(index)
        at, sizes = np.array(flat, np.int64), np.array(sizes)
        del flat
        starts = np.cumsum(sizes) - sizes
        h = hashes(words)
        order = np.lexsort((h, h % np.uint64(shards)))
        # The last entry is the end, which at = -1 finds.
        count, kind = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
        if words:
            count[order] = np.frombuffer(b"".join(counts.sort_by("shard")["counts"].to_pylist()), np.int64)
            kind[:-1] = np.fromiter((c if (c := model.own.get(x)) is not None else shape(w) for x, w in zip(h[order].tolist(), (words[i] for i in order), strict=True)), np.int64, len(words))[np.argsort(order)]
        count[-1] = ends
        c = kind[at]
        near, far = np.append(0, c[:-1]), np.concatenate([[0, 0], c])[: len(c)]
        near[starts] = far[starts] = 0
        far[starts[sizes > 1] + 1] = 0
        shares = model.shares(kind, count)
        logs = model.table[far * CLASSES + near, c] + np.log10(shares)[at]
        block, n = docs["block"][0].as_py(), docs.num_rows
        held = docs["held_out"].to_numpy()
        out = [mixed(n, schema, block=docs["block"], shard=pa.array([-1 - block % pair_shards] * n, pa.int64()), place=pa.array(range(n), pa.int64()), doc_id=docs["doc_id"], held_out=docs["held_out"], n_tokens=pa.array(sizes), n_known=pa.array(np.add.reduceat((count > 0)[at].astype(np.int64), starts)), train_tokens=pa.array([model.tokens] * n, pa.int64()), base_score=pa.array(np.add.reduceat(model.base_logs(count)[at], starts)), score=pa.array(np.add.reduceat(logs, starts)))]
        context = contexts(near, far)
        own = np.flatnonzero((context >= 0) & (c > OWN))
        if len(own):
            word, place = at[own], np.repeat(np.arange(n, dtype=np.uint32), sizes)[own]
            key = row_codes(context[own], c[own], pair_shards).astype(np.uint64) << np.uint64(HASH_BITS) | h[word] >> np.uint64(64 - HASH_BITS)
            order = np.argsort(key, kind="stable")
            key, word, place = key[order], word[order], place[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            times = np.diff(np.append(first, len(key))).astype(np.uint32)
            seen = np.add.reduceat((~held[place]).astype(np.uint32), first, dtype=np.uint32)
            prior, key = shares[word[first]].astype(np.float32), key[first]
            shard = (key >> np.uint64(HASH_BITS)).astype(np.int64) // row_width(pair_shards)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(key)]
            tops = np.append(first, len(place))
            rows = [[planes(x[a:b]) for x in (key, seen, times, prior)] + [planes(place[tops[a] : tops[b]])] for a, b in zip(cuts, cuts[1:], strict=False)]
            columns = {name: pa.array([r[i] for r in rows], pa.binary()) for i, name in enumerate(PACKED[:5])}
            out.append(mixed(len(rows), schema, block=pa.array([block] * len(rows), pa.int64()), shard=pa.array(shard[cuts[:-1]]), **columns))
        return pa.concat_tables(out)

    return run


def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: documents as they are, and for each block of a shard what its pairs add."""

    def rows(parts: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        key, n, prior = (np.concatenate([unplanes(p[i], t) for p in parts]) for i, t in ((1, np.uint64), (2, np.uint32), (4, np.float32)))
        pair, first, at = np.unique(key, return_index=True, return_inverse=True)
        value = fit_pairs((pair >> np.uint64(HASH_BITS)).astype(np.int64), np.bincount(at, n, len(pair)), prior[first].astype(float)) / np.log(10)
        del key, n, prior, pair, first
        blocks_, places, sums, a = [], [], [], 0
        for block, _, _, times, _, place in parts:
            m, where = unplanes(times, np.uint32), unplanes(place, np.uint32)
            doc, which = np.unique(where, return_inverse=True)
            gain = np.bincount(which, np.repeat(value[at[a : a + len(m)]], m))
            a += len(m)
            blocks_.append(block)
            places.append(planes(doc))
            sums.append(planes(gain))
        yield from mixed(len(parts), schema, block=pa.array(blocks_, pa.int64()), places=pa.array(places, pa.binary()), sums=pa.array(sums, pa.binary())).to_batches()

    now, parts, schema = None, [], None
    for batch in batches:
        schema = mixed_schema(batch.schema.field("doc_id").type)
        is_doc = pa.array(batch.column("shard").to_numpy() < 0)
        yield from pa.Table.from_batches([batch]).filter(is_doc).cast(schema).to_batches()
        pairs = batch.filter(pa.array(batch.column("shard").to_numpy() >= 0))
        for shard, *part in zip(*(pairs.column(c).to_pylist() for c in ("shard", "block", *PACKED[:5])), strict=True):
            if shard != now:
                if parts:
                    yield from rows(parts, schema)
                now, parts = shard, []
            parts.append(tuple(part))
    if parts:
        yield from rows(parts, schema)


def gathered(block: pa.Table) -> pa.Table:
    """A block's documents with what their pairs add to their scores, in the order of shards' sums."""
    is_doc = pa.array(block["place"].is_valid())
    docs, more = block.filter(is_doc).sort_by("place"), block.filter(pa.array(block["places"].is_valid()))
    total = docs["score"].to_numpy().copy()
    gains = sorted((s, p) for p, s in zip(more["places"].to_pylist(), more["sums"].to_pylist(), strict=True))
    for sums, places in gains:
        total[unplanes(places, np.uint32)] += unplanes(sums, np.float64)
    docs = docs.set_column(docs.schema.get_field_index("score"), "score", pa.array(total))
    return docs.select(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame) -> DataFrame:
    """Scores of docs (doc_id, held_out, text), learnt from those not held out."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.count("*").alias("docs"), F.count(F.when(~F.col("held_out"), 1)).alias("ends"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_blocks, ends = max(blocks(size["docs"], DOCS_PER_BLOCK), blocks(size["bytes"] or 0, DOC_BYTES)), size["ends"]
    dealt = docs.select("doc_id", "held_out", "text").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))
    words = dealt.select("block", (~F.col("held_out")).alias("train"), "text").repartition("block").sortWithinPartitions("block")
    shards = max(LEAST_SHARDS, n_blocks // BLOCKS_PER_SHARD)
    words = words.mapInArrow(tidy(packed(shards)), "block long, shard long, words binary, counts binary, shapes binary")
    counts = cut(words.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(summed), SUMMED))
    # OWN words and class totals from each of STEP_TASKS tasks.
    found = counts.where("block is null").select("top", "per_class").coalesce(STEP_TASKS).mapInArrow(combined, "top binary, per_class binary").collect()
    per_class = sum((np.frombuffer(r["per_class"], np.int64).reshape(4, CLASSES) for r in found), np.zeros((4, CLASSES), np.int64)).copy()
    top = best_of([np.frombuffer(r["top"], TOP) for r in found]).tolist()
    n_words = int(per_class[1].sum()) + (ends > 0)
    for i, (n, _, kind) in enumerate(top):
        per_class[:, kind] -= [n, 1, n == 1, n == 2]
        per_class[0, i + 1] = n
    per_class[0, 0] = ends
    own = {word: i + 1 for i, (_, word, _) in enumerate(top)}
    tokens = int(per_class[0].sum())
    # A task's counts have bounded size, so with a bounded number of tasks what each group receives is bounded too.
    seen = docs.where("not held_out").select("text").coalesce(COUNT_TASKS).mapInArrow(tidy(trigrams(own)), "g long, codes binary, counts binary")
    seen = cut(seen.repartition(GROUPS, "g").mapInArrow(tidy(added), "codes binary, counts binary")).coalesce(STEP_TASKS)
    prior = (per_class[0] + 0.5) / (tokens + 0.5 * CLASSES)
    model = Model(own, per_class, train(seen, prior, tokens), tokens, n_words)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # What counting shuffled goes before the pairs come.
    del words, seen
    release(docs.sparkSession)
    left, right = dealt.groupBy("block"), counts.where("block is not null").select("block", "shard", "counts").groupBy("block")
    pair_shards = min(max(LEAST_SHARDS, n_blocks // PAIR_BLOCKS_PER_SHARD), 2 * (OWN + 1) * CLASSES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = left.cogroup(right).applyInArrow(scorer(shared, ends, shards, pair_shards), MIXED.format(id=kind))
    fitted = first.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(weighed), MIXED.format(id=kind))
    return fitted.groupBy("block").applyInArrow(gathered, SCORED.format(id=kind))


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "text"))
