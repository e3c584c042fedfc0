"""Operators that SQL cannot express, against brute force, exact round trips or held-out accuracy."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import bpe, common, maxent, mixing, near, rabitq, simhash, suffixdedup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_equal_runs_and_roots():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 40, 200))
    got = {(int(a), int(b)) for i, j in common.equal_runs(keys) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if keys[i] == keys[j]}
    a, b = rng.integers(0, 100, 60), rng.integers(0, 100, 60)
    label = list(range(100))
    for _ in range(100):
        for x, y in zip(a, b, strict=True):
            label[x] = label[y] = min(label[x], label[y])
    assert common.roots(100, a, b).tolist() == label


@pytest.mark.parametrize("few", [0, common.FEW_EDGES])
@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, monkeypatch, shape, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rnd = random.Random(4)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(-5, i) for i in range(60)], "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]}[shape]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    label = {n: n for n in nodes}
    for _ in nodes:
        for x, y in edges:
            if x != y:
                label[x] = label[y] = min(label[x], label[y])
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == label


def reference_tokenizer():
    ranks, pattern = bpe.public_ranks()
    found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=found, special_tokens={})


def test_bpe_against_tiktoken(documents):
    own, other = reference_tokenizer()
    rnd = random.Random(0)
    texts = [r["text"] for r in documents.collect()]
    texts += ["".join(rnd.choice("abcAB é漢 \n\t\r　\x1c 'sdlm0189=-_🙂́aaaa") for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["a" * 3000, "=-" * 2000, " " * 999 + "x", "aab" * 500, "'s't'LL", "\n \nbar  baz"]
    for text, ids in zip(texts, own.block(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("half", [1024, 3])
def test_simhash(spark, documents, monkeypatch, half):
    monkeypatch.setattr(simhash, "HALF", half)  # with 3, buckets are cut into chunks
    rows = documents.select("doc_id", "text").collect()
    rnd = random.Random(2)
    close = [(1000 + i, rnd.getrandbits(64)) for i in range(30)]
    close += [(2000 + i, close[i % 30][1] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6)))) for i in range(300)]
    own = [(r["doc_id"], fingerprint(r["text"])) for r in rows]
    got = simhash.with_fingerprint(documents.select("doc_id", "text")).collect()
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == dict(own)
    every = own + close
    fps = np.array([f for _, f in every], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    ids = np.array([i for i, _ in every])
    order = np.argsort(ids)
    place = np.argsort(order)
    want = ids[order][common.roots(len(ids), place[a], place[b])][place]
    rows = spark.createDataFrame([(int(i), int(np.uint64(f).astype(np.int64))) for i, f in every], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in rows.join(simhash.classes(rows), "fp").collect()}
    assert got == dict(zip(ids.tolist(), want.tolist(), strict=True))


def brute_repeats(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "many", "at_once"), [(400, 256, 8_000_000), (40, 256, 8_000_000), (400, 2, 8_000_000), (40, 2, 300), (400, 2, 300), (400, 256, 1)])
def test_repeats(spark, monkeypatch, length, many, at_once):
    # Small portions cut keys and texts apart, as very large ones are.
    own = suffixdedup.portions
    monkeypatch.setattr(suffixdedup, "portions", lambda batches, text, _, *more: own((b.slice(i, 3) for b in batches for i in range(0, b.num_rows, 3)), text, at_once, *more))
    monkeypatch.setattr(suffixdedup, "MANY", many)
    monkeypatch.setattr(suffixdedup, "MANY_STRINGS", 40 * many)
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    base = [text(3000) for _ in range(4)]
    texts = ["", None, "short", text(399), "a" * 2000, "a" * 500, "ab" * 700, "a" * 401, "a" * 400, text(50) * 30]
    for _ in range(80):
        s = rnd.randrange(2500)
        texts.append(text(rnd.randrange(300)) + rnd.choice(base)[s : s + rnd.randrange(100, 900)] + text(rnd.randrange(300)) + rnd.choice(["", rnd.choice(base)[s : s + 450], "zq" * rnd.randrange(500)]))
    texts += [base[0], base[0], base[1][:1500] + "X" + base[1][1501:], base[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixdedup.remove_repeats(df, length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts], length)


def test_repeats_in_documents(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    want = brute_repeats([r["text"].encode() for r in rows], 400)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.op10_suffixdedup(spark, SF).collect()}
    assert [got[r["doc_id"]] for r in rows] == want


def test_near_duplicate_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 24))
    near = base[rng.integers(0, 150, 400)] + rng.standard_normal((400, 24)) * rng.choice([0.05, 0.2, 0.4], (400, 1))
    crowd = base[:1] + rng.standard_normal((300, 24)) * 0.02
    vectors = np.concatenate([base, near, crowd]).astype(np.float32)
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = np.triu(unit @ unit.T >= 0.9, 1)
    n = link.sum(0) + link.sum(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    for chunk in (rabitq.CHUNK, 64):
        monkeypatch.setattr(rabitq, "CHUNK", chunk)
        got = {r["vec_id"]: r for r in rabitq.near_duplicates(df).collect()}
        found = sum(r["n_links"] for r in got.values())
        assert all(got[i]["n_links"] <= n[i] for i in range(len(n)))
        assert found / n.sum() >= 0.9
        a, b = np.nonzero(link)
        want = common.roots(len(n), a, b)
        assert np.mean([got[i]["component_id"] == want[i] for i in range(len(n))]) >= 0.97


def test_inner_product_estimates():
    """Unbiased over rotations, and within their bounds."""
    rng = np.random.default_rng(21)
    a = rng.standard_normal((400, 48))
    b = a + rng.standard_normal((400, 48)) * rng.choice([0.2, 0.5, 1.0], (400, 1))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    true, errors, outside = np.einsum("ij,ij->i", a, b), [], 0
    for seed in range(60):
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((48, 48)))[0]
        x, y = a @ turn, b @ turn
        factor = np.abs(x).sum(axis=1) / math.sqrt(48)
        estimate, upper = rabitq.estimates(np.where(x > 0, 1.0, -1.0), factor, y)
        errors.append(estimate - true)
        outside += int((upper < true).sum())
    errors = np.array(errors)
    assert abs(errors.mean()) < 4 * errors.mean(axis=0).std() / math.sqrt(400) + 1e-3
    assert np.abs(errors.mean(axis=0)).max() < 5 * errors.std(axis=0).max() / math.sqrt(60)
    assert outside <= 60 * 400 * 1e-3


def test_toxicity_on_held_out(spark):
    got = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    assert right > 0.96
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_segments_against_brute_force():
    model = toxicity.Model({b"wx": 2.0, b"wy": 0.7}, {b"wx": 1e-4, b"wy": 1e-3})
    rnd = random.Random(6)
    for _ in range(200):
        words = [rnd.choice([b"x", b"y", b"a", b"b"]) for _ in range(rnd.randrange(25))]
        s = [{b"x": 2.0, b"y": 0.7}.get(w, toxicity.DRIFT) for w in words]
        got = model.segments(words)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert math.isclose(max((x for *_, x in got), default=0.0), max(best, 0.0), abs_tol=1e-9)
        assert all(math.isclose(sum(s[b:e]), x, abs_tol=1e-9) for b, e, x in got)
        assert all(e <= b for (_, e, _), (b, _, _) in zip(got, got[1:], strict=False))


def test_language_model(spark):
    got = {r["doc_id"]: r for r in maxent.op8_maxent(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    words = {r["doc_id"]: [*r["text"].encode().lower().split(), None] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in words}
    count = collections.Counter(w for i, own in words.items() if not held[i] for w in own)
    n, v = sum(count.values()), len(count)
    for i, own in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
    apart = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_language_model_sums_to_one():
    rng = np.random.default_rng(9)
    per_class = np.stack([rng.integers(50, 90, maxent.CLASSES), np.full(maxent.CLASSES, 20), np.full(maxent.CLASSES, 8), np.full(maxent.CLASSES, 4)])
    model = maxent.Model({}, per_class, rng.standard_normal((maxent.ROWS, maxent.CLASSES)), 1000, 100)
    assert np.allclose((10.0 ** model.table.astype(float)).sum(axis=1), 1, atol=1e-4)
    # Within a class: all words discounted once each, and the rest for unseen ones.
    kind = np.array([100])
    n = per_class[0, 100]
    seen = sum(10 ** model.word_logs(kind, np.array([c]))[0] for c in [*[1] * 8, *[2] * 4, *[(n - 16) / 8] * 8])
    assert math.isclose(seen + 10 ** model.word_logs(kind, np.array([0]))[0], 1, rel_tol=1e-9)


def pairs_by_bisection(n, prior):
    """What fit_pairs returns for one row, from its stationary point: bisection on the normaliser, then on each weight."""
    n, prior, total = np.array(n, float), np.array(prior, float), sum(n)

    def weights(z):
        low, high = np.full(len(n), -50.0), np.full(len(n), 700.0)
        for _ in range(100):
            a = (low + high) / 2
            up = n - total * prior * np.exp(a) / z - maxent.PAIR_RIDGE * a > 0
            low, high = np.where(up, a, low), np.where(up, high, a)
        return np.where(n > 0, low, 0.0)

    low, high = -20.0, 20.0
    for _ in range(100):
        z = np.exp((low + high) / 2)
        if z < 1 + (prior * np.expm1(weights(z)))[n > 0].sum():
            low = np.log(z)
        else:
            high = np.log(z)
    return weights(np.exp(low)) - low


def test_language_model_pairs():
    rng = np.random.default_rng(11)
    for size in (1, 2, 5, 60):
        prior = rng.dirichlet(np.full(size + 1, 0.3))[:size]
        n = rng.choice([0, 1, 1, 3, 40, 5000], size)
        row = np.zeros(size, np.int64)
        value = maxent.fit_pairs(row, n, prior)
        assert np.allclose(value, pairs_by_bisection(n, prior), atol=2e-3)
        # The words of a class with this history, and those without a pair, sum to one.
        rest = 1 - prior.sum()
        unseen = value[n == 0][0] if (n == 0).any() else np.log((1 - prior[n > 0].sum()) ** -1 * (1 - (prior * np.exp(value))[n > 0].sum()))
        assert math.isclose((prior * np.exp(value)).sum() + rest * np.exp(unseen), 1, rel_tol=1e-6)
    both = maxent.fit_pairs(np.array([3, 3, 8]), np.array([2, 0, 5]), np.array([0.1, 0.2, 0.01]))
    assert np.allclose(both[:2], maxent.fit_pairs(np.array([3, 3]), np.array([2, 0]), np.array([0.1, 0.2])))


def test_language_model_score_recomputed(spark, monkeypatch):
    """Every score of op8, from plain dictionaries and the class model's table."""
    made, real = [], maxent.Model.__init__
    monkeypatch.setattr(maxent.Model, "__init__", lambda self, *parts: made.append(self) or real(self, *parts))
    monkeypatch.setattr(maxent, "DOCS_PER_BLOCK", 30)
    got = {r["doc_id"]: r["score"] for r in maxent.op8_maxent(spark, SF).collect()}
    model = made[0]
    docs = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), None] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count = collections.Counter(w for i, own in docs.items() if not held[i] for w in own)

    def kind(word):
        return 0 if word is None else model.own.get(int(maxent.hashes([word])[0]), maxent.shape(word))

    def steps(words):
        near = far = 0
        for w in words:
            c = kind(w)
            frequent = ("n-gram", near) if near <= maxent.OWN else ("skip", far) if far <= maxent.OWN else None
            yield w, c, far, near, frequent
            near, far = c, near

    seen = collections.defaultdict(collections.Counter)
    for i, words in docs.items():
        for w, c, _, _, frequent in steps(words):
            if frequent and c > maxent.OWN:
                seen[frequent, c][w] += not held[i]
    share = lambda w, c: float(model.shares(np.array([c]), np.array([count[w]]))[0])
    rows = [(j, row, w, n) for j, (row, own) in enumerate(seen.items()) for w, n in own.items()]
    # test_language_model_pairs holds fit_pairs against another solution.
    value = maxent.fit_pairs(np.array([r[0] for r in rows]), np.array([r[3] for r in rows]), np.array([share(r[2], r[1][1]) for r in rows])) / math.log(10)
    gain = collections.defaultdict(dict)
    for (_, row, w, _), x in zip(rows, value, strict=True):
        gain[row][w] = x
    assert len(gain) > 100
    for i, words in docs.items():
        want = 0.0
        for w, c, far, near, frequent in steps(words):
            want += model.table[far * maxent.CLASSES + near, c] + math.log10(share(w, c))
            want += gain[frequent, c][w] if frequent and c > maxent.OWN else 0.0
        assert math.isclose(got[i], want, rel_tol=1e-4), i


def test_mixing_reruns_and_bins(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "PER_BIN", 4)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == whole
    by = collections.defaultdict(list)
    for r in whole:
        by[r[1]].append(r)
    assert all(sum(r[5] for r in own) == round(own[0][4]) for own in by.values())


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.01"
    docs, names = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir))
        names.append((name, before.count(), docs.count()))
    assert names[0][2] < names[0][1] and names[1][2] < names[1][1]
    got = collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == collections.Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert not docs.where(F.length("text") != F.col("n_chars")).count()

def jaccard(x, y):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for t in (x, y))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("small", [128, 2])
def test_near_copies_against_brute_force(spark, monkeypatch, small):
    # With 2, most buckets count as crowded; these are cut into chunks.
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "CHUNK_SHINGLES", 100 * small)
    # Single links of 0.8 and more over five words, near the threshold on both sides, in long and short texts.
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    line = " ".join(word() for _ in range(30))
    texts = ["", " \n", "one two three", "One  two three", "one two three four"]
    for size in (8, 30, 60, 150, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for changes in range(1, max(3, size // 20)):
                copy = list(base)
                for at in rnd.sample(range(size), changes):
                    copy[at] = word()
                texts.append(" ".join(copy))
            texts.append(" ".join(base[: size * 9 // 10]))
            texts.append(" ".join(base[size // 10 :]) + " " + line)
    a, b = zip(*[(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8], strict=True)
    want = set(common.roots(len(texts), np.array(a), np.array(b)).tolist())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == want
    far = [bin(fingerprint(texts[i]) ^ fingerprint(texts[j])).count("1") for i, j in zip(a, b, strict=True)]
    assert max(far) > 4


def test_repeated_passages(spark):
    # 51 words in under 400 bytes are a repeat, 50 are not; white space between words does not count.
    rnd = random.Random(7)
    words = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(10_000)) for _ in range(n)]
    planted, short = words(51), words(50)
    texts = [" ".join([*words(20), *planted, *words(20), *short, *words(9)]), " ".join(words(30)) + " " + "\n".join(planted) + " " + " ".join(words(30)), " ".join([*short, *words(40)])]
    base = words(400)
    for _ in range(40):
        s = rnd.randrange(330)
        texts.append(" ".join([*words(rnd.randrange(30)), *base[s : s + rnd.randrange(30, 90)], *words(rnd.randrange(30))]))
    texts += ["x " * 120, "", None, " ", "é " * 51, "y " * 51]
    assert len(" ".join(planted)) < 400
    split = [(t or "").split() for t in texts]
    count = collections.Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    strings = collections.Counter(t.encode()[i : i + 400] for t in texts if t for i in range(len(t.encode()) - 399))
    want = []
    for text, own in zip(texts, split, strict=True):
        data, at = (text or "").encode(), 0
        gone = bytearray(len(data))
        edges = []
        for w in own:
            begin = data.index(w.encode(), at)
            at = begin + len(w.encode())
            edges.append((begin, at))
        for i in range(len(own) - 50):
            if count[tuple(own[i : i + 51])] > 1:
                for b in range(edges[i][0], edges[i + 50][1]):
                    gone[b] = 1
        for i in range(len(data) - 399):
            if strings[data[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want.append(bytes(b for b, g in zip(data, gone, strict=True) if not g).decode(errors="ignore"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in suffixdedup.without_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert planted[0] not in got[0] and short[0] in got[0]


def test_op10_tells_passages_of_few_bytes(spark, tmp_path):
    # The contract removes strings of 400 bytes; shorter passages of over 50 words are told beside that, and both where they meet.
    rnd = random.Random(9)
    words = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(10_000)) for _ in range(n)]
    planted, long = " ".join(words(51)), " ".join(words(150))
    texts = [f"{' '.join(words(30))} {planted} {' '.join(words(30))}", f"{planted}\n{' '.join(words(20))} {long}", f"{long} {' '.join(words(9))}", " ".join(words(200)), "", None, "copied text", "copied text"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in suffixdedup.op10_suffixdedup(spark, str(tmp_path)).collect()}
    assert len(planted) < 400 < len(long)
    want = [(len(planted), 1), (len(planted) + len(long), 2), (len(long), 1), *[(0, 0)] * 5]
    near = [0, 1, 0, 0, 0, 0, 0, 0]  # the blank before a string may be the same by chance or because both begin with it
    assert all(abs(got[i]["n_repeated"] - n) <= 1 + near[i] and got[i]["n_passages"] == k for i, (n, k) in enumerate(want))
    strings = brute_repeats([(t or "").encode() for t in texts], 400)
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == strings
    assert got[0]["n_removed"] == 0 < got[1]["n_removed"]
