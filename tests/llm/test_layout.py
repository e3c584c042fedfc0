"""Fill-in-middle, token files and whitening against brute force, and on odd rows."""

import glob
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelake.llm import fim, tokenfile, whitening

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)
BITS = ["a", "Pq", "S", " ", "<", ">", "<P>", "<S>", "  ", "é", "日本語", "\n", "M", "😀", " " * 37, "-", "\x00"]


def naive(text: str, doc_id: str, key: str = "1") -> tuple:
    """The contract by lists of units."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{key}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h4 % 100 < 20
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_units_of_random_texts(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(1500):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randrange(14)))
        units, own = UNIT.findall(text), fim.Units(text)
        assert (own.n, own.marked) == (len(units), bool(re.search("<[PSM]>", text))), text
        for k in rnd.sample(range(len(units) + 1), min(3, len(units) + 1)):
            assert own.place(k) == len("".join(units[:k])), (text, k)


def test_fill_in_middle(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice([b for b in BITS if b not in ("<P>", "<S>")]) for _ in range(rnd.randrange(40))) for _ in range(400)]
    rows = [*enumerate(texts), (1, texts[1]), (None, "no id"), (900, None), (901, ""), (902, "x <M> y"), (903, "<" * 50 + "P" * 50), (904, "word\n" * 300_000 + "é")]
    docs = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, n int, form string")
    made = fim.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "fim"]
    got = made.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(rows) and {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r["fim"]) == naive(r["text"] or "", "" if r["doc_id"] is None else str(r["doc_id"]))
        assert (r["back"], r["n"], r["form"]) == (r["text"] or "", 7, "s")
    assert fim.fill_in_middle(made).columns == made.columns
    assert fim.fill_in_middle(docs.where("false")).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenfile.public_definition())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_op12_against_the_library(spark, library):
    got = tokenfile.op12_tokenfile(spark, SF).orderBy("doc_id").collect()
    at = 0
    for r, d in zip(got, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = [*library(d["text"]), 0]
        assert tuple(r) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, library):
    """A token file of odd texts, many of them in few ids, and its tokens in order."""
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "a", "ab's", "é", "日本", "😀", "12", "...", "<|endoftext|>", "\r\n", "word"]
    rows = [(rnd.choice([None, *range(60)]), "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))) for _ in range(600)]
    rows += [(500, None), (501, ""), (502, "many words here " * 20_000), (502, "many words here " * 20_000)]
    folder = f"{tmp_path_factory.mktemp('tokens')}/f"
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(4)
    tokenfile.write(docs, folder, tokenfile.public_definition(), end_id=0)
    return folder, rows


def test_places_and_order(spark, odd, library):
    folder, rows = odd
    got = tokenfile.read(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got)
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known)
    assert np.cumsum([0, *(r["n_tokens"] for r in got)]).tolist()[:-1] == [r["start"] for r in got]
    want = sorted((-1 if i is None else i, [*library(t), 0]) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want


def test_encodings_and_pages(spark, odd):
    folder, _ = odd
    files = sorted(glob.glob(f"{folder}/ids/*.parquet"))
    for f in files:
        group = pq.read_metadata(f).row_group(0)
        columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        assert "RLE_DICTIONARY" in columns["ids"].encodings and columns["ids"].has_offset_index
        for name in ("doc_id", "at", "upto", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and columns[name].has_column_index
    plan = tokenfile.read(spark, folder).where("doc_id = 7").select("doc_id", "start")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines()[::-1] if "FileScan" in line and "/ids" in line)
    assert "ids:array" not in scan and "EqualTo(doc_id,7)" in scan


def test_tokens_between(spark, odd):
    folder, _ = odd
    whole = [i for r in tokenfile.read(spark, folder).orderBy("start").collect() for i in r["ids"]]
    for first, count in [(0, 1), (0, 10), (37, 500), (len(whole) - 5, 100), (len(whole) + 3, 5), (100, 0), (0, len(whole))]:
        got = tokenfile.tokens_between(spark, folder, first, count).orderBy("start").collect()
        assert [i for r in got for i in r["ids"]] == whole[first : first + count]
        assert not got or got[0]["start"] == first


def test_token_file_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokenfile.write(docs, f"{tmp_path}/f", tokenfile.public_definition())
    assert tokenfile.with_crc32(tokenfile.read(spark, f"{tmp_path}/f")).count() == 0
    assert tokenfile.tokens_between(spark, f"{tmp_path}/f", 0, 5).count() == 0


def test_pieces_are_independent(library):
    rnd = random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\x01", "\x0b", "\x0c", "\x1f", "\x85", "\xa0", "\u2009", "\u3000", "a", "Zb", "é", "ÿ", "×", "÷", "ª", "ß", "ſ", "日本", "١", "7", "'s", "'", "'ll", ",", "...", "-", "_", "@", "[", "`", "{", "~", "/", "…", "😀", "\u0301", "<|endoftext|>"]
    texts = ["", "".join(rnd.choice(parts) for _ in range(5000)), *("".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(20_000))]
    texts += ["".join(rnd.choice(["a", "é", ",", ".", "'s", "-", "1", " ", "\n"]) for _ in range(rnd.randrange(20))) for _ in range(20_000)]
    own = tokenfile.Encoder(tokenfile.public_definition())
    for i in range(0, len(texts), 3000):
        some = texts[i : i + 3000]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.block(some)] == [library(t) for t in some]
    assert own.block([]) == []


def test_words_are_remembered_without_their_signs(monkeypatch):
    own = tokenfile.Encoder(tokenfile.public_definition())
    own.block(["A word, a tree."])
    asked = []
    monkeypatch.setattr(own, "in_a_row", lambda pieces, ask=own.in_a_row: asked.extend(pieces) or ask(pieces))
    own.block(["A word; a tree! a word a word... a word? a tree, a tree"])
    assert asked == []


def test_other_tokenizers_see_whole_texts():
    from tokenizers import Tokenizer

    text = "Some Words,  here\tand there"
    definition = tokenfile.public_definition("word_bpe_49k.json")
    assert np.frombuffer(tokenfile.Encoder(definition).block([text])[0], "<u4").tolist() == Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids


def covariances(vectors):
    """Integers, deviations, eigenvalues and eigenvectors, by numpy on all rows."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    apart = len(x) * x - x.sum(0)
    v = (apart / len(x)).T @ (apart / len(x)) / len(x)
    values, turn = np.linalg.eigh(v)
    return apart, (apart * apart).sum(1), values[::-1], turn[:, ::-1], np.trace(v)


def test_op13_against_numpy(spark):
    got = whitening.op13_whitening(spark, SF).toPandas()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    apart, deviation, values, turn, trace = covariances(np.stack(e["embedding"]))
    white = apart / len(e) @ turn[:, :8] / np.sqrt(values[:8])
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[e["vec_id"]].to_numpy()
    assert np.abs(own * np.sign((own * white).sum(0)) - white).max() < 1e-9
    assert (got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].loc[e["vec_id"]].to_numpy() == deviation).all()
    assert np.allclose(got.groupby("component")["explained"].first(), values[:8] / trace, rtol=1e-9)
    assert set(got["n"]) == {len(e)} and got["identity_error"].max() < 1e-9


def test_whitening_of_odd_vectors(spark):
    rnd = np.random.default_rng(1)
    plain = rnd.normal(size=(40, 3)).astype(np.float32).tolist()
    bad = [None, [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [1.0, float("inf"), 0.0], [], [1.0, 2.0], [1e30, 0.0, 0.0]]
    rows = [(i, v, 1.0) for i, v in enumerate(plain)] + [(0, plain[0], 2.0), (None, plain[1], 3.0)] + [(100 + i, v, 4.0) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, deviation double")
    model = whitening.fit(df)
    used = [v for v in plain] + [plain[0], plain[1]]
    _, deviation, values, _, trace = covariances(used)
    assert model.n == len(used) and model.deviations == deviation.sum() and len(model.values) == 3
    assert np.allclose(model.explained, values / trace, rtol=1e-9)
    got = whitening.transform(df, model)
    assert got.columns == [*df.columns, "whitening"] and got.count() == len(used)
    assert whitening.identity_error(got.select("whitening.whitened"), "whitened", 3) < 1e-9
    assert whitening.transform(got, model).columns == got.columns


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[]]])
def test_whitening_without_variance(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    model = whitening.fit(df)
    assert len(model.values) == 0 and model.trace == 0
    assert all(r["whitening"]["whitened"] == [] for r in whitening.transform(df, model).collect())


def test_whitening_of_one_direction_and_of_large_entries(spark):
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "vec_id long, embedding array<double>")
    assert len(whitening.fit(line).values) == 1
    large = [[float(1 << 50), 0.0], [-float(1 << 50), 1.0], [0.5, 3.0]]
    model = whitening.fit(spark.createDataFrame(list(enumerate(large)), "vec_id long, embedding array<double>"))
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in large]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert model.deviations == sum((3 * c - s) ** 2 for v in x for c, s in zip(v, sums, strict=True))
