"""Every operator and stage on null, empty, long, tied, repeated and clashing rows, and on empty tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import bpe, chat, common, maxent, mixing, rabitq, simhash, suffixdedup, topk, toxicity, urlrules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, size int, kept string, fp long"
ROWS = [
    (1, "the cat sat on the mat and the dog slept", "en", "a", 40, 0.5, "x", 1, "k", 3),
    (1, "the cat sat on the mat and the dog slept", "en", "a", 40, 0.5, "x", 1, "k", 3),
    (2, None, None, None, None, None, None, None, None, None),
    (None, "no id here", "en", "b", 10, 0.1, "y", 2, "k", 4),
    (3, "", "en", "b", 0, 0.1, "y", 2, "k", 4),
    (4, " \t\n ", "fr", "c", 4, 0.1, "y", 2, "k", 4),
    (5, "word " * 30_000 + "ü" * 2000, "en", "a", 152_000, 0.2, "z", 3, "k", 5),
    (6, "idiot moron scum trash idiot moron", "en", "a", 30, 0.2, "z", 3, "k", 5),
]
LABELS = [(1, 1, 0), (3, 1, 0), (6, 0, 1), (6, 0, 0), (None, None, None), (4, None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe(docs, none):
    ranks, pattern = bpe.public_ranks()
    got = bpe.round_trip(docs.select("doc_id", "text", "n_chars"), ranks, pattern).collect()
    assert len(got) == len(ROWS)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in got)
    assert bpe.digests(none, ["doc_id"]).count() == 0


def test_toxicity(docs, labels, none):
    model = toxicity.learn(docs, labels)
    got = toxicity.scored(docs.select("doc_id", "text"), model).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.learn(none, labels).probability([0.0, 0.0, 0.0]) == 0.5
    assert toxicity.clean_documents(none, labels).count() == 0
    assert toxicity.clean_documents(docs, labels).columns == docs.columns


def test_simhash(docs, none):
    rows = simhash.with_fingerprint(docs.select("doc_id", "text"))
    assert {r["fp"] for r in rows.collect() if r["doc_id"] in (2, 3, 4)} == {0}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.collect()) == [(False, None), (True, 1), (True, 2), (True, 5), (True, 6)]
    assert simhash.one_of_each(none).count() == 0


def test_suffixdedup(docs, none):
    got = suffixdedup.remove_repeats(docs, keep=["doc_id", "score", "kept"])
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()}[5] > 0
    cleaned = suffixdedup.without_repeats(docs)
    assert cleaned.columns == docs.columns
    # The caller's columns keep their values, whatever they are called.
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert sorted(map(str, cleaned.select(*others).collect())) == sorted(map(str, docs.select(*others).collect()))
    assert suffixdedup.without_repeats(none).count() == 0


def test_suffixdedup_names(spark):
    """Ids are not looked at: null, repeated and of any type, beside columns with the names of results and helpers."""
    import random

    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b = text(900), text(700)
    rows = [(None, a, "k", 77), (None, b, "l", 78), ("x", "xx" + a, "m", 79), ("x", text(500), "n", 80)]
    df = spark.createDataFrame(rows, "doc_id string, text string, kept string, n_bytes long").withColumn("t1", F.lit(1)).withColumn("__0", F.lit(2))
    got = {r["kept"]: r for r in suffixdedup.without_repeats(df).collect()}
    assert {k: (r["doc_id"], r["text"], r["n_bytes"], r["t1"], r["__0"]) for k, r in got.items()} == {"k": (None, "", 77, 1, 2), "l": (None, b, 78, 1, 2), "m": ("x", "xx", 79, 1, 2), "n": ("x", rows[3][1], 80, 1, 2)}


def test_long_texts_are_cut(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffixdedup, "BLOCK", 300)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 101, n)).decode() for n in (5, 39, 40, 41, 299, 700, 5000)] + ["ab" * 900]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["t1", "t2", "text"])
    seen = [set() for _ in texts]
    for parts in suffixdedup.parts_of([batch], 40, suffixdedup.BYTE):
        assert sum(len(p[3]) for p in parts) <= 300 + 39 or len(parts) == 1
        text, start, size, *_ = suffixdedup.runs_of([p[3] for p in parts], 40)
        for i, a, n in zip(text.tolist(), start.tolist(), size.tolist(), strict=True):
            seen[parts[i][0]].update(range(parts[i][2] + a, parts[i][2] + a + n))
    assert seen == [set(range(max(0, len(t) - 39))) for t in texts]


def test_mixing(docs, labels, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    total = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - total) <= len({r["source"] for r in got})
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs, labels).columns == docs.columns
    assert mixing.mixed_documents(none, labels).count() == 0


def test_maxent(docs, none):
    rows = docs.select("doc_id", (F.coalesce("doc_id", F.lit(0)) == 2).alias("held_out"), "text")
    got = maxent.score(rows).collect()
    assert len(got) == len(ROWS)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    assert all(r["score"] < 0 for r in got)
    assert maxent.score(none.select("doc_id", F.lit(False).alias("held_out"), "text")).count() == 0
    assert maxent.score(docs.select("doc_id", F.lit(True).alias("held_out"), "text")).agg(F.max("base_score")).first()[0] == 0


def test_rabitq(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (1, [1.0, 0.0]), (None, [1.0, 0.01])]
    got = rabitq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("copies", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert (by[1]["n_links"], by[2]["component_id"], by[3]["n_links"], by[None]["component_id"]) == (3, 1, 0, 1)
    assert all((by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True) for i in (4, 5, 6, 7, 8))
    assert rabitq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-1.0, 0.0]), (50, [0.5]), (4, None), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (2, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding"), 256).alias("q")).where("id is not null and q is not null")
    got = sorted(map(tuple, topk.top_k(q.where("id % 50 = 0"), q, k=3, block=2, query_block=1).collect()))
    assert got == [(0, 1, 1, 81920), (0, 2, 2, 81920), (0, 3, 2, 81920), (50, 1, 0, 32768), (50, 2, 1, 32768), (50, 3, 2, 32768)]
    empty = q.where("false")
    assert topk.top_k(empty, empty).count() == 0
    assert topk.top_k(q.where("id = 50"), q.where("id = 50")).count() == 0


def test_urlrules(spark):
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, action string")
    urls = [(1, "http://WWW.Example.com/en/x?q"), (2, "https://a.example.com/en/"), (3, "https://example.com/en"), (4, "nothing"), (5, None), (6, "http://xexample.com/en/"), (7, "ftp://b.net/es/1#f"), (8, "http://b.net/de/"), (9, "http://example.com?x=/en/"), (10, "://"), (1, "http://WWW.Example.com/en/x?q")]
    got = urlrules.judge(spark.createDataFrame(urls, "page_id long, url string").withColumn("key", F.lit(1)), rules).collect()
    assert len(got) == len(urls)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("example.com", "/en", "com/", "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("xexample.com", "/en/", "com/", "allow"), 7: ("b.net", "/es/1", "net/es/", "block"), 8: ("b.net", "/de/", None, "allow"),
        9: ("example.com", "", None, "allow"), 10: ("", "", None, "allow"),
    }
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert urlrules.judge(spark.createDataFrame(urls, "page_id long, url string"), rules.where("false")).where("rule is not null").count() == 0


def test_nested_rules_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net"]
    rules = {(rnd.choice(hosts), "/" + "".join(rnd.choice("ab/") for _ in range(rnd.randrange(4)))): rnd.choice(["allow", "block"]) for _ in range(40)}
    urls = [f"http://{rnd.choice(['', 'w.', 'a.', 'b.a.'])}{rnd.choice(['com', 'net', 'a.com'])}/" + "".join(rnd.choice("ab/") for _ in range(rnd.randrange(6))) for _ in range(400)]
    got = urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([(h, p, a) for (h, p), a in rules.items()], "host string, path string, action string"))

    def want(url):
        host, path = url[7:].split("/", 1)
        fit = [(len(h + p), h + p, a) for (h, p), a in rules.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fit)[1:] if fit else (None, "allow")

    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()} == {i: want(u) for i, u in enumerate(urls)}


def test_chat(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a<"), (2, 0, "user", "a<"), (2, 1, "assistant", "other"), (3, 0, None, None), (None, 0, "user\nx\\n", "<||>"), (4, 0, "user", "a<"), (1, 0, "user", "a<"), (5, None, "assistant", "|" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1))
    convs = chat.cut(chat.format_turns(df))
    segments, nodes = chat.packed(convs)
    got = chat.attended(segments, nodes)
    said = {r["leaf"]: "".join(p["text"] for p in r["pieces"]) for r in got.collect()}
    assert all(said[r["leaf"]] == "".join(r["texts"]) for r in convs.collect())
    # Shared turns are there once, and the stream has no gap.
    spans = sorted((r["start"], len(r["text"])) for r in nodes.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert len(spans) == len({d for r in convs.collect() for d in r["path"]})
    read = {r["leaf"]: r for r in got.select("leaf", "pieces").mapInArrow(chat.read_back, chat.READ).collect()}
    assert {r["conv_id"]: read[r["leaf"]]["n_turns"] for r in convs.collect()} == {1: 3, 2: 2, 3: 1, None: 1, 4: 1, 5: 1}
    assert [chat.role_unescaped(chat.role_escaped(x)) for x in ("user\nx\\n", "<|im_start|>", "\\")] == ["user\nx\\n", "<|im_start|>", "\\"]
    empty = chat.cut(chat.format_turns(df.where("false")))
    assert chat.attended(*chat.packed(empty)).count() == 0


def test_stages_keep_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize(("master", "folder"), [("yarn", None), ("spark://host:7077", None), ("yarn", "/shared"), ("local[8]", None)])
def test_checkpoints_never_go_to_a_local_folder_on_a_cluster(master, folder):
    """A folder is made up in local mode only; a given one is taken as it is."""
    given = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: given[-1] if given else None, setCheckpointDir=given.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: folder))
    if folder or master.startswith("local"):
        found = common.shared_folder(session)
        assert found == folder or "tracelake-" in found
    else:
        with pytest.raises(ValueError):
            common.shared_folder(session)
