"""Toxicity by maximum-scoring segments over token log-odds.

Learning: on a bounded sample of labelled documents (TRAIN_DOCS of the rows the
caller lets it learn from, those with the smallest hash of their id; the only
sample here), each word and each short stem of a word gets a log-odds of
toxic against clean documents with an informative Dirichlet prior; those whose
log-odds are significant keep it, every other token has a negative score.

Scoring: one linear scan of a text finds every maximal-scoring segment. Under
the model of clean text, segment scores follow an extreme-value law with
parameters lambda (the root of the scores' moment equation) and K (matched to
the clean documents of the sample), which gives each segment its expected number
by chance in a text of that length; segments expected less than ALPHA times are
the toxic passages. The best segment's expectation, the number of passages and
their joint excess go through a logistic curve to a score in 0..1.

Only the text enters a score. Defined cases: null and empty texts have no
segment and get the score of a text without one; a document with several labels
counts as toxic if one says so; without labels of both kinds every score is the
share of toxic labels (0.5 without any); ids null or repeated keep their rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.bpe import slices
from tracelake.llm.common import crc_mod, cut, small_batches, table, tidy

TRAIN_DOCS = 20_000
STEMS, EDGE = (4, 5, 6), b".,;:!?\"'()[]{}<>|*_-"
PRIOR_SHARE, Z_LEAST, SCORE_LEAST, DRIFT, ALPHA = 0.1, 2.5, 2.5, -0.5, 0.05
BLOCK_BYTES, CACHE_WORDS = 2_000_000, 150_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def features_of(word: bytes) -> list[bytes]:
    """The word without punctuation around it, and its stems, marked by their kind."""
    word = word.strip(EDGE)
    return [b"w" + word, *(b"s" + word[:n] for n in STEMS if len(word) > n)] if word else []


class Model:
    """Token scores and their extreme-value law. weights: the logistic curve, once fitted."""

    def __init__(self, scores: dict[bytes, float], chance: dict[bytes, float]):
        self.scores, self.known = scores, {}
        self.lam, self.k, self.weights = self.root(list(scores.values()), [chance[f] for f in scores]), 0.1, None
        self.share = 0.5

    @staticmethod
    def root(scores: list[float], chance: list[float]) -> float:
        """lambda > 0 at which the expected exp(lambda * score) of clean tokens is one."""
        s, p = np.array(scores), np.array(chance)
        if not len(s):
            return 1.0
        rest = max(1 - p.sum(), 1e-9)
        low, high = 0.0, 50.0 / s.max()
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * s)).sum() + rest * math.exp(mid * DRIFT) < 1 else (low, mid)
        return max(low, 1e-3)

    def score(self, word: bytes) -> float:
        """The token's log-odds, or zero where it has none; remembered up to a bound."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            got = self.known[word] = max([self.scores.get(f, 0.0) for f in features_of(word)], default=0.0)
        return got

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Every maximal-scoring segment as (begin, end, score), in linear time.

        Candidate segments are kept with the cumulative score before and at their end;
        a new one is joined with earlier ones as long as that gains.
        """
        toxic = {w for w in set(words) if self.score(w) > 0}
        if not toxic:
            return []
        stack: list[list[float]] = []  # begin, end, total before, total at the end
        total, last = 0.0, 0
        for i, w in enumerate(words):
            if w not in toxic:
                continue
            before = total + DRIFT * (i - last)
            total, last = before + self.known_score(w), i + 1
            begin, left = i, before
            while True:
                at = len(stack) - 1
                while at >= 0 and stack[at][2] >= left:
                    at -= 1
                if at < 0 or stack[at][3] >= total:
                    stack.append([begin, i + 1, left, total])
                    break
                begin, left = stack[at][0], stack[at][2]
                del stack[at:]
        return [(int(b), int(e), r - l) for b, e, l, r in stack]

    def known_score(self, word: bytes) -> float:
        return self.known.get(word) or self.score(word)

    def expected(self, score: float, n: int) -> float:
        return self.k * n * math.exp(-self.lam * score)

    def passages(self, words: list[bytes]) -> tuple[list[float], list[tuple[int, int, float]]]:
        """Features of the text for the logistic curve, and its significant passages."""
        found = self.segments(words)
        if not found:
            return [0.0, 0.0, 0.0], []
        n = len(words)
        logs = [-math.log10(max(self.expected(s, n), 1e-300)) for _, _, s in found]
        good = [(f, x) for f, x in zip(found, logs, strict=True) if x > -math.log10(ALPHA)]
        return [max(0.0, min(30.0, max(logs)) + 3), math.log1p(len(good)), math.log1p(sum(x for _, x in good))], [f for f, _ in good]

    def probability(self, features: list[float]) -> float:
        if self.weights is None:
            return self.share
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of a ridge logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def rising(x: np.ndarray, y: np.ndarray) -> list[float]:
    """logistic() over the features whose weights are positive: more evidence never lowers a score."""
    used = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, used], y)
        if min(w[1:], default=0.0) >= 0:
            break
        used.pop(int(np.argmin(w[1:])))
    out = [w[0], *[0.0] * x.shape[1]]
    for i, value in zip(used, w[1:], strict=True):
        out[1 + i] = value
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either kind that hold a feature, summed over the task's rows."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen[toxic].update({f for w in set(words_of(text)) for f in features_of(w)})
            seen[toxic][b""] += 1
    keys = list(seen[0] | seen[1])
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], names=["feature", "clean", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, toxic) of the sample."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # train_docs rows of two numbers at most: small enough to broadcast at any input size.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Copies of one text count once. The sample is read three times, and never more than train_docs texts.
    rows = cut(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    counts = rows.mapInArrow(tidy(counted), "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    whole = counts.where(F.octet_length("feature") == 0).first()
    n0, n1 = (whole["clean"], whole["toxic"]) if whole else (0, 0)
    if not n0 or not n1:
        model = Model({}, {})
        model.share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return model
    prior = PRIOR_SHARE * (n0 + n1)
    a = F.lit(prior / (n0 + n1)) * (F.col("clean") + F.col("toxic"))
    log_odds = F.log((F.col("toxic") + a) / (n1 + prior - F.col("toxic") - a)) - F.log((F.col("clean") + a) / (n0 + prior - F.col("clean") - a))
    strong = counts.where("octet_length(feature) > 0 and toxic > 0").select("feature", log_odds.alias("score"), (log_odds / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))).alias("z"), ((F.col("clean") + a) / (n0 + prior)).alias("chance"))
    # Bounded by the sample: words and stems of train_docs documents.
    kept = strong.where((F.col("z") >= Z_LEAST) & (F.col("score") >= SCORE_LEAST)).collect()
    model = Model({bytes(r["feature"]): r["score"] for r in kept}, {bytes(r["feature"]): r["chance"] / 100 for r in kept})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = words_of(text)
                out.append((len(words), max((s for _, _, s in m.segments(words)), default=0.0), toxic, *m.passages(words)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([float(r[i]) for r in out], pa.float64()) for i in range(6)], names=list("nstabc"))

    # Six numbers for each document of the sample.
    x = np.array([tuple(r) for r in rows.mapInArrow(measured, "n double, s double, t double, a double, b double, c double").collect()])
    clean = x[x[:, 2] == 0]
    chance = np.exp(-model.lam * clean[:, 1])[clean[:, 1] > 0].mean() if (clean[:, 1] > 0).any() else 1.0
    model.k = max(1.0, float((clean[:, 1] > 0).sum())) / max(1.0, float(clean[:, 0].sum()) * chance)
    shared.unpersist()
    return calibrated(model, rows)


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with the logistic curve fitted to rows (text, toxic) of the sample."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[*shared.value.passages(words_of(t))[0], float(y)] for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.float64()) for i in range(4)], names=list("abct"))

    x = np.array([tuple(r) for r in rows.mapInArrow(measured, "a double, b double, c double, t double").collect()])
    model.weights = rising(x[:, :3], x[:, 3])
    model.known = {}
    return model


PASSAGES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scored(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False, names: tuple[str, str] = ("score", "passages")) -> DataFrame:
    """docs with score and passages (word positions begin to end, and score); its text only if keep_text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text, BLOCK_BYTES):
                got = [m.passages(words_of(t)) for t in batch.column(text).to_pylist()]
                kept = batch if keep_text else batch.drop_columns([text])
                score = pa.array([m.probability(f) for f, _ in got], pa.float64())
                spans = pa.array([[{"begin": b, "end": e, "score": s} for b, e, s in p] for _, p in got], PASSAGES)
                yield pa.RecordBatch.from_arrays([*kept.columns, score, spans], names=[*kept.schema.names, *names])
        m.known.clear()

    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    spans = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    return docs.mapInArrow(tidy(run), T.StructType([*kept, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], spans)]))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under 0.5, learnt from labels without the held-out fifth."""
    model = learn(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    found = scored(docs, model, keep_text=True, names=("__score", "__passages"))
    return found.where(F.col("__score") < 0.5).select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt without the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return scored(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
