"""Pairs of near copies tested in rounds, whatever the order of shingles."""

import random

import numpy as np
import pytest

from tracelake.llm import near, simhash

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    rnd, rows = random.Random(5), []
    for group in range(25):
        base = [rnd.choice(WORDS) for _ in range(120)]
        for _ in range(4):
            own = list(base)
            for _ in range(2):
                own[rnd.randrange(120)] = rnd.choice(WORDS)
            rows.append((len(rows), " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def kept(docs):
    return {r["doc_id"] for r in simhash.one_of_each(docs).collect()}


def test_rounds_find_the_same(docs, monkeypatch):
    want, asked = kept(docs), []
    once = near.tested_at_once
    monkeypatch.setattr(near, "PAIRS_A_ROUND", 10)
    monkeypatch.setattr(near, "BROADCAST_NAMES", 0)
    monkeypatch.setattr(near, "tested_at_once", lambda pairs, *own: asked.append(pairs.count()) or once(pairs, *own))
    assert kept(docs) == want and len(want) < 100
    assert len(asked) > 2 and max(asked) < sum(asked)


def test_sample_decides_nothing(docs, monkeypatch):
    """The sampled order of shingles may be any: none, or all of them in reverse."""
    want = kept(docs)
    monkeypatch.setattr(near, "common_shingles", lambda texts: np.zeros(0, np.uint64))
    assert kept(docs) == want
    every = np.unique(np.concatenate([near.shingle_set(r["text"]) for r in docs.collect()]))[::-1]
    monkeypatch.setattr(near, "common_shingles", lambda texts: every)
    assert kept(docs) == want
