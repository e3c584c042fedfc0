"""Crowded buckets of sets that are not similar."""

import random

import numpy as np

from tracelake.llm import near, simhash


def test_crowded_buckets_ask_for_no_texts(spark, monkeypatch):
    rnd = random.Random(3)
    line = " ".join(f"c{i}" for i in range(30))
    rows = [(n, " ".join(f"w{rnd.randrange(100_000)}" for _ in range(80)) + " " + line) for n in range(60)]
    docs, asked, whole = spark.createDataFrame(rows, "doc_id long, text string"), [], near.texts_of
    monkeypatch.setattr(near, "SMALL", 8)
    monkeypatch.setattr(near, "CROWD", 16)
    monkeypatch.setattr(near, "common_shingles", lambda texts: np.zeros(0, np.uint64))
    monkeypatch.setattr(near, "texts_of", lambda nodes, *own: asked.append(nodes.count()) or whole(nodes, *own))
    assert simhash.one_of_each(docs).count() == 60
    assert sum(asked) == 0
