"""Near copies whose shingles of lowest hash all differ."""

import random

import numpy as np

from tracelake.llm import near, simhash


def similarity(x: str, y: str) -> float:
    a, b = near.shingle_set(x), near.shingle_set(y)
    shared = len(np.intersect1d(a, b))
    return shared / (len(a) + len(b) - shared)


def without_lowest(words: list[str], lowest: int) -> list[str]:
    """words with a new one in the middle of each of the shingles of lowest hash."""
    hashes = np.array(near.shingle_hashes(" ".join(words), near.SHINGLE), np.uint64)
    own = list(words)
    for at in np.argsort(hashes)[:lowest].tolist():
        own[at + 2] = f"new{at}"
    return own


def test_lowest_shingles_may_all_differ(spark):
    rnd, rows, far = random.Random(8), [], 0
    for group in range(6):
        base = [f"g{group}w{rnd.randrange(5000)}" for _ in range(1000)]
        own = without_lowest(base, 17)
        x, y = " ".join(base), " ".join(own)
        low = np.sort(near.shingle_set(x))[:17], np.sort(near.shingle_set(y))[:17]
        assert similarity(x, y) >= 0.8 and not len(np.intersect1d(*low))
        fps = simhash.fingerprints([near.shingle_set(x), near.shingle_set(y)])
        far += int(np.bitwise_count(fps[0] ^ fps[1])) > simhash.DISTANCE
        rows += [(2 * group, x), (2 * group + 1, y)]
    assert far >= 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [0, 2, 4, 6, 8, 10]
