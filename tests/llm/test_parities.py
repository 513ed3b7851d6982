"""Parities rule out no pair of sets that is alike enough, and most that are not."""

import numpy as np

from sparkfacts.llm import simhash


def sets(rng, common, own_a, own_b):
    h = np.unique(rng.integers(0, 1 << 63, common + own_a + own_b, dtype=np.uint64))
    a, b = np.concatenate((h[:common], h[common : common + own_a])), np.concatenate((h[:common], h[common + own_a :]))
    return np.sort(a), np.sort(b), common / len(h)


def reach(a, b, words=8):
    x, y = (np.array([simhash.parities(h, words)], np.uint64) for h in (a, b))
    return bool(simhash._may_reach(x[:, -1], y[:, -1], np.bitwise_count(x[:, :-1] ^ y[:, :-1]).sum(axis=1, dtype=np.int64))[0])


def test_bound_loses_nothing():
    rng = np.random.default_rng(1)
    refused = 0
    for _ in range(3000):
        a, b, index = sets(rng, int(rng.integers(1, 900)), int(rng.integers(0, 120)), int(rng.integers(0, 120)))
        if index >= 0.8:
            assert reach(a, b)
        refused += not reach(a, b)
    assert refused > 200
    assert reach(np.zeros(1, np.uint64), np.zeros(1, np.uint64))


def test_templates_send_few_pairs(spark):
    """Texts that share 200 of 240 words, of which none is to go: what is sent doesn't grow with the square."""
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(5000)])
    shared = " ".join(rng.choice(words, 200))
    rows = [(i, shared + " " + " ".join(rng.choice(words, 40)), "en", "s", 1) for i in range(300)]
    sent = []
    for n in (150, 300):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string, lang string, source string, n_chars long")
        marked = simhash._marks(docs, simhash.SIMILAR)
        distinct = simhash.staged(marked.selectExpr("node AS rep", "fp"), "templates")
        sent.append(simhash.candidates(distinct, simhash.SIMILAR, None).select("a", "b").distinct().count())
        assert simhash.keep_one(docs).count() == n
    assert sent[1] <= 300 < 0.01 * 300 * 299 / 2, sent
