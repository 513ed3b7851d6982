"""Ranked search against a plain one over all pairs, in one block and in many."""

import collections
import math
import re

import numpy as np
import pytest

from sparkfacts.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, term string, n long, tfs string, score double, item_id long, rank int"
ITEMS = "item_id long, text string, term string, k int, block int, reps string, doc_id long"


def words(x):
    return TERM.findall((x or "").translate(LOWER))


def plain(docs, items, k=10):
    found = [(i, collections.Counter(w), len(w)) for i, t in docs if (w := words(t))]
    df, count = collections.Counter(t for _, c, _ in found for t in c), len(found)
    total, out = sum(n for *_, n in found), []
    for item_id, text in set(items):
        scored = []
        for doc_id, each, n in found:
            m = 25 + 75 * n * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * each[t] // (1000 * each[t] + 8 * m)) for t in words(text) if t in each)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if null else doc_id, -s) for r, (s, null, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame([(*r, "t", 1, "x", 2.0, 5, 6) for r in docs], DOCS), spark.createDataFrame([(*r, "t", 1, 2, "x", 3) for r in items], ITEMS)


@pytest.mark.parametrize("block,matches", [(lexical.BLOCK, lexical.MATCHES), (7, 50)])
def test_search(spark, monkeypatch, block, matches):
    monkeypatch.setattr(lexical, "MATCHES", matches)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "é", "naïve", "李雷", "X1", "x1", "a" * 50, "A" * 50, "b" * 33]
    some = lambda n: " ".join(rng.choice(vocabulary, n, p=(p := 1 / np.arange(1, len(vocabulary) + 1)) / p.sum()))
    docs = [(i - 20, some(int(rng.integers(1, 60)))) for i in range(150)]
    docs += [(7, "W1,w2;É—x1"), (7, "W1,w2;É—x1"), (3, "copy w5"), (4, "copy w5"), (5, "copy w5"), (None, "copy w5 w5"), (None, None), (200, ""), (201, "., !"), (202, some(20_000)), (203, "w3 " * 5000)]
    items = [(i, some(int(rng.integers(1, 30)))) for i in range(12)] + [(20, "copy"), (20, "copy"), (20, "w5 w5 nothing"), (None, "x1 " + "A" * 50), (21, None), (22, "?"), (23, "absent")]
    got = sorted((tuple(r) for r in lexical.search(*tables(spark, docs, items), block=block).collect()), key=repr)
    assert got == plain(docs, items)


def test_long_texts_are_cut_at_terms(monkeypatch):
    text = "".join(["ab, c" * 50, "x" * 40, " end"] * 9).encode()
    whole = lexical.terms(text)
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.terms(text) == whole and whole[0] == len(words(text.decode()))


def test_radix_order_is_stable():
    keys = np.random.default_rng(1).integers(0, 1 << 36, 5000) // 1000 * 7
    for bits, x in ((16, keys & 0xFFFF), (31, keys & 0x7FFFFFFF), (37, keys)):
        assert (lexical.radix_order(x, bits) == np.argsort(x, kind="stable")).all()


def test_lengths_beyond_64_bits():
    assert lexical._lengths(np.array([10**9]), 10**9, 10**12).tolist() == [25 + 75 * 10**18 // 10**12]
    assert lexical._lengths(np.array([4 * 10**9]), 10**9, 10**12).tolist() == [25 + 300 * 10**18 // 10**12]


def test_empty(spark):
    docs, items = tables(spark, [(1, "a b")], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical.search(d, i).collect() == []
