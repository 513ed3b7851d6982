"""Statistics, normal equations and the isotonic curve against plain ones; accuracy on held-out rows; awkward tables."""

import itertools
import zlib

import numpy as np
import pytest

from sparkfacts.llm import quality

DOCS = "doc_id long, text string, lang string, source string, x string, y int, fold string, score string, v string, s int, quality int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", "x", 1, "f", "t", "v", 2, 0) for r in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def good(rng):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(20, 120))) + "."


def bad(rng, i):
    x = good(rng)
    return [x.upper().replace(" ", "!! "), x.replace(" ", "$$$ "), " ".join([x[:6]] * 40), x.replace(" ", " | ")][i % 4]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(2)
    return [(i, bad(rng, i // 5) if i % 5 == 0 else good(rng)) for i in range(900)]


def test_statistics():
    x = quality.statistics("Ab cd ab É1!\ncd ab ab\ncd ab ab".encode())
    of = dict(zip(quality.STATISTICS, x))
    words = "Ab cd ab É1! cd ab ab cd ab ab".split()
    pairs = list(itertools.pairwise(words))
    assert len(x) == len(quality.STATISTICS)
    assert of["log_chars"] == pytest.approx(np.log1p(30)) and of["log_words"] == pytest.approx(np.log1p(10))
    assert of["share_upper"] == pytest.approx(1 / 30) and of["share_other"] == pytest.approx(1 / 30) and of["share_digits"] == of["share_calls"] == pytest.approx(1 / 30)
    assert of["distinct_words"] == len(set(words)) / 10 and of["distinct_pairs"] == pytest.approx(len(set(pairs)) / 9)
    assert of["same_as_before"] == pytest.approx(sum(a == b for a, b in pairs) / 9) and of["top_word"] == 0.5
    assert of["equal_lines"] == pytest.approx(1 / 3) and of["word_length"] == pytest.approx(np.mean([len(w.encode()) for w in words]))
    assert (quality.statistics(b"") == 0).all()


def test_long_texts_are_taken_in_pieces(monkeypatch):
    raw = ("word other thing. " * 3000).encode()
    whole = quality.statistics(raw)
    monkeypatch.setattr(quality, "PIECE", 997)
    cut = quality.statistics(raw)
    exact = [i for i, s in enumerate(quality.STATISTICS) if s in ("log_chars", "log_words", "byte_entropy", "word_length", "upper_of_letters") or s.startswith("share_")]
    assert cut[exact] == pytest.approx(whole[exact])


def test_isotonic():
    rng = np.random.default_rng(4)
    for _ in range(20):
        y, w = rng.random(7), rng.integers(1, 5, 7).astype(float)
        got = quality.isotonic(y, w)
        # min over ends of max over starts of weighted means is the isotonic fit
        want = [min(max(np.average(y[a : b + 1], weights=w[a : b + 1]) for a in range(i + 1)) for b in range(i, 7)) for i in range(7)]
        assert got == pytest.approx(want)


def test_weights_are_the_ridge_of_all_training_rows(spark, corpus, monkeypatch):
    monkeypatch.setattr(quality, "ROWS", 100)  # several partitions
    monkeypatch.setattr(quality, "PENALTIES", (1e-3,))
    known = quality.described(docs_of(spark, corpus))
    model = quality.train(known, labels_of(spark, [(i, int(i % 5 > 0), 0) for i, _ in corpus]), features=40)
    rows = [(quality.statistics(t.encode()), float(i % 5 > 0)) for i, t in corpus if not held(i)]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(np.sqrt(np.maximum(x.var(0), 1e-8)), rel=1e-3)
    z = model.features(x)
    d = np.diag([1e-3 * len(y)] * 40 + [1e-9])
    assert model.weights == pytest.approx(np.linalg.solve(z.T @ z + d, z.T @ y), abs=1e-6)
    assert (np.diff(model.curve[0]) > 0).all() and (np.diff(model.curve[1]) > 0).all()


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    k = len(quality.STATISTICS)
    m = quality.Model(np.zeros(k), np.ones(k), rng.normal(0, 1 / (quality.WIDTH * np.sqrt(k)), (k, 20_000)), rng.uniform(0, 2 * np.pi, 20_000), np.zeros(20_001), (np.zeros(1), np.zeros(1)))
    x = rng.normal(size=(6, k))
    z = m.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2 * k))
    assert z @ z.T == pytest.approx(want, abs=0.04)


def test_held_out_accuracy_and_nothing_learned_from_held_out(spark, corpus):
    docs = docs_of(spark, corpus)
    truth = {i: int(i % 5 > 0) for i, _ in corpus}
    got = quality.judge(docs, labels_of(spark, [(i, y, 0) for i, y in truth.items()])).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) >= 0.98
    lies = [(i, 1 - y if held(i) else y, 0) for i, y in truth.items()]
    again = {r.doc_id: r.score for r in quality.judge(docs, labels_of(spark, lies)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in got)


def test_awkward_rows_and_labels(spark, corpus):
    extra = [(None, None), (None, "no id"), (901, ""), (902, None), (903, " \n\t"), (904, "w " * 300_000), (4, corpus[4][1]), (4, "other text"), (905, "\0\1\2"), (906, "é李" * 50)]
    docs = docs_of(spark, corpus + extra)
    labels = labels_of(spark, [(i, int(i % 5 > 0), 0) for i, _ in corpus] + [(4, 0, 0), (4, None, 0), (None, 1, 0), (901, 7, 0)])
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(corpus) + len(extra) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (901, 902)}) == 1


def test_without_labels(spark, corpus):
    docs = docs_of(spark, corpus[:20])
    for rows, want in (([], 0.5), ([(i, 1, 0) for i in range(20)], 1.0), ([(i, 0, 0) for i in range(20)], 0.0)):
        got = quality.judge(docs, labels_of(spark, rows)).collect()
        assert len(got) == 20 and all(abs(r.score - want) < 1e-3 for r in got)
    assert quality.judge(docs.limit(0), labels_of(spark, [])).collect() == []
