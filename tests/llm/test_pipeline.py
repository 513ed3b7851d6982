"""The stages on a small corpus with planted cases, against what each must keep."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from sparkfacts.llm.common import staged

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(900)]
    text = lambda n=120: " ".join(rng.choice(words, n))
    rows, labels, bench = [], [], [(i, text(25)) for i in range(5)]
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, text() + (" zzvile qqrot kkscum" * 2 if toxic else "")))
        labels.append((i, 1, int(toxic)))
    base = rows[1][1].split()
    rows += [(400 + k, " ".join(base[:50] + ["new", "words"] + base[50:])) for k in range(4)]
    rows += [(500, rows[2][1]), (501, rows[2][1]), (600, text(40) + " " + bench[2][1] + " " + text(40)), (700, None), (701, ""), (702, "x"), (702, "x")]
    d = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", ["b", "a", None][i % 3], len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        kept[name] = sorted(r.doc_id for r in docs.collect())
    clean = {i for i in range(300) if i % 5} | {400, 401, 402, 403, 500, 501, 600, 700, 701, 702}
    assert set(kept["toxicity"]) == clean and kept["toxicity"].count(702) == 2
    unique = clean - {400, 401, 402, 403, 500, 501} - {701}
    assert kept["near_duplicates"] == sorted(unique)
    assert kept["decontamination"] == sorted(unique - {600})
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(map(kept["mixing"].count, kept["mixing"])) <= 3
    out = pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in out) == kept["mixing"]
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_are_as_like_as_they_count(spark, monkeypatch):
    """Repeated lines weigh once, and links are what the exact index of distinct shingles says."""
    from sparkfacts.llm import simhash

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n=100: " ".join(rng.choice(words, n))
    line = text(12)
    rows = [(i, text() + (" " + line) * 20) for i in (1, 2)]  # little alike but for one line
    own = text(150)
    rows += [(10, own), (11, own + (" " + line) * 20)]  # alike but for one line, 20 times
    base = text(200).split()
    rows += [(20 + k, " ".join("new" + str(k) if j in rng.choice(200, k % 7, replace=False) else w for j, w in enumerate(base))) for k in range(40)]
    rows += [(80, None), (81, ""), (None, own)]
    kinds = lambda t: set(zip(*((t or "").split()[i:] for i in range(5)))) or {t or ""}
    sets = {i: kinds(t) for i, t in rows if i is not None}
    low = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            low[i] = min(low[j] for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], COLUMNS)
    assert low[2] == 2 and low[11] == 10 and low[81] == 80
    for dense in (8, 0):
        monkeypatch.setattr(simhash, "DENSE", dense)
        kept = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect() if r.doc_id is not None)
        assert kept == sorted(set(low.values()))
