"""Rows, not doc_ids, are what stages keep and drop; plain versions of op1 and op7; what a shard opens."""

import collections
import re

import numpy as np

import corpus_pipeline as pipeline
from sparkfacts.llm import decontamination, mixing, token_output, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, copies int, k string, row int, doc string, c int, label int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 5, "k", n, "d", 1, 2) for n, (i, t, s) in enumerate(rows)], COLUMNS)


def some_text(rng, n):
    return " ".join(rng.choice([f"w{i}" for i in range(3000)], n))


def test_near_copies_by_row(spark):
    rng = np.random.default_rng(5)
    a, b, c, e = (some_text(rng, 60) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " new end", "x"), (3, c, "x"), (3, a, "x"), (None, e, "y"), (None, b, "y"), (None, None, "y"), (9, "", "y"), (4, c, "x"), (4, c, "x")]
    docs = docs_of(spark, rows)
    out = pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("1", a), ("1", b), ("3", c), ("None", e), ("9", "")])


def test_contaminated_by_row(spark, tmp_path):
    rng = np.random.default_rng(6)
    item = some_text(rng, 20)
    spark.createDataFrame([(1, item), (2, "Is 7 prime"), (3, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [some_text(rng, 30) for _ in range(4)]
    rows = [(1, "so " + item, "x"), (1, clean[0], "x"), (None, item, "x"), (None, clean[1], "x"), (2, clean[2] + " Is 7 prime? " + clean[3], "x"), (3, "two words", "x"), (3, "Is 8 prime", "x")]
    docs = docs_of(spark, rows)
    out = pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r["row"] for r in out.collect()) == [1, 3, 5, 6]
    judged = decontamination.judge(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in judged) == sorted([("1", 1), ("1", 0), ("None", 1), ("None", 0), ("2", 1), ("3", 0), ("3", 0)])


def test_mix_gives_copies_to_their_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i % 4 or None, some_text(rng, 5 + (i * 37) % 90), ["a", "b", None][i % 3]) for i in range(120)] + [(1, "same text", "a")] * 5
    docs = docs_of(spark, rows)
    out = pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
        assert (r.doc_id, r.text, r.source) == rows[r["row"]]
    want = {r.source: r.t for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "t").collect()}
    goal = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert dict(got) == want and all(abs(got[s] - goal[s]) <= 2 for s in got)


def plain_windows(text, width, literal_only):
    """(hashable window, its slots) of a text, by the rules of the module's docstring, word by word."""
    words = []
    for w in text.split():
        core = re.sub(r"^[^\w$€£+-]+|[^\w%°]+$", "", w)
        if any(ch.isalnum() for ch in core):
            words.append(core)
    kind = ["<n>" if re.fullmatch(r"\d+", w) else "<p>" if w[0].isupper() and w[1:].islower() and len(w) > 1 else None for w in words]
    low = [w.lower() for w in words]
    width = min(width, len(words))
    for i in range(len(words) - width + 1):
        span = range(i, i + width)
        yield ("plain", *(low[j] for j in span)), ()
        if not literal_only and 2 * sum(kind[j] is None for j in span) >= width:
            seen = {}
            yield ("template", *(kind[j] or low[j] for j in span)), tuple(seen.setdefault((kind[j], low[j]), len(seen)) for j in span if kind[j])


def test_decontamination_against_plain_windows(spark):
    rng = np.random.default_rng(8)
    voc = ["cat", "sat", "on", "the", "mat", "Ann", "Bob", "7", "12", "and", "ran"]
    items = [" ".join(rng.choice(voc, int(rng.integers(3, 16)))) for _ in range(60)]
    texts = []
    for _ in range(300):
        own = items[int(rng.integers(60))].split()
        if rng.random() < 0.6:  # other names and numbers, sometimes mixed up
            own = [{"Ann": "Eve", "Bob": "Ann" if rng.random() < 0.5 else "Eve", "7": "31", "12": "7"}.get(w, w) for w in own]
        texts.append(" ".join([*rng.choice(voc, int(rng.integers(0, 6))), *own, *rng.choice(voc, int(rng.integers(0, 6)))]))
    known = collections.defaultdict(set)
    for t in items:
        n = len(t.split())
        for w, s in plain_windows(t, 10, n < decontamination.SHORTEST):
            known[w].add(s)
    widths = {min(10, len(t.split())) for t in items}
    want = {i: int(any(s in known.get(w, ()) for width in widths if width <= len(t.split()) for w, s in plain_windows(t, width, width < decontamination.SHORTEST))) for i, t in enumerate(texts)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontamination.judge(docs_of(spark, [(i, t, "x") for i, t in enumerate(texts)]), bench).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_toxicity_score_is_the_sum_over_distinct_grams(spark):
    rng = np.random.default_rng(9)
    rows = [(i, some_text(rng, 20) + (" злой ÄRGER 毒" if i % 3 == 0 else ""), "x") for i in range(90)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    mask = (1 << 64) - 1

    def z(text):
        codes, found = [ord(ch) + 1 for ch in text.lower()], set()
        for n in toxicity.ORDERS:
            for i in range(len(codes) - n + 1):
                h = codes[i]
                for x in codes[i + 1 : i + n]:
                    h = (h * 0xD6E8FEB86659FD93 + x) & mask
                found.add((((h ^ (h >> 32)) * 0xC2B2AE3D27D4EB4F) & mask) >> (64 - toxicity.BITS))
        return model.bias + sum(float(model.weights[h]) for h in found if model.kept[h])

    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - 1 / (1 + np.exp(-z(rows[r.doc_id][1])))) < 1e-6


def test_access_opens_few_blocks():
    ids = np.random.default_rng(1).integers(0, 40_000, 500_000)
    w = token_output.WaveletMatrix.from_bytes(token_output.WaveletMatrix.build(ids).to_bytes())
    assert w.access(123_456) == ids[123_456] and len(w.opened) <= w.width
    assert [w.access(int(i)) for i in (0, 77, 499_999)] == ids[[0, 77, 499_999]].tolist()
    assert len(w.opened) <= token_output.HELD_BLOCKS
    assert w.count(int(ids[5])) == int((ids == ids[5]).sum())


def test_one_document_of_a_shard(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_output.default_tokenizer())
    rows = [(i % 7, f"The number {i} of Straße and été", "x") for i in range(20)]
    shards = token_output.write_shards(docs_of(spark, rows), shard_tokens=60)
    got = token_output.document(shards, 3)
    assert sorted(got) == sorted(tk.encode(t, add_special_tokens=False).ids + [2] for i, t, _ in rows if i == 3)
    files = {r.f for r in shards.selectExpr("_metadata.file_path f").collect()}
    assert len(files) == shards.count() > 1


def test_folded_words_are_the_librarys():
    enc = token_output.encoder(token_output.default_tokenizer())
    texts = ["The THE the tHe don't DON'T I'LL x1Y2 A1", "H\u0331at H\u0331 T\u0308 plain Words", "<|ENDOFTEXT|> Mixed <|endoftext|> Words", "ÀÉ İstanbul ẞ STRASSE", "Word! wOrd!! WORD$$$ a-B_c", "", "\0 \x1f"] + ["Same Words Again And again"] * 3
    got = enc.many([t.encode() for t in texts])
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(g, enc.type).tolist() for g in got] == want
