"""Each operator against brute force, and on awkward tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfacts.llm import decontamination, langid, mixing, pii, simhash, substring_dedup, suffix_dedup, token_output, toxicity, vector_search
from sparkfacts.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, k string, h string, size string"
BASE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(20_000))
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, BASE), (5, BASE), (5, BASE), (6, BASE.replace("word30", "other")), (7, LONG), (8, "x"), (9, "é" * 300),
    (10, "start " + BASE + " end"), (None, "no id at all"), (None, None), (11, "a" * 5000), (12, LONG[5000:9000]), (13, "\0zero\0 bytes " + BASE[:200]),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ["en", None, "fr"][n % 3], ["b", "a", None][n % 3], n, "x", "y", "z", "s") for n, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, AWKWARD).limit(0)


def raw(t):
    return (t or "").encode()


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


# -- byte dedup


def brute_bytes(rows, length):
    seen, out = {}, []
    for d, b in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            at = seen.setdefault(b[p : p + length], (d, p))
            if at != (d, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return order(out)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(awkward, hot):
    got = order(map(tuple, suffix_dedup.dedup(awkward, hot_limit=hot).collect()))
    assert got == brute_bytes([(d, raw(t)) for d, t in AWKWARD], 100)


def test_suffix_dedup_random(spark):
    rng = np.random.default_rng(3)
    pool = [bytes(rng.integers(97, 100, rng.integers(20, 150)).astype(np.uint8)).decode() for _ in range(12)]
    rows = [(i, "".join(pool[j] for j in rng.integers(0, 12, 6))) for i in range(40)]
    got = order(map(tuple, suffix_dedup.dedup(frame(spark, rows)).collect()))
    assert got == brute_bytes([(d, raw(t)) for d, t in rows], 100)


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.dedup(empty).collect() == []


# -- word dedup


def brute_words(rows, width):
    docs = [(d, b.split()) for d, b in rows]
    count = collections.Counter(tuple(w[i : i + width]) for _, w in docs for i in range(len(w) - width + 1))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if count[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return order(out)


def test_substring_dedup(awkward):
    got = order(map(tuple, substring_dedup.dedup(awkward).collect()))
    assert got == brute_words([(d, raw(t)) for d, t in AWKWARD], 35)


def test_substring_dedup_random(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join(f"t{x}" for x in rng.integers(0, 3, rng.integers(3, 40))) for _ in range(10)]
    rows = [(i, " ".join(pool[j] for j in rng.integers(0, 10, 5))) for i in range(40)]
    got = order(map(tuple, substring_dedup.dedup(frame(spark, rows)).collect()))
    assert got == brute_words([(d, raw(t)) for d, t in rows], 35)


def test_substring_dedup_empty(empty):
    assert substring_dedup.dedup(empty).collect() == []


# -- SimHash


def brute_components(fps, ids, most, words):
    node = {}
    for f, i in zip(fps, ids):
        if i is not None:
            node[f] = min(node.get(f, i), i)
    keys = list(node)
    m = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, words)
    up = {i: i for i in node.values()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if np.bitwise_count(m[i] ^ m[j]).sum() <= most:
                a, b = sorted((find(node[keys[i]]), find(node[keys[j]])))
                up[b] = a
    return [None if i is None else find(node[f]) for f, i in zip(fps, ids)]


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("plan", [simhash.EXACT, simhash.SIMILAR])
def test_simhash(spark, monkeypatch, plan, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    words = BASE.split()
    near = [(100 + i, " ".join(words[:i] + ["z"] + words[i:])) for i in range(0, 60, 3)]
    got = simhash.near_duplicates(frame(spark, AWKWARD + near), plan).collect()
    assert len(got) == len(AWKWARD) + len(near)
    want = brute_components([bytes(r.fp) for r in got], [r.doc_id for r in got], plan.most, plan.words)
    assert [r.component_id for r in got] == want


def test_fingerprint_bits():
    import xxhash

    for text in (b"One two", b"", b"a b c d e f g a b c", LONG.encode()[:2000]):
        w = text.lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        assert simhash.fingerprint(text) == [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if w else 0]


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 107), (107, 103), (200, 200), (55, 300), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 107: 100, 55: 55, 300: 55, 301: 55}


# -- tokens


def test_tokens(awkward):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_output.default_tokenizer())
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read_documents(token_output.write_shards(awkward, shard_tokens=500)).collect())
    want = collections.Counter()
    for d, t in AWKWARD:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter(r[1:] for r in got) == want
    assert [r[1] for r in got if r[1] is not None] == sorted(r[1] for r in got if r[1] is not None)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n


def test_tokens_empty(empty):
    assert token_output.read_documents(token_output.write_shards(empty)).collect() == []


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = token_output.default_tokenizer()
    enc, tk, rng = token_output.Encoder(path), Tokenizer.from_file(path), np.random.default_rng(0)
    signs = [" ", "\n", "\t", "a", "Bc", "é", "É", "é", "'s", "'", "12", "²", "<|endoftext|>", "!?", "中", "İ", "Σ", "\x85", "\xa0", "\x1c", "ﬁ", "😀", "ß", "_"]
    for _ in range(3000):
        t = "".join(rng.choice(signs, rng.integers(0, 12)))
        assert np.frombuffer(enc.ids(t), enc.type).tolist() == tk.encode(t, add_special_tokens=False).ids, repr(t)


def test_wavelet_matrix():
    for n in (0, 1, 513, 3000):
        a = np.random.default_rng(n).integers(0, 40, n)
        w = token_output.WaveletMatrix.from_bytes(token_output.WaveletMatrix.build(a).to_bytes())
        assert w.decode().tolist() == a.tolist() == [w.access(i) for i in range(n)]
        for s in (0, 7, 39, 5000):
            at = np.flatnonzero(a == s).tolist()
            assert w.count(s) == len(at) and [w.find(s, k) for k in range(len(at))] == at
            assert w.count(s, n // 3, n // 2) == sum(n // 3 <= i < n // 2 for i in at)


def test_occurrences(spark):
    shards = token_output.write_shards(frame(spark, [(i, "the cat the dog") for i in range(20)]))
    the = int(np.frombuffer(token_output.Encoder(token_output.default_tokenizer()).ids("the"), "<u2")[0])
    assert shards.count() and token_output.occurrences(shards, the).agg(F.sum("n")).first()[0] == 40


# -- mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    got = mixing.targets([10, 1000, 1000, 0])
    assert got[0] == 30 and got[3] == 0 and sum(got) == pytest.approx(2010)
    assert got[1] / got[2] == pytest.approx(2)
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_fit_reaches_the_budget():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 60, 12))
        counts = rng.integers(1, 9, len(sizes))
        total = int((sizes * counts).sum())
        budget = int(rng.integers(0, total + 1))
        taken = mixing.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and int((sizes * taken).sum()) <= budget
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        assert budget - int((sizes * taken).sum()) <= budget - max(r for r in reach if r <= budget) + 2
    big = mixing.fit(np.array([3, 1000, 50_000]), np.array([10, 500, 40]), 1_234_569, capacity=1 << 12)
    assert int((np.array([3, 1000, 50_000]) * big).sum()) == 1_234_030  # threes add up to 30


def test_mix(spark, awkward):
    got = mixing.mix(awkward).collect()
    sizes = collections.Counter((r.doc_id, r.size) for r in got)
    assert sizes == collections.Counter((d, len(raw(t).split())) for d, t in AWKWARD)
    assert all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    by = collections.defaultdict(list)
    for n, (d, t) in enumerate(AWKWARD):
        by[["b", "a", None][n % 3]].append(len(raw(t).split()))
    goals = dict(zip(["a", "b", None], mixing.targets([sum(by["a"]), sum(by["b"]), sum(by[None])])))
    for r in got:
        assert r.source_size == sum(by[r.source]) and r.target == pytest.approx(goals[r.source])
    key = lambda r: repr(tuple(r))
    assert sorted(got, key=key) == sorted(mixing.mix(awkward.repartition(5)).collect(), key=key)


def test_mix_many(spark):
    rows = [(i, "w " * (i % 37 + (400 if i % 3 else 5))) for i in range(1500)]
    got = mixing.mix(frame(spark, rows)).toPandas()
    taken = got.fillna("~").groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert (abs(taken.t - taken.k) <= 2).all()


def test_mixed_documents(spark, awkward):
    taken = sum(r.copies for r in mixing.mix(awkward).collect())
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns and out.count() == taken


def test_mix_empty(empty):
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


# -- vectors


def brute_top(rows, k):
    ok = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)
            out += [(q, r + 1, i, -t) for r, (t, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("wave", [4096, 2])
def test_top_k(spark, wave):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 7).round(1)]) for i in range(130)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (220, [float("inf")] * 7), (240, [0.5, 0.5]), (241, []), (260, [1.0] * 7), (261, [1.0] * 7), (262, [1.0] * 7)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, label int")
    got = sorted(map(tuple, vector_search.top_k(df, df.filter("vec_id % 20 = 0"), wave=wave).collect()))
    assert got == brute_top(rows, 20)


def test_top_k_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_search.top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, 64 * 128)]
    assert vector_search.top_k(df.limit(0), df.limit(0)).collect() == []


# -- personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        double = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_pii(spark):
    rng = np.random.default_rng(4)
    signs = ["a", "B.", "@", "x@y.zz", ".", "-", " ", "4111 1111 1111 1111", "1", "25", "6", "255.1.2.3", "+1 (234) 567-8901", "+", "(", "é", "😀", "_", "%", ",", "\n"]
    rows = [(i, "".join(rng.choice(signs, rng.integers(0, 25)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x@y.zz " * 700), (1003, "9" * 30_000), (1004, "a" * 60_000 + "@"), (None, "a@b.c")]
    df = frame(spark, rows)
    df.write.mode("overwrite").parquet(path := spark.conf.get("spark.sql.warehouse.dir") + "/pii_rows")
    got = {r.doc_id: r for r in pii.find_pii(spark.read.parquet(path)).collect()}
    for i, t in rows:
        r = got[i]
        assert [f"{s.kind}:{s.start}:{s.end}" for k in pii.BASE for s in r[f"s_{k}"]] == brute_pii(t), repr(t)


def test_pii_checksums_and_context(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "IBAN GB83 WEST 1234 5698 7654 32."), (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789"), (5, "write to a@b.cd")]
    got = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    assert [len(got[i].s_iban) for i in (1, 2)] == [1, 0] and [len(got[i].s_ssn) for i in (3, 4)] == [1, 0]
    assert got[5].s_email[0].score == 1.0
    assert {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}[5] == "write to [email]"


def test_pii_empty(empty):
    assert pii.find_pii(empty).collect() == []


# -- classifiers


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(words, 30)) + (" zzvile qqrot" if toxic else "")))
        labels.append((i, 1, int(toxic), "x"))
    rows += [(900, None), (901, ""), (None, "zzvile"), (902, "zzvile qqrot " * 3000)]
    lab = spark.createDataFrame(labels + [(None, 0, 1, "x"), (3, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.judge(frame(spark, rows), lab).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(500))
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert got[900].score == got[901].score and got[900].predicted == 0 and got[902].predicted == 1
    kept = toxicity.keep_clean(frame(spark, rows), toxicity.train(frame(spark, rows), lab))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted} and kept.columns == frame(spark, rows).columns


def test_toxicity_without_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.judge(awkward, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.judge(awkward, one).collect()} == {0}
    assert toxicity.judge(empty, one).collect() == []


def walk(model_counts, langs, text):
    """Code lengths by walking the trees byte by byte."""
    data, out = langid.PAD + text.encode().translate(langid.PLAIN), []
    for li in range(len(langs)):
        bits = 0.0
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER, -1, -1):
                context, sym = data[i - k : i], data[i]
                tree = model_counts[li].get((k, context))
                if not tree:
                    continue
                total = sum(tree.values()) + len(tree)
                if sym in tree:
                    bits -= np.log2(tree[sym] / total)
                    break
                bits -= np.log2(len(tree) / total)
            else:
                bits += 8
        out.append(bits)
    return out


def test_langid(spark):
    rng = np.random.default_rng(1)
    voc = {"en": ["the", "and", "thing", "of"], "fr": ["les", "été", "dans", "çà"], "de": ["und", "straße", "nicht"]}
    rows = [(i, " ".join(rng.choice(voc[x], 12)), x) for i, x in ((i, list(voc)[i % 3]) for i in range(240))]
    df = spark.createDataFrame(rows + [(900, None, "en"), (901, "", "en"), (902, "123 !!", "fr"), (903, "the thing", None), (904, "ω", None), (None, "the", "en")], "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows]) == 1.0
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902)) and got[903].lang_pred == "en" and got[904].lang_pred != "und"
    # the laid-out costs are those of the trees
    counts = [collections.defaultdict(collections.Counter) for _ in model.langs]
    for i, t, x in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            data = langid.PAD + t.encode().translate(langid.PLAIN)
            for k in range(langid.ORDER + 1):
                for j in range(langid.ORDER, len(data)):
                    counts[model.langs.index(x)][k, data[j - k : j]][data[j]] += 1
    for c in counts:
        for (k, context), tree in list(c.items()):
            if k >= 2:
                c[k, context] = {s: n for s, n in tree.items() if n >= langid.MIN_COUNT}
    for text in ("the thing of été und", "zzzz qqqq", "straße"):
        assert model.code_lengths([text.encode()])[0] == pytest.approx(walk(counts, model.langs, text), rel=1e-4)


def test_langid_without_training(spark, awkward, empty):
    assert {r.lang_pred for r in langid.predict(awkward, langid.train(awkward.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert langid.predict(empty, langid.train(empty)).collect() == []
    assert langid.predict(awkward, langid.train(awkward)).count() == len(AWKWARD)


# -- decontamination

ITEM = "If Alice buys 5 apples and gives Bob 3 apples how many of the apples does Alice still keep for herself"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM, "x"), (2, "a train goes at 60 km for hours", "x"), (3, None, "x"), (4, "two words", "x"), (None, "no id but quite a few words here to make a window of ten", "x")], "item_id long, text string, doc_id string")
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("5", "17").replace("3", "4")
    mixed = ITEM.replace("does Alice", "does Bob")
    rows = [(1, "well " + ITEM + " ok"), (2, "so " + other), (3, mixed), (4, None), (5, ""), (6, BASE), (7, "A train goes at 80 miles for hours."), (8, ITEM.upper()), (9, "two words"), (None, other), (1, "well " + ITEM + " ok")]
    got = collections.Counter((r.doc_id, r.contaminated, r.item_id) for r in decontamination.judge(frame(spark, rows), bench).collect())
    assert got[1, 1, 1] == 2 and got[2, 1, 1] == 1 and got[None, 1, 1] == 1
    assert got[7, 1, 2] == 1
    assert all(got[i, 0, None] == 1 for i in (4, 5, 6, 9)) and sum(got.values()) == len(rows)
    # windows that span the swapped name are refused, the others still match
    whole = {r.doc_id: r.n_windows for r in decontamination.judge(frame(spark, rows[:3]), bench).collect()}
    assert 0 < whole[3] < whole[2]


def test_decontamination_ignores_case(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(1, "Well " + ITEM.upper() + " OK"), (2, ITEM.lower()), (3, ITEM.title()), (8, ITEM.upper()), (9, ITEM.upper().replace("APPLES", "PEARS"))]
    got = {r.doc_id: (r.contaminated, r.item_id, r.n_windows) for r in decontamination.judge(frame(spark, rows), bench).collect()}
    assert all(got[i][:2] == (1, 1) for i in (1, 2, 3, 8))
    assert got[8][2] == len(ITEM.split()) - 9 and got[9][2] < got[8][2]


def test_decontamination_of_windows_without_literals(spark):
    table, titles, short = "3 + 4 = 7 5 + 6 = 11 8 + 9 = 17 2 + 2 = 4 12 , 13", "The Old Man And The Sea Was Written By Ernest Hemingway In Cuba", "7 km 8 km 9"
    bench = spark.createDataFrame([(1, table), (2, titles), (3, short)], "item_id long, text string")
    other = table.replace("17", "18").replace("7", "6").replace("6", "5")
    rows = [(1, "well " + table + " ok"), (2, "so " + titles + "."), (3, titles.lower()), (4, "it is " + short + " away"), (5, other), (6, "7 km 8 km 10")]
    got = {r.doc_id: r.item_id for r in decontamination.judge(frame(spark, rows), bench).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: None, 6: None}


def test_decontamination_empty(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.contaminated == 0 for r in decontamination.judge(awkward, none).collect())
    assert decontamination.judge(empty, none).collect() == []
