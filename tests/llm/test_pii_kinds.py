"""Kinds that the method adds: check digits by plain code, and words nearby that decide."""

import re
import zlib

import numpy as np

from sparkfacts.llm import pii

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
COLUMNS = "doc_id long, text string, lang string, kind string, spans string, m string"


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "k", "s", "m") for i, t in enumerate(texts)], COLUMNS)
    return [[(s.kind, t[s.start : s.end]) for s in r.spans if s.kind not in pii.BASE] for r, t in zip(sorted(pii.find_pii(df).collect(), key=lambda r: r.doc_id), texts)]


def github(rng):
    body = "".join(rng.choice(list(BASE62), 30))
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        tail = BASE62[d] + tail
    return "ghp_" + body + tail


def iso7064(digits):
    p = 10
    for d in digits[:10]:
        s = (int(d) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(digits[10])


def test_secrets_need_a_word(spark):
    h = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'x token = "{h}" y', f'TOKEN = "{h.upper()}"!!', f"commit {h} y", f"api_key: {h}", "token = " + "a" * 40, "token abcdefghijklmnopqrstu", f"keyboard {h}", f"my-secret={h}==", f"token {'x' * 60} {h}", None or ""]
    got = found(spark, texts)
    assert [len(g) for g in got] == [1, 1, 0, 1, 0, 0, 0, 1, 0, 0]
    assert got[0] == [("secret", h)] and got[3] == [("secret", h)]


def test_check_digits(spark):
    rng = np.random.default_rng(6)
    good = github(rng)
    dnis = [f"{n:08d}{letter}" for n, letter in zip(rng.integers(0, 10**8, 200), rng.choice(list("TRWAGMYFPDXBNJZSQVHLCKEUIO"), 200))] + ["12345678Z"]
    taxes = ["".join(map(str, [rng.integers(1, 10), *rng.integers(0, 10, 10)])) for _ in range(200)] + ["86095742719"]
    nirs = [f"{rng.integers(1, 3)}{rng.integers(0, 100):02d}{rng.integers(1, 13):02d}{rng.integers(0, 10**8):08d}{rng.integers(0, 98):02d}" for _ in range(400)]
    nirs += [n[:13] + f"{97 - int(n[:13]) % 97:02d}" for n in nirs[:50]]
    routes = [f"{n:09d}" for n in rng.integers(0, 10**9, 200)] + ["021000021", "000000000"]
    texts = [f"key {good} x", f"key {good[:-1]}{'0' if good[-1] != '0' else '1'} x", "AKIA" + "ABCDEFGHIJKLMNOP", *(f"dni {x} y" for x in dnis), *(f"IdNr {x}" for x in taxes), *(f"n {x} y" for x in nirs), *(f"routing {x}" for x in routes), "part 021000021", "n 86095742719"]
    got = [{k for k, _ in g} for g in found(spark, texts)]
    assert "api_key" in got[0] and "api_key" not in got[1] and "api_key" in got[2]
    at = 3
    for kind, values, valid in (
        ("dni", dnis, lambda x: x[8] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(x[:8]) % 23]), ("tax_id", taxes, iso7064), ("nir", nirs, lambda x: int(x[13:]) == 97 - int(x[:13]) % 97),
        ("routing", routes, lambda x: sum(int(d) * w for d, w in zip(x, (3, 7, 1) * 3)) % 10 == 0 and x != "000000000"),
    ):
        want = [valid(x) for x in values]
        assert [kind in g for g in got[at : at + len(values)]] == want and 0 < sum(want) < len(want), kind
        at += len(values)
    assert got[at:] == [set(), set()]  # no word says what they are


def test_long_texts(spark):
    h = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    text = ("word " * 9 + f"token {h} ") * 500 + "a1" * 50_000
    (got,) = found(spark, [text])
    assert len(got) == 500 == len(re.findall(h, text))
