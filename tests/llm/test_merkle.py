"""The manifest against a plain one, in one round and in many; proofs that fold and proofs that don't."""

import hashlib
import zlib

import pytest

from sparkfacts.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, digest string, rank int, _tie int, block int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        yield i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""
        i >>= 1


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    inner = {x: climb([y[2] for y in sorted(groups[x], key=lambda y: y[:3])]) for x in langs}
    outer = climb([inner[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, _, own, (doc_id, text, lang, source, n)) in enumerate(sorted(groups[x], key=lambda y: y[:3])):
            path = [*siblings(inner[x], i), *siblings(outer, k)]
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            folded = leaf(doc_id, text, lang, source, n + 1 if bad and n is not None else n)
            for left, s in path:
                folded = h(s, folded) if left else h(folded, s)
            out.append((doc_id, own, inner[x][-1][0], outer[-1][0], h(*(s for _, s in path)), folded, folded == outer[-1][0]))
    return sorted(out, key=repr)


def rows_of(n, langs):
    rows = [(i, f"text {i} é" * (i % 5), langs[i * i % len(langs)], None if i % 11 == 0 else f"s{i % 3}", None if i % 13 == 0 else i) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "", langs[0], "", 0), (3, "other", langs[0], "s", 5), (3, "other", langs[0], "s", 5), (4, "x" * 200_000, "zz", "s", 1)]


@pytest.mark.parametrize("bits,top", [(merkle.BITS, merkle.TOP), (1, 3), (2, 8), (3, 40)])
@pytest.mark.parametrize("langs", [["en", None, "é", "a:"], [f"l{i}" for i in range(60)]])
def test_manifest(spark, bits, top, langs):
    rows = rows_of(150, langs)
    docs = spark.createDataFrame([(*r, "t", 1, "d", 2, 3, 4) for r in rows], COLUMNS)
    got = sorted((tuple(r) for r in merkle.audit(docs, bits, top).collect()), key=repr)
    want = plain(rows)
    assert got == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


def test_proofs_hold_for_their_rows_alone(spark):
    rows = rows_of(40, ["en", "fr"])
    made = merkle.build(spark.createDataFrame([(*r, "t", 1, "d", 2, 3, 4) for r in rows], COLUMNS), bits=2)
    proofs = made.proofs().collect()
    steps = [merkle._unpack(bytes(r.proof)) for r in proofs]
    assert len(proofs) == len(rows) and all(merkle.fold(r.leaf.encode(), s).decode() == made.root for r, s in zip(proofs, steps))
    one, two = sorted({r.leaf for r in proofs})[:2]
    assert all(merkle.fold(two.encode(), s).decode() != made.root for r, s in zip(proofs, steps) if r.leaf == one)


def test_one_row_is_its_own_root(spark):
    rows = [(7, "a", "en", "s", 1)]
    (got,) = merkle.audit(spark.createDataFrame([(*rows[0], "t", 1, "d", 2, 3, 4)], COLUMNS)).collect()
    assert got.leaf == got.subroot == got.root and [tuple(got)] == plain(rows)


def test_empty(spark):
    assert merkle.audit(spark.createDataFrame([], COLUMNS)).collect() == []
