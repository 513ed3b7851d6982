"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles; more
than one 64-bit word of it comes from mixing the same hash again. Distinct fingerprints
(each with its smallest doc_id) are joined with themselves: by the pigeonhole principle
two that differ in at most r of a table's bits agree on one of r + 1 blocks of them, so
each block's value is a subtree whose node pairs are traversed together, adding up
differing bits and dropping pairs over the budget. Links are cut to a spanning forest in
each task, and components follow by star contraction.

A block value with more than HOT fingerprints is dealt to pairs of salts, so that no task
gets more than about 2 * HOT / SALTED of one; copies of a text are one fingerprint and
never form pairs.

``similar`` asks for similarity itself: fingerprints of distinct shingles only nominate
pairs, each once; a pair is a link if the exact Jaccard index of its two sets of shingles
is LEAST or more. Parities of the shingles' hashes go along with a table's bits: they bound
the index from above, so that most pairs below LEAST never leave the task that meets them.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer
words than a shingle count as one; repeated rows share a component; null doc_ids pass
through with a null component; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, as_rows, no_null_ids, null_ids_back, staged, table, texts
from .graph import components
from .rolling import bits_for, column_bitmap, member, mix, tidy

SEED = 42
HOT = 20_000
FRONT = 1 << 20  # node pairs expanded at a time
LEAVES = 8  # node pairs of at most so many leaves each side are compared leaf by leaf


@dataclass(frozen=True)
class Plan:
    """words: 64-bit words of a fingerprint, cut into ``tables`` of ``bits`` bits, each joined
    within ``radius``; a found pair is a link if all words differ in ``most`` bits at most,
    ``once``: repeated shingles count once."""

    shingle: int = 3
    words: int = 1
    tables: int = 1
    bits: int = 64
    radius: int = 3
    most: int = 3
    once: bool = False
    parity: int = 0  # 64-bit words of parities that ``similar`` holds pairs to


EXACT = Plan()
#: Five-word shingles at a similarity of 0.8: cosine 2s/(1+s) of equal sets, an angle of 0.15 pi, 78 of 512 bits expected,
#: with a deviation of 8. ``most`` lies above by more than one, so that few pairs at 0.8 are missed.
SIMILAR = Plan(shingle=5, words=8, tables=12, bits=40, radius=4, most=88, once=True, parity=8)
#: Least Jaccard index of a link of ``similar``, as a fraction of whole numbers.
LEAST = (4, 5)
#: How many nearest candidates a text sends from each task in the first round; 0: all at once.
DENSE = 8


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(raw: bytes, shingle: int = 3, once: bool = False) -> np.ndarray:
    """Hashes of a text's shingles, in order of the text or, ``once``, each once and sorted."""
    import xxhash

    w = raw.lower().split()
    digest, n = xxhash.xxh64_intdigest, max(1, len(w) - shingle + 1) if w else 0
    h = np.fromiter((digest(b" ".join(w[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)
    return np.unique(h) if once else h


def fingerprint(raw: bytes, shingle: int = 3, words: int = 1, once: bool = False) -> list[int]:
    """Unsigned 64-bit words; bit i is set if it is in over half of the shingles' hashes."""
    return majority(shingles(raw, shingle, once), words)


def majority(h: np.ndarray, words: int) -> list[int]:
    n = len(h)
    if not n:
        return [0] * words
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for a in range(0, n, 1 << 16):
            ones += np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big"))
        if k + 1 < words:
            h = _mix(h)
    return out


def fingerprints(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """(doc_id, fp binary): big-endian words."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = [np.array(fingerprint(x.as_py(), plan.shingle, plan.words, plan.once), ">u8").tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp, pa.binary())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp binary")


def _blocks(plan: Plan) -> list[tuple[int, int]]:
    """(first bit, width) of the radius + 1 blocks of a table."""
    cuts = [i * plan.bits // (plan.radius + 1) for i in range(plan.radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _turned(fp: np.ndarray, t: int, first: int, bits: int) -> np.ndarray:
    """The bits of table t with the block first, at the top of a 64-bit number."""
    word, off = divmod(t * bits, 64)
    x = fp[:, word] << np.uint64(off)
    if off + bits > 64:
        x = x | (fp[:, word + 1] >> np.uint64(64 - off))
    return _rotated(x >> np.uint64(64 - bits) << np.uint64(64 - bits), first, bits)


def _rotated(x: np.ndarray, first: int, bits: int) -> np.ndarray:
    """The top bits of 64-bit numbers, with the one at ``first`` at the top."""
    x = x >> np.uint64(64 - bits)
    if first:
        x = ((x << np.uint64(first)) | (x >> np.uint64(bits - first))) & np.uint64((1 << bits) - 1)
    return x << np.uint64(64 - bits)


class Forest:
    """Smallest-root union of edges, vectorised."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_join(turned: np.ndarray, roots: np.ndarray, fixed: int, bits: int, radius: int, check, forest: Forest, sides: np.ndarray | None = None) -> None:
    """Unites all leaves of one root that differ in at most ``radius`` bits and pass ``check``."""
    for a, b in trie_pairs(turned, roots, fixed, bits, radius, sides):
        apart = forest.root[a] != forest.root[b]
        a, b = a[apart], b[apart]
        ok = check(a, b)
        forest.add(a[ok], b[ok])


def trie_pairs(turned: np.ndarray, roots: np.ndarray, fixed: int, bits: int, radius: int, sides: np.ndarray | None = None):
    """Arrays (a, b) of all pairs of leaves of one root that differ in at most ``radius`` bits, each pair once.

    Leaves are sorted by (roots, turned), where ``fixed`` top bits agree within a root. Nodes
    are ranges of leaves; a pair (node, node) stands for all leaf pairs between them. With
    ``sides`` only pairs of leaves of two sides are asked for, or all where a root has one.
    """
    cut = np.flatnonzero(np.diff(roots)) + 1
    lo, hi = np.concatenate(([0], cut)), np.append(cut, len(roots))
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    zero = np.zeros(len(lo), np.int64)
    stack = [(fixed, lo, hi, lo, hi, zero)]

    def compare(a0, a1, b0, b1):
        """Leaf by leaf."""
        na, nb = a1 - a0, b1 - b0
        size = na * nb
        first = 0
        ends = np.cumsum(size)
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + FRONT, side="right")))
            s = slice(first, last)
            own = np.repeat(np.arange(first, last), size[s])
            k = np.arange(len(own)) - np.repeat(ends[s] - size[s] - (ends[first - 1] if first else 0), size[s])
            a, b = a0[own] + k // nb[own], b0[own] + k % nb[own]
            fit = a < b
            if sides is not None:
                fit &= (sides[a] == 2) | (sides[a] != sides[b])
            a, b = a[fit], b[fit]
            near = np.bitwise_count(turned[a] ^ turned[b]) <= radius
            yield a[near], b[near]
            first = last

    while stack:
        depth, a0, a1, b0, b1, d = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [(depth, *(x[half:] for x in (a0, a1, b0, b1, d))), (depth, *(x[:half] for x in (a0, a1, b0, b1, d)))]
            continue
        small = (depth >= bits) | ((a1 - a0 <= LEAVES) & (b1 - b0 <= LEAVES))
        if small.any():
            yield from compare(a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, d = (x[~small] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        # where each node's leaves turn from 0 to 1 at this depth
        ones = np.concatenate(([0], np.cumsum((turned >> np.uint64(63 - depth)) & np.uint64(1)))).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), tuple(x[~same] for x in (am, a1, b0, bm, d + 1))]
        nxt = [np.concatenate(x) for x in zip(*parts)]
        live = (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= radius)
        # a single leaf makes no pair with itself
        live &= ~((nxt[0] == nxt[2]) & (nxt[1] == nxt[3]) & (nxt[1] - nxt[0] == 1))
        stack.append((depth + 1, *(x[live] for x in nxt)))


def _dealt_rows(batches, words: int):
    """key, side, id, label and fingerprint arrays of one partition, or None where it has no rows."""
    got = [(*(b.column(i).to_numpy() for i in range(4)), np.frombuffer(b"".join(b.column(4).to_pylist()), ">u8")) for b in batches if b.num_rows]
    if got:
        return *(np.concatenate(x) for x in list(zip(*got))[:4]), np.concatenate([g[4] for g in got]).astype(np.uint64).reshape(-1, words)


def _join(plan: Plan):
    """Links of one partition of (key, side, doc_id, fp) rows, as a spanning forest."""
    blocks = _blocks(plan)

    def run(batches):
        rows = _dealt_rows(batches, plan.words)
        if not rows:
            return
        key, side, ids, _, fp = rows
        doc, node = np.unique(ids, return_inverse=True)
        forest = Forest(len(doc))
        for t in range(plan.tables):
            for n, (first, width) in enumerate(blocks):
                mine = np.flatnonzero(key // (1 << 40) == t * len(blocks) + n)
                if len(mine) < 2:
                    continue
                turned = _turned(fp[mine], t, first, plan.bits)
                order = np.lexsort((turned, key[mine]))
                mine, turned = mine[order], turned[order]
                at = node[mine]

                def check(a, b):
                    return np.bitwise_count(fp[mine[a]] ^ fp[mine[b]]).sum(axis=1) <= plan.most if len(a) else np.zeros(0, bool)

                sub = Forest(len(mine))
                sub.root = _first_of(forest.root[at])
                trie_join(turned, key[mine], width, plan.bits, plan.radius, check, sub, side[mine])
                forest.add(at, at[sub.root])
        far = np.flatnonzero(forest.root != np.arange(len(doc)))
        yield pa.RecordBatch.from_arrays([pa.array(doc[far]), pa.array(doc[forest.root[far]])], ["a", "b"])

    return run


def parities(h: np.ndarray, words: int) -> list[int]:
    """For each of 64 * words classes of hashes whether an odd number is in it, then how many hashes there are."""
    odd = np.bincount((h % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return [*np.packbits(odd.astype(np.uint8)).view(">u8").astype(np.uint64).tolist(), len(h)]


def _may_reach(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """False where sets of n and m hashes, of which ``apart`` parities differ, can't have a Jaccard index of LEAST.

    Each class of unlike parity holds a hash that one set alone has, so twice the common
    ones are at most n + m less these classes.
    """
    least, of = LEAST
    n, m = n.astype(np.int64), m.astype(np.int64)
    return ((least + of) * (n + m - apart) >= 2 * least * (n + m)) & (np.minimum(n, m) * of >= np.maximum(n, m) * least)


class Nearest:
    """Of pairs added bit by bit, those that are among the ``most`` nearest of one of their ends."""

    def __init__(self, most: int):
        self.most, self.held, self.size, self.count = most, [], 0, {}

    def add(self, a, b, d) -> None:
        self.held.append((np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d))))
        self.size += 2 * len(a)
        if self.size > 1 << 22:
            self.cut()

    def cut(self):
        a, b, d = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(a)) + 1)) if len(a) else np.zeros(0, np.int64)
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = rank < self.most
        # ends with a pair left out are asked again
        self.count.update(dict.fromkeys(a[~keep].tolist()))
        self.held, self.size = [(a[keep], b[keep], d[keep])], int(keep.sum())

    def result(self):
        """(a, b, d) with a < b, each pair once, and the ends that have more."""
        if not self.held:
            return np.zeros((3, 0), np.int64), []
        self.cut()
        a, b, d = self.held[0]
        rows = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b), d.astype(np.int64))), axis=1)
        return rows, list(self.count)


def _pairs(plan: Plan, most: int | None):
    """Candidate pairs of one partition of (key, side, id, label, fp) rows, with the parities they differ in.

    Only ids of different labels whose sets may reach LEAST make pairs. A pair that meets
    under several blocks of a table comes out under the first only. With ``most`` each id sends so many of its nearest a key's task;
    ids with more to send come out as (id, null, null).
    """
    blocks = _blocks(plan)

    def run(batches):
        rows = _dealt_rows(batches, plan.parity + 2)
        if not rows:
            return
        key, side, ids, label, sketch = rows
        top, odd, size = sketch[:, 0], sketch[:, 1:-1], sketch[:, -1]
        near = Nearest(most) if most else None
        for t in range(plan.tables):
            for n, (first, width) in enumerate(blocks):
                mine = np.flatnonzero(key // (1 << 40) == t * len(blocks) + n)
                if len(mine) < 2:
                    continue
                turned = _rotated(top[mine], first, plan.bits)
                order = np.lexsort((turned, key[mine]))
                mine, turned = mine[order], turned[order]
                for a, b in trie_pairs(turned, key[mine], width, plan.bits, plan.radius, side[mine]):
                    a, b = mine[a], mine[b]
                    open_ = label[a] != label[b]
                    a, b = a[open_], b[open_]
                    apart = odd[a] ^ odd[b]
                    d = np.bitwise_count(apart).sum(axis=1, dtype=np.int32)
                    ok = _may_reach(size[a], size[b], d)
                    own = top[a] ^ top[b]
                    for at, wide in blocks[:n]:
                        ok &= (own << np.uint64(at)) >> np.uint64(64 - wide) != 0
                    a, b, d = ids[a[ok]], ids[b[ok]], d[ok]
                    if near is not None:
                        near.add(a, b, d)
                    elif len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["a", "b", "d"])
        if near is not None:
            (a, b, d), more = near.result()
            none = [None] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *more], pa.int64()), pa.array([*b.tolist(), *none], pa.int64()), pa.array([*d.tolist(), *none], pa.int32())], ["a", "b", "d"])
        rows = key = side = ids = label = sketch = top = odd = size = near = a = b = d = None
        tidy()

    return run


def _first_of(labels: np.ndarray) -> np.ndarray:
    """For each place the first place with its label."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return first[inverse]


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """Edges (a, b) between the doc_ids of distinct fingerprints (rep, fp), spanning all links."""
    return _dealt(distinct, plan).mapInArrow(_join(plan), "a long, b long")


def candidates(distinct: DataFrame, plan: Plan, most: int | None = None) -> DataFrame:
    """(a, b, d): pairs of (rep, label, fp) rows of different labels that a table joins and parities let through."""
    return _dealt(distinct, plan, True).mapInArrow(_pairs(plan, most), "a long, b long, d int")


def _dealt(distinct: DataFrame, plan: Plan, sketched: bool = False) -> DataFrame:
    """(key, side, id, label, fp): each row under each of its blocks, dealt by key.

    ``sketched``: in place of the fingerprint go the table's own bits, parities and size.

    Bits 40 and up of a key name the table and block, those below the block's value and,
    for hot ones, the pair of salts.
    """
    blocks = _blocks(plan)

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            own = batch.column(2)
            fp = np.frombuffer(b"".join(own.to_pylist()), ">u8").astype(np.uint64).reshape(-1, plan.words + (plan.parity + 1) * sketched)
            for t in range(plan.tables):
                if sketched:
                    m = 8 * (plan.parity + 2)
                    raw = np.column_stack((_turned(fp, t, 0, plan.bits), fp[:, plan.words :])).astype(">u8").tobytes()
                    own = pa.array([raw[i : i + m] for i in range(0, len(raw), m)], pa.binary())
                for n, (first, width) in enumerate(blocks):
                    value = (_turned(fp, t, first, plan.bits) >> np.uint64(64 - width)).astype(np.int64)
                    key = (np.int64(t * len(blocks) + n) << 40) + (value << 20)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(ids), 2, np.int8)), pa.array(ids), batch.column(1), own], ["key", "side", "id", "label", "fp"])

    label = "label" if "label" in distinct.columns else "rep"
    dealt = distinct.select("rep", F.col(label).alias("label"), "fp").mapInArrow(deal, "key long, side byte, id long, label long, fp binary")
    hot = staged(dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "hot")
    if hot.take(1):
        dealt = dealt.join(hot.select("key", F.least(F.lit(1023), F.ceil(F.col("n") / HOT)).cast("int").alias("m")), "key", "left")
        s = F.pmod(F.xxhash64("id"), "m").cast("int")
        # salt s meets each salt t in the task of (min, max); within its own, all pairs count
        pair = F.expr("explode(if(m is null, array(-1), sequence(0, m - 1)))")
        dealt = dealt.withColumn("s", s).select("*", pair.alias("t")).select(
            F.when(F.col("t") < 0, F.col("key")).otherwise(F.col("key") + F.least("s", "t") * 1024 + F.greatest("s", "t")).alias("key"),
            F.when((F.col("t") < 0) | (F.col("s") == F.col("t")), F.lit(2)).otherwise((F.col("s") > F.col("t")).cast("int")).cast("byte").alias("side"), "id", "label", "fp")
    return dealt.repartition("key").select("key", "side", "id", "label", "fp")


def near_duplicates(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    marked = staged(fingerprints(docs, plan), "fingerprints")
    distinct = staged(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    comp = components(links(distinct, plan))
    named = distinct.join(comp, distinct.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", F.expr("if(doc_id is null, null, component_id)").alias("component_id"))


def _marks(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, k, fp, node): k is a hash of the text, node one of its set of shingles."""

    def run(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp, node = [], []
                for x in part.column(2):
                    h = shingles(x.as_py(), plan.shingle, True)
                    more = parities(h, plan.parity) if plan.parity else []
                    fp.append(np.array([*majority(h, plan.words), *more], np.uint64).astype(">u8").tobytes())
                    node.append(_node(xxhash, h))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp, pa.binary()), pa.array(node, pa.int64())], ["doc_id", "k", "fp", "node"])
        batch = part = None
        tidy()

    return _keyed(docs).mapInArrow(run, "doc_id long, k long, fp binary, node long")


def _node(xxhash, h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("k"), "text")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of rows (doc_id, k)."""
    h = staged(keys.select(F.xxhash64("doc_id", "k").alias("h")), "among")
    return column_bitmap(h, "h", bits_for(h.count()))


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return member(bitmap, mix(h.astype(np.int64, copy=False).view(np.uint64)))


def _among(keys: DataFrame):
    """A test of rows (doc_id, k) by a bitmap of those in ``keys``: true for all of them and for about one in 70 others, so that no other text is shuffled."""
    bitmap = _bitmap(keys)

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        return pd.Series(_held(bitmap, h.to_numpy(np.int64)))

    return among(F.xxhash64("doc_id", "k"))


def _sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """(node, set array): the distinct shingles of the texts ``wanted`` (doc_id, k), and of a few others.

    Texts are tested where they are cut: a test in a step of its own would take a second
    Python worker a task, and executors keep those for all later stages.
    """
    bitmap = _bitmap(wanted)

    def run(batches):
        import xxhash

        for batch in batches:
            own = batch.column(1).filter(pa.array(_held(bitmap, batch.column(0).to_numpy())))
            for at in range(0, len(own), 64):
                held = [shingles(x.as_py(), plan.shingle, True) for x in own.slice(at, 64)]
                node = [_node(xxhash, h) for h in held]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([h.astype(np.int64) for h in held], pa.list_(pa.int64()))], ["node", "set"])
        batch = own = held = None
        tidy()

    return _keyed(docs).select(F.xxhash64("doc_id", "k").alias("h"), "text").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard index of LEAST or more, counted exactly."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    # sizes alone refuse most pairs of unlike lengths
    both = both.filter(F.least(F.size("sa"), F.size("sb")) * LEAST[1] >= F.greatest(F.size("sa"), F.size("sb")) * LEAST[0])
    n = F.size(F.array_intersect("sa", "sb"))
    return both.filter(n * LEAST[1] >= (F.size("sa") + F.size("sb") - n) * LEAST[0]).select("a", "b")


def clusters(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """(doc_id, k, c): rows by identity, null doc_ids as NULL_ID; c is the same for rows whose texts are linked.

    Pairs are nominated in two rounds. In the first each text sends its DENSE nearest of a
    task, which are verified; in the second only pairs of texts not yet in one component
    count, of texts that had more to send. All pairs that a table shows are sent then, so
    no cap loses a link; two texts that meet in no table are not linked (README has the
    chances). A group of near copies that the first round joins never sends all its pairs,
    and pairs whose parities rule them out are not sent at all.
    """
    spark, docs = docs.sparkSession, no_null_ids(docs)
    marked = staged(_marks(docs, plan), "marks")
    rows = marked.groupBy("node").agg(F.min(F.struct("doc_id", "k")).alias("row"), F.first("fp").alias("fp"))
    distinct = staged(rows.select(F.col("node").alias("rep"), "fp", "row.doc_id", "row.k"), "distinct")
    active, comp, found, done = distinct, None, None, None
    for most in (DENSE, None):
        sent = staged(candidates(active, plan, most), "candidates")
        pairs = sent.filter("b is not null").select("a", "b").distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        if pairs.take(1):
            ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
            wanted = staged(distinct.join(ends, "rep").select("doc_id", "k"), "wanted")
            ok = staged(verified(pairs, staged(_sets(docs, wanted, plan), "sets")), "links")
            done = pairs if done is None else done.unionByName(pairs)
            if ok.take(1):
                found = ok if found is None else found.unionByName(ok)
                comp = staged(components(found), "known")
        more = staged(sent.filter("b is null").select(F.col("a").alias("rep")).distinct(), "more")
        if not more.take(1):
            break
        active = distinct.join(more, "rep").withColumn("label", F.col("rep"))
        if comp is not None:
            active = active.drop("label").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("label"), "fp")
    c = F.col("node")
    if comp is not None:
        marked, c = marked.join(comp, "node", "left"), F.coalesce("component", "node")
    return marked.select("doc_id", "k", c.alias("c"))


def similar(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable over pairs that are LEAST alike or more."""
    named = staged(null_ids_back(clusters(docs, plan)), "named")
    first = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return named.join(first, "c").select("doc_id", F.expr("if(doc_id is null, null, component_id)").alias("component_id"))


def keep_one(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """Of each group of near copies one row of ``docs``, columns unchanged.

    It is the row of the smallest doc_id (nulls last, then by a hash of the text); of rows
    that repeat doc_id and text too, one.
    """
    keys = ["doc_id", "k"]
    found = staged(clusters(docs, plan).groupBy(*keys).agg(F.count("*").alias("n"), F.first("c").alias("c")), "clusters")
    best = found.groupBy("c").agg(F.min(F.struct(F.col("doc_id") == NULL_ID, "doc_id", "k")).alias("m")).select("m.doc_id", "m.k", F.lit(True).alias("best"))
    found = found.join(best, keys, "left")
    gone = staged(found.filter("best is null").select(*keys), "gone")
    twice = staged(found.filter("best and n > 1").select(*keys), "twice")
    rows, other = as_rows(docs), gone.unionByName(twice)
    among = _among(other)
    near = rows.filter(among)
    one = near.join(twice, keys, "left_semi").groupBy(*keys).agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
    return rows.filter(~among).unionByName(near.join(other, keys, "left_anti")).unionByName(one).select("doc.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
