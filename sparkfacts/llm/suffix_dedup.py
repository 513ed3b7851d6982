"""Dedup of bytes in suffix order around triggers; what stands in for a full prefix-free parse.

Texts are marked at triggers: positions whose rolling hash of TRIGGER bytes is the least in
some stretch of LENGTH bytes. Every LENGTH-byte string so holds a trigger, and equal
strings hold it at the same place. No phrases are cut between triggers, no dictionary of
phrases and no suffix array of the parse are made: the surroundings of triggers met again
take their place (README says why, with figures). Distinct surroundings are put in suffix
order twice, by what follows the trigger and by what goes before it (reversed), with
their common prefixes. Strings at distance a from their trigger are equal exactly where
both orders agree, to LENGTH - a bytes after and a bytes before; the first in corpus order
stays. At triggers met very often strings are compared by a hash of their content alone.

Triggers are counted by hash first, in slices of the hash, and a join brings those met
again back to their documents, so the work is in proportion to the input at any size. A
bitmap of doc_ids of a fixed size keeps texts that need no part out of a join; when it
fills up, more rows are shuffled and the result stays the same. Surroundings are made
distinct in each task before they are dealt by trigger; for a trigger met more than HOT
times each of its strings is dealt by its own hash. Texts that are equal byte for byte are parsed once.

Defined cases: null and empty texts have no bytes and the hash of the empty string; texts
shorter than LENGTH keep all; rows that share a doc_id count as one document for what is
earlier, so a row repeated whole never removes its twin; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import no_null_ids, null_ids_back, staged, table, texts

LENGTH = 100
TRIGGER = 48
HOT = 20_000
HELD = 1 << 17  # surroundings that a task holds to make them distinct
BUFFER = 1 << 18
EMPTY = hashlib.sha256(b"").hexdigest()
SENT = "to long, doc_id long, k long, p int, la int, ra int, around binary"


def _key(raw: bytes) -> int:
    """A row's identity in joins, beside its doc_id."""
    import xxhash

    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def overview(docs: DataFrame) -> DataFrame:
    """(doc_id, k, k1, k2, n_bytes, whole): identity, 128-bit hash of the text, and the hash of all bytes kept."""
    import xxhash

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for d, x in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = x.as_py()
                    h = xxhash.xxh3_128_intdigest(raw)
                    rows.append((d, _key(raw), (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), len(raw), hashlib.sha256(raw).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "k", "k1", "k2", "n_bytes", "whole"])

    return texts(docs).mapInArrow(run, "doc_id long, k long, k1 long, k2 long, n_bytes long, whole string")


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of x[i : i + width], by doubling."""
    have = 1
    while have * 2 <= width:
        x, have = best(x[:-have], x[have:]), have * 2
    rest = width - have
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def triggers(buf: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of triggers in a buffer whose documents are [start, end), and their hashes."""
    n, wide = len(buf), length - TRIGGER + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = R.sums(R.byte_values(buf))
    h = R.mix((total[TRIGGER:] - total[:-TRIGGER]) * R._power(n)[1][: n - TRIGGER + 1]) | np.uint64(1)
    fits = np.zeros(n + 1, np.int32)  # strings that lie within one document
    long_ = end - start >= length
    fits[start[long_]] += 1
    fits[end[long_] - length + 1] -= 1
    fits = np.cumsum(fits[: n - length + 1]) > 0
    low = np.where(fits, _slide(h, wide, np.minimum), np.uint64(0))
    pad = np.zeros(wide - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate((pad, low, pad)), wide, np.maximum) == h)
    return at, R.mix(h[at])  # least hashes crowd at the low end; mixed again they spread


def _parsed(batches, judged, length: int):
    """(ids, texts, buffer, starts, ends, trigger positions and hashes) of the documents to judge."""
    for part, raws in R.buffers(batches, 1, BUFFER):
        ids = part.column(0).to_numpy()
        use = [i for i in np.flatnonzero(R.member(judged, R.mix(ids.astype(np.uint64)))) if len(raws[i]) >= length]
        if use:
            raws, ids = [raws[i] for i in use], ids[use]
            end = np.cumsum([len(r) for r in raws])
            buf = np.frombuffer(b"".join(raws), np.uint8)
            start = end - np.array([len(r) for r in raws])
            yield ids, raws, buf, start, end, *triggers(buf, start, end, length)


def _with(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, k, text, and what ``marks`` has) of the documents that ``marks`` names by doc_id and k."""
    some = docs.sparkSession.sparkContext.broadcast(R.column_bitmap(marks, "doc_id", R.bits_for(marks.count())))

    def only(batches):
        for b in batches:
            mask = R.member(some.value, R.mix(b.column(0).to_numpy().astype(np.uint64)))
            keys = [_key(x.as_py()) if m else None for x, m in zip(b.column(1), mask)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(1)], ["doc_id", "k", "text"]).filter(pa.array(mask))

    return texts(docs).mapInArrow(only, "doc_id long, k long, text binary").join(marks, ["doc_id", "k"])


def _batch(to, d, k, p, la, ra, around):
    blobs = pa.array([None] * len(to), pa.binary()) if around is None else pa.FixedSizeBinaryArray.from_buffers(pa.binary(around.shape[1]), len(around), [None, pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array(d), pa.array(k), pa.array(p.astype(np.int32)), pa.array(la.astype(np.int32)), pa.array(ra.astype(np.int32)), blobs], ["to", "doc_id", "k", "p", "la", "ra", "around"])


def _first(around, la, ra, d, p):
    """Order of rows by content, then corpus order; which are the first of their content, and which start later than that."""
    word = np.zeros((len(around), -(-around.shape[1] // 8) * 8), np.uint8)
    word[:, : around.shape[1]] = around
    h = R.mix((word.view("<u8") * R._power(word.shape[1])[0][: word.shape[1] // 8]).sum(axis=1, dtype=np.uint64) + la.astype(np.uint64) * np.uint64(1_000_003) + ra.astype(np.uint64))
    order = np.lexsort((p, d, h))
    h, a = h[order], around[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1]).any(axis=1) | (la[order][1:] != la[order][:-1]) | (ra[order][1:] != ra[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    # a string found from two triggers, or a row repeated whole, isn't later than itself
    return order, new, (d[order] != d[order][first]) | (p[order] != p[order][first])


def _distinct(held, length):
    """Rows to send: surroundings that a task has met before are settled (around is null)."""
    h, often, d, k, p, la, ra, around = (np.concatenate(c) for c in zip(*held))
    order, new, late = _first(around, la, ra, d, p)
    h, often, d, k, p, la, ra, around = (x[order] for x in (h, often, d, k, p, la, ra, around))
    again = late & (la + ra >= length)
    if again.any():
        yield _batch(k[again], d[again], k[again], p[again], la[again], ra[again], None)
    h, often, d, k, p, la, ra, around = (x[new] for x in (h, often, d, k, p, la, ra, around))
    if (~often).any():
        yield _batch(*(x[~often] for x in (h, d, k, p, la, ra, around)))
    h, d, k, p, la, ra, around = (x[often] for x in (h, d, k, p, la, ra, around))
    most = length - TRIGGER
    for a in range(most + 1) if len(h) else ():
        fit = (la >= a) & (ra >= length - a)
        alone = np.zeros((int(fit.sum()), around.shape[1]), np.uint8)
        alone[:, most:] = around[fit, most - a : most - a + length]
        if not len(alone):
            continue
        zero, full = np.zeros(len(alone), np.int64), np.full(len(alone), length)
        order, new, late = _first(alone, zero, full, d[fit], p[fit] - a)
        x = [v[fit][order] for v in (d, k, p)]
        word = np.ascontiguousarray(alone[order][:, most:])
        to = R.mix((word[:, : length // 8 * 8].copy().view("<u8") * R._power(length)[0][: length // 8]).sum(axis=1, dtype=np.uint64))
        for which, blobs in ((new, alone[order][new]), (late, None)):
            if which.any():
                yield _batch(to[which] if blobs is not None else x[1][which], x[0][which], x[1][which], x[2][which] - a, zero[which], full[which], blobs)


def _equal(around, la, ra, length):
    """For surroundings in corpus order, all distinct: which strings (row, distance a) occur in an earlier row."""
    n, most = len(around), length - TRIGGER

    def order(side):
        side = np.ascontiguousarray(side)
        by = np.argsort(side.view(f"S{side.shape[1]}").ravel(), kind="stable")
        same = side[by[1:]] == side[by[:-1]]
        common = np.where(same.all(axis=1), side.shape[1], same.argmin(axis=1))
        near = np.zeros(n, np.int64)
        near[by[1:]] = common
        near[by[:-1]] = np.maximum(near[by[:-1]], common)
        return by, common, near

    after, before = order(around[:, most:]), order(around[:, :most][:, ::-1])

    def rank(which, depth):
        by, common, _ = which
        out = np.zeros(n, np.int64)
        out[by[1:]] = np.cumsum(common < depth)
        return out

    found = np.zeros((n, most + 2), bool)
    for a in range(most + 1):
        at = np.flatnonzero((la >= a) & (ra >= length - a) & (after[2] >= length - a) & (before[2] >= a))
        if len(at) > 1:
            key = rank(before, a)[at] * n + rank(after, length - a)[at]
            _, first = np.unique(key, return_index=True)
            late = np.ones(len(at), bool)
            late[first] = False
            found[at[late], a] = True
    return found


def spans(docs: DataFrame, seen: DataFrame, length: int, hot_limit: int) -> DataFrame:
    """(doc_id, k, b, e): stretches of distinct texts covered by strings that also start earlier."""
    sc, most = docs.sparkSession.sparkContext, length - TRIGGER
    once = seen.filter(F.col("n_bytes") >= length).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n"))
    size = once.agg(F.count("*").alias("n"), F.sum("n").alias("bytes")).first()
    if not size.n:
        return docs.sparkSession.createDataFrame([], "doc_id long, k long, b int, e int")
    judged, source = sc.broadcast(R.column_bitmap(once, "doc_id", R.bits_for(size.n))), texts(docs)
    again, bits = R.repeated(source, lambda batches: (x[6] for x in _parsed(batches, judged.value, length)), 2 * size.bytes // (most + 2), hot_limit)

    def parse(batches):
        for ids, raws, _, start, end, at, h in _parsed(batches, judged.value, length):
            row = np.searchsorted(end, at, side="right")
            k = np.fromiter(map(_key, raws), np.int64, len(raws))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in ((h >> np.uint64(64 - bits)).astype(np.int64), ids[row], k[row], (at - start[row]).astype(np.int32))], ["h", "doc_id", "k", "p"])

    met = source.mapInArrow(parse, "h long, doc_id long, k long, p int").join(again, "h")
    marks = staged(met.groupBy("doc_id", "k").agg(F.collect_set(F.struct("p", "h", "often")).alias("marks")), "marks")

    def surround(batches):
        held, size = [], 0
        for part, raws in R.buffers(batches, 2, BUFFER):
            ids, k, marks = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3)
            n = np.array([len(r) for r in raws])
            end = np.cumsum(n)
            row = np.repeat(np.arange(len(raws)), pc.list_value_length(marks).to_numpy())
            p, h, often = (x.to_numpy(zero_copy_only=False) for x in marks.flatten().flatten())
            at = (end - n)[row] + p
            la, ra = np.minimum(most, p), np.minimum(length, n[row] - p)
            wide = np.concatenate((np.zeros(most, np.uint8), np.frombuffer(b"".join(raws), np.uint8), np.zeros(length, np.uint8)))
            around = sliding_window_view(wide, most + length)[at].copy()
            col = np.arange(most + length)
            around[(col < (most - la)[:, None]) | (col >= (most + ra)[:, None])] = 0
            held.append((h, often, ids[row], k[row], p, la, ra, around))
            size += len(at)
            if size >= HELD:
                yield from _distinct(held, length)
                held, size = [], 0
        if held:
            yield from _distinct(held, length)
        held = None
        R.tidy()

    def settle(batches):
        got = []
        for b in batches:
            d, k, p, la, ra = (b.column(i).to_numpy() for i in range(1, 6))
            null = b.column(6).is_null().to_numpy(zero_copy_only=False)
            if null.any():
                yield _out(d[null], k[null], p[null] - la[null], p[null] + ra[null])
            if not null.all():
                raw = np.frombuffer(b"".join(b.column(6).drop_null().to_pylist()), np.uint8).reshape(-1, most + length)
                got.append((b.column(0).to_numpy()[~null], d[~null], k[~null], p[~null], la[~null], ra[~null], raw))
        if not got:
            return
        to, d, k, p, la, ra, around = (np.concatenate(c) for c in zip(*got))
        del got
        order, new, late = _first(around, la, ra, d, p)
        again = order[late & ((la + ra)[order] >= length)]
        if len(again):
            yield _out(d[again], k[again], p[again] - la[again], p[again] + ra[again])
        # only triggers with several surroundings are left to compare, in corpus order
        # (single strings of hot triggers, without anything before them, are settled by now)
        left = order[new]
        left = left[(la[left] > 0) | (p[left] == 0)]
        _, of, n = np.unique(to[left], return_inverse=True, return_counts=True)
        left = left[n[of] > 1]
        left = left[np.lexsort((p[left], d[left]))]
        if len(left) > 1:
            found = _equal(around[left], la[left], ra[left], length)
            edge = np.diff(np.column_stack((np.zeros(len(left), np.int8), found.astype(np.int8))), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            own = left[row]
            yield _out(d[own], k[own], p[own] - (high - 1), p[own] - low + length)
        del to, d, k, p, la, ra, around, order, new, late
        R.tidy()

    return _with(docs, marks).mapInArrow(surround, SENT).repartition("to").mapInArrow(settle, "doc_id long, k long, b int, e int")


def _out(d, k, b, e):
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc_id", "k", "b", "e"])


def dedup(docs: DataFrame, length: int = LENGTH, hot_limit: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = no_null_ids(docs)
    seen = staged(overview(docs), "overview")
    hits = staged(spans(docs, seen, length, hot_limit).groupBy("doc_id", "k").agg(F.collect_list(F.struct("b", "e")).alias("be")), "hits")
    def cut(batches):
        for batch in batches:
            rows = []
            for d, k, x, be in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                raw = np.frombuffer(x.as_py(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, be.values.field(0).to_numpy(), 1)
                np.add.at(edge, be.values.field(1).to_numpy(), -1)
                gone = np.cumsum(edge)[:-1] > 0
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                rows.append((d, k, int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "k", "gone", "runs", "rest"])

    done = _with(docs, hits).mapInArrow(cut, "doc_id long, k long, gone long, runs long, rest string").dropDuplicates(["doc_id", "k"])
    firsts = seen.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    out = seen.join(firsts, ["k1", "k2"], "left").join(done, ["doc_id", "k"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length)
    return null_ids_back(out).select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
