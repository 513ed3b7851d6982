"""Substring dedup by fixed-block anchors over words.

Every document's words are cut into non-overlapping reference blocks of BLOCK words; any
window of WINDOW words holds exactly one of its own document's blocks. All blocks are
indexed, every rolling BLOCK-word window of every document probes the index, and blocks
met more than once are the anchors. Around them hits are extended to maximal exact
repeats: each window over an anchor is compared whole, by 128 bits of hash.

Index and probes are dealt by slices of the hash, four bytes and a state for each distinct
window of a task, and anchors find their documents by a join, so the work is in proportion
to the input at any size. A bitmap of doc_ids of a fixed size keeps texts that need no
part out of a join; when it fills up, more rows are shuffled and the result stays the
same. Texts that are equal word for word are judged once. A task sends one row for a window that it has seen twice already,
so that copies, however many, make few rows a task.

Defined cases: null and empty texts have no words and the hash of the empty string; each
row is a document of its own, so a repeated row's windows occur elsewhere; documents
shorter than a window keep all words; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import no_null_ids, null_ids_back, staged, table, texts

WINDOW = 35
EMPTY = hashlib.sha256(b"").hexdigest()


def _key(words: bytes) -> int:
    """A row's identity in joins, beside its doc_id."""
    import xxhash

    return xxhash.xxh3_64_intdigest(words) - (1 << 63)


def overview(docs: DataFrame) -> DataFrame:
    """(doc_id, k, k1, k2, n_words, whole): identity, 128-bit hash of the words, and the hash of all words kept."""
    import xxhash

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for d, x in zip(part.column(0).to_pylist(), part.column(1)):
                    words = x.as_py().split()
                    joined = b" ".join(words)
                    h = xxhash.xxh3_128_intdigest(joined)
                    rows.append((d, _key(joined), (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), len(words), hashlib.sha256(joined).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "k", "k1", "k2", "n_words", "whole"])

    return texts(docs).mapInArrow(run, "doc_id long, k long, k1 long, k2 long, n_words long, whole string")


def _words(raws, seeds):
    """(row of each word, word hashes by seed, place of each word in its document) of some texts."""
    starts = np.cumsum([0] + [len(r) + 1 for r in raws[:-1]])
    buf = np.frombuffer(b"\n".join(raws), np.uint8)
    a, b = R.word_bounds(buf)
    row = np.searchsorted(starts, a, side="right") - 1
    return row, [R.word_hashes(buf, a, b, s) for s in seeds], np.arange(len(a)) - np.searchsorted(a, starts)[row]


def _sequences(batches, sent):
    """(ids, texts, row of each word, word hashes, place of each word) of the documents to judge."""
    for part, raws in R.buffers(batches, 1):
        ids = part.column(0).to_numpy()
        use = np.flatnonzero(R.member(sent, R.mix(ids.astype(np.uint64))))
        if len(use):
            raws = [raws[i] for i in use]
            yield ids[use], raws, *_words(raws, (0,))


def _with(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, k, text, and what ``marks`` has) of the documents that ``marks`` names by doc_id and k."""
    some = docs.sparkSession.sparkContext.broadcast(R.column_bitmap(marks, "doc_id", R.bits_for(marks.count())))

    def only(batches):
        for b in batches:
            mask = R.member(some.value, R.mix(b.column(0).to_numpy().astype(np.uint64)))
            keys = [_key(b" ".join(x.as_py().split())) if m else None for x, m in zip(b.column(1), mask)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(1)], ["doc_id", "k", "text"]).filter(pa.array(mask))

    return texts(docs).mapInArrow(only, "doc_id long, k long, text binary").join(marks, ["doc_id", "k"])


def _windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, and their hashes."""
    start = np.arange(max(0, len(h) - width + 1))
    start = start[row[start] == row[start + width - 1]]
    return start, R.window(R.sums(h), start, start + width)


def repeated_windows(docs: DataFrame, seen: DataFrame, width: int) -> DataFrame:
    """(doc_id, k, p): starts of the windows, of distinct texts, that occur elsewhere too."""
    block = (width + 1) // 2
    sc = docs.sparkSession.sparkContext
    once = seen.filter("n_words >= %d" % width).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n"))
    size = once.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
    if not size.n:
        return docs.sparkSession.createDataFrame([], "doc_id long, k long, p int")
    judged = sc.broadcast(R.column_bitmap(once, "doc_id", R.bits_for(size.n)))
    source = texts(docs)

    def windows(batches):
        for _, _, row, (h,), place in _sequences(batches, judged.value):
            start, w = _windows(h, row, block)
            yield w, place[start] % block == 0

    found, bits = R.probed(source, windows, size.words)

    def blocks(batches):
        for ids, raws, row, (h,), place in _sequences(batches, judged.value):
            start, w = _windows(h, row, block)
            lead = place[start] % block == 0
            at = start[lead]
            key = np.fromiter((_key(b" ".join(r.split())) for r in raws), np.int64, len(ids))
            columns = ((w[lead] >> np.uint64(64 - bits)).astype(np.int64), ids[row[at]], key[row[at]], place[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "doc_id", "k", "p"])

    anchors = source.mapInArrow(blocks, "h long, doc_id long, k long, p int").join(found, "h").groupBy("doc_id", "k").agg(F.collect_set("p").alias("ps"))
    near = _with(docs, staged(anchors, "anchors"))

    def extend(batches):
        held, size = [], 0
        for part, raws in R.buffers(batches, 2):
            ids, key = part.column(0).to_numpy(), part.column(1).to_numpy()
            row, (h, g), place = _words(raws, (0, 1))
            first, ps = np.searchsorted(row, np.arange(len(raws))), part.column(3)
            lead = np.zeros(len(h), bool)
            lead[np.repeat(first, pc.list_value_length(ps).to_numpy()) + ps.flatten().to_numpy()] = True
            start, w1 = _windows(h, row, width)
            # the one block that lies in the window from here
            fit = lead[start + -place[start] % block]
            start, w1 = start[fit], w1[fit]
            if not len(start):
                continue
            w2 = R.window(R.sums(g), start, start + width)
            held.append((w1, w2, ids[row[start]], key[row[start]], place[start].astype(np.int32)))
            size += len(start)
            if size > 1 << 20:
                yield _condensed(held)
                held, size = [], 0
        if held:
            yield _condensed(held)
        held = None
        R.tidy()

    def count(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        w1, w2, d, k, p, state = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((w2, w1))
        same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
        again = np.zeros(len(w1), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        keep = again | (state > 0)
        yield pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(k[keep]), pa.array(p[keep])], ["doc_id", "k", "p"])

    # rows of state 2 are settled and only pass through; their keys are spread by document
    sent = near.mapInArrow(extend, "w1 long, w2 long, doc_id long, k long, p int, state byte")
    to = F.when(F.col("state") == 2, F.col("k")).otherwise(F.col("w1"))
    return sent.repartition(to).mapInArrow(count, "doc_id long, k long, p int")


def _condensed(held):
    """Rows (w1, w2, doc_id, k, p, state): 0 met once in the task, 1 the first of several, 2 the others."""
    w1, w2, d, k, p = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((p, k, d, w2, w1))
    w1, w2, d, k, p = w1[order], w2[order], d[order], k[order], p[order]
    new = np.ones(len(w1), bool)
    new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
    last = np.append(new[1:], True)
    state = np.where(new, np.where(last, 0, 1), 2).astype(np.int8)
    return pa.RecordBatch.from_arrays([pa.array(w1.astype(np.int64)), pa.array(w2.astype(np.int64)), pa.array(d), pa.array(k), pa.array(p), pa.array(state)], ["w1", "w2", "doc_id", "k", "p", "state"])


def dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and k, for joins)."""
    docs = no_null_ids(docs)
    seen = staged(overview(docs), "overview")
    hits = staged(repeated_windows(docs, seen, width).groupBy("doc_id", "k").agg(F.collect_list("p").alias("ps")), "hits")
    def cut(batches):
        for b in batches:
            rows = []
            for d, k, x, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                words = x.as_py().split()
                edge = np.zeros(len(words) + 1, np.int64)
                p = np.unique(ps.values.to_numpy())
                edge[p] += 1
                edge[p + width] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((d, k, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "k", "gone", "rest"])

    done = _with(docs, hits).mapInArrow(cut, "doc_id long, k long, gone long, rest string").dropDuplicates(["doc_id", "k"])
    copies = seen.groupBy("k1", "k2").agg(F.count("*").alias("copies")).filter("copies > 1")
    out = seen.join(copies, ["k1", "k2"], "left").join(done, ["doc_id", "k"], "left")
    copy = (F.col("copies") > 1) & (F.col("n_words") >= width)
    return null_ids_back(out).select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, ws, len(ws) AS n, unnest(range(0, len(ws) - 34)) AS p FROM w WHERE len(ws) >= 35
), k AS (SELECT doc_id, p, md5(array_to_string(ws[p + 1 : p + 35], ' ')) AS h FROM s
), r AS (SELECT doc_id, p FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)
), g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r
), x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id
), o AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS m,
    array_to_string(list_transform(list_filter(list_transform(ws, lambda x, i: {'x': x, 'i': i - 1}), lambda e: NOT list_contains(coalesce(gone, []), e.i)), lambda e: e.x), ' ') AS kept
  FROM w LEFT JOIN x USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM o
"""
