"""Ranked lexical search by sort-based accumulation.

Queries are taken in blocks: whole items, cut where BLOCK of their distinct terms begin a
new block, so a block's vocabulary holds at most BLOCK terms and those of one item; terms
of over LONG bytes are held by a 128-bit hash. For each block one scan of the documents
counts their terms and keeps those of the vocabulary, packed, one row a document. From
these come the counts of the corpus, in Spark. Then each task, a range of the documents,
concatenates (item, document, impact) of all matches, sorts the packed keys by radix, sums
impacts by reduceat and keeps each item's best in a heap; the tasks' best meet by item, in
two rounds.

Defined cases: documents with null, empty or termless texts don't count; rows of one
doc_id are documents each, rows repeated whole too; equal scores go to the smaller doc_id,
a null one last (as 2^63-1); items repeated whole count once, other rows of one item_id
are items each; an item without terms, or whose every score is 0, gives no row; empty
tables give none; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.latest import ranked
from .common import staged, table, texts
from .rolling import tidy

BEST = 10
BLOCK = 1 << 18
LONG = 32
PIECE = 1 << 22
MATCHES = 1 << 20
SHARE = 128
LAST = (1 << 63) - 1
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _key(term: bytes) -> bytes:
    return term if len(term) <= LONG else b"\0" + blake2b(term, digest_size=16).digest()


def terms(raw: bytes) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each occurs; ASCII letters lower-cased."""
    if len(raw) <= PIECE:
        found = raw.translate(_TERM).split()
        return len(found), Counter(found)
    n, each, at = 0, Counter(), 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and _TERM[raw[end]] != 32:
            end += 1
        found = raw[at:end].translate(_TERM).split()
        n += len(found)
        each.update(found)
        at = end
    return n, each


def _raws(column) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def asked(items: DataFrame) -> DataFrame:
    """(item_id, k, term, reps, block) of all items; k tells items of one item_id apart."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("text").cast("binary")).alias("k"), F.col("text").cast("binary").alias("text")).filter("text is not null").dropDuplicates(["item_id", "k"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, each = terms(batch.column("text")[i].as_buffer().to_pybytes())
                own = [(_key(t), c) for t, c in sorted(each.items())]
                for a in range(0, len(own), 10_000):
                    part = own[a : a + 10_000]
                    head = [pa.array([batch.column(c)[i].as_py()] * len(part), pa.int64()) for c in ("item_id", "k")]
                    yield pa.RecordBatch.from_arrays([*head, pa.array([t for t, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], ["item_id", "k", "term", "reps"])

    found = rows.mapInArrow(run, "item_id long, k long, term binary, reps long")
    numbered = ranked(found, [F.asc_nulls_first("item_id"), F.asc("k"), F.asc("term")])
    first = F.min("rank").over(Window.partitionBy("item_id", "k"))
    return staged(numbered.withColumn("first", first), "asked").drop("rank")


class Block:
    """A block's items and terms, as arrays: items of each term, with repeats."""

    def __init__(self, rows: list):
        names = sorted({(r.item_id is not None, r.item_id or 0, r.k) for r in rows})
        place = {n: i for i, n in enumerate(names)}
        self.ids = [x[1] if x[0] else None for x in names]
        by_term: dict[bytes, list] = {}
        for r in rows:
            by_term.setdefault(bytes(r.term), []).append((place[r.item_id is not None, r.item_id or 0, r.k], r.reps))
        self.vocabulary = {t: i for i, t in enumerate(by_term)}
        self.begins = np.array([0, *accumulate(len(x) for x in by_term.values())], np.int64)
        flat = [y for x in by_term.values() for y in sorted(x)]
        self.items = np.array([x[0] for x in flat], np.int64)
        self.reps = np.array([x[1] for x in flat], np.int64)


def match(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms: their number, the numbers of those in the block and how often each occurs, packed."""
    sent = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches):
        vocabulary = sent.value
        keys, hashed = vocabulary.keys(), any(len(t) == 17 and t[0] == 0 for t in vocabulary)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, each = terms(text.as_buffer().to_pybytes())
                if not n:
                    continue
                hits = [(vocabulary[t], each[t]) for t in each.keys() & keys if len(t) <= LONG]
                if hashed:
                    hits += [(vocabulary[x], c) for t, c in each.items() if len(t) > LONG and (x := _key(t)) in vocabulary]
                packed = np.array(sorted(hits), "<i4").reshape(-1, 2)
                out.append((doc_id, n, packed[:, 0].tobytes(), packed[:, 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "n", "terms", "tfs"])
        tidy()

    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def frequencies(postings: DataFrame, size: int) -> dict[int, int]:
    """Documents of each term of a block: at most as many rows as the block has terms."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(_raws(batch.column(0))), "<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    rows = postings.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {r.term: r.df for r in rows}


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of unsigned keys of so many bits: one counting pass for each 16."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def _lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """25 + (75 * n * docs) div words, beyond 2^63 in Python's integers."""
    if 75 * int(n.max(initial=0)) * docs < 1 << 63:
        return 25 + 75 * n * docs // words
    return np.array([25 + 75 * int(x) * docs // words for x in n], np.int64)


class Best:
    """Each item's best (score, doc_id), in heaps; what can't enter is left out before, by arrays."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least, self.least_doc = np.zeros(items, np.int64), np.full(items, -(1 << 63), np.int64)

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        least = self.least[item]
        able = np.flatnonzero((score > least) | (score == least) & (doc < self.least_doc[item]))
        item, doc, score = item[able], doc[able], score[able]
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], item[1:] != item[:-1])), np.arange(len(item)), 0)) if len(item) else item
        for i in np.flatnonzero(np.arange(len(item)) - first < self.k).tolist():
            heap, one = self.heaps[item[i]], (int(score[i]), -int(doc[i]))
            if len(heap) < self.k:
                heapq.heappush(heap, one)
            else:
                heapq.heappushpop(heap, one)
            if len(heap) == self.k:
                self.least[item[i]], self.least_doc[item[i]] = heap[0][0], -heap[0][1]


def accumulate_scores(postings: DataFrame, block: Block, weights: np.ndarray, docs: int, words: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of each task's documents."""
    sent = postings.sparkSession.sparkContext.broadcast((block.begins, block.items, block.reps, weights, len(block.ids)))

    def run(batches):
        begins, items, reps, weights, n_items = sent.value
        best, wide = Best(n_items, k), np.diff(begins)
        for batch in batches:
            doc_id, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n"))
            raws = _raws(batch.column("terms"))
            term, tf = np.frombuffer(b"".join(raws), "<i4"), np.frombuffer(b"".join(_raws(batch.column("tfs"))), "<i4").astype(np.int64)
            doc = np.repeat(np.arange(len(raws)), [len(x) // 4 for x in raws])
            m = _lengths(n, docs, words)[doc]
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            made = np.cumsum(wide[term])
            ends = np.searchsorted(doc, np.arange(len(raws)), side="right")
            done = a = 0
            while a < len(raws):  # so many documents that their matches stay near MATCHES
                low = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(made[np.maximum(ends - 1, 0)], done + MATCHES, side="right"))) if len(made) else len(raws)
                b = min(b, len(raws))
                high = ends[b - 1]
                if high > low:
                    t, each = term[low:high], wide[term[low:high]]
                    total = int(each.sum())
                    at = np.arange(total) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begins[t], each)
                    item, value = items[at], np.repeat(impact[low:high], each) * reps[at]
                    own = np.repeat(doc[low:high] - a, each)
                    bits = max(1, (b - a - 1).bit_length())
                    packed = item << bits | own
                    order = radix_order(packed, bits + n_items.bit_length())
                    packed = packed[order]
                    begin = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
                    score, packed = np.add.reduceat(value[order], begin), packed[begin]
                    best.offer(packed >> bits, doc_id[a + (packed & ((1 << bits) - 1))], score)
                    done = made[high - 1]
                a = b
        rows = [(i, -d, s) for i, heap in enumerate(best.heaps) for s, d in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])
        tidy()

    return postings.mapInArrow(run, "item int, doc_id long, score long")


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents."""
    spark, asks = docs.sparkSession, asked(items)
    most = asks.agg(F.max("first")).first()[0]
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range((most - 1) // block + 1 if most else 0):
        rows = asks.filter((F.col("first") > b * block) & (F.col("first") <= (b + 1) * block)).select("item_id", "k", "term", "reps").collect()
        if not rows:  # an item filled the block before
            continue
        own = Block(rows)
        postings = staged(match(docs, own), "postings", compression="zstd")
        seen = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
        if not seen.docs:
            break
        weights = np.zeros(len(own.vocabulary), np.int64)
        for t, df in frequencies(postings, len(weights)).items():
            weights[t] = math.floor(1000 * math.log((2 * seen.docs + 2) / (2 * df + 1)))
        found = accumulate_scores(postings, own, weights, seen.docs, seen.words, k).withColumn("_share", F.expr(f"spark_partition_id() div {SHARE}"))
        best = _first(_first(found, ["item", "_share"], k).drop("rank"), ["item"], k)
        ids = F.broadcast(spark.createDataFrame(list(enumerate(own.ids)), "item int, item_id long"))  # a block's items, at most BLOCK
        out = out.unionByName(best.join(ids, "item").select("item_id", "rank", F.expr(f"nullif(doc_id, {LAST}L)").alias("doc_id"), "score"))
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT row_id, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf CROSS JOIN corpus GROUP BY term),
q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
m AS (SELECT row_id, doc_id, 25 + (75 * n * docs) // words AS m FROM lengths CROSS JOIN corpus),
s AS (SELECT item_id, row_id, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
