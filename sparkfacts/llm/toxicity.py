"""Toxicity: character n-gram linear classifier on naive Bayes log-count ratios.

Features are the hashed n-grams of characters (code points, lower-cased) that occur in a text, each worth
its log-count ratio between toxic and other labelled texts; a logistic regression over
them gives the score. The fit takes at most SAMPLE labelled rows of each class, in hash
order of doc_id, and keeps FEATURES n-grams; both bounds are parameters. Every whole text
is scored.

Defined cases: null and empty texts score the model's intercept; a doc_id labelled more
than once counts with its highest label; with no labels, or labels of one class, every
score is that share (0.5 without labels); repeated rows get equal scores; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, texts
from .rolling import tidy

ORDERS = (3, 4, 5)
BITS = 18
FEATURES = 4096
SAMPLE = 4000
THRESHOLD = 0.7
PIECE = 1 << 19
ALPHA = 1.0
L2 = 1e-3
STEPS = 300
SLICES = 16


@dataclass
class Model:
    weights: np.ndarray  # one for each hash; 0 where the n-gram isn't kept
    kept: np.ndarray
    bias: float


def _hits(raws: list[bytes], kept: np.ndarray | None):
    """(document index, hash) of the n-grams of texts, distinct; only kept hashes if given."""
    # a zero stands between texts, and no n-gram holds one
    chars = [r.decode("utf-8", "replace").lower().replace("\0", " ") for r in raws]
    starts = np.cumsum([0] + [len(r) + 1 for r in chars])
    buf = np.frombuffer(("\0".join(chars) + "\0").encode("utf-32-le", "replace"), "<u4")
    found = []
    for a in range(0, len(buf), PIECE):
        piece = buf[a : a + PIECE + max(ORDERS) - 1]
        zero = np.concatenate(([0], np.cumsum(piece == 0)))
        value = piece.astype(np.uint64) + np.uint64(1)
        gram = value.copy()
        for n in range(2, max(ORDERS) + 1):
            gram = gram[:-1] * np.uint64(0xD6E8FEB86659FD93) + value[n - 1 :]
            if n not in ORDERS:
                continue
            hashed = ((gram ^ (gram >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BITS)).astype(np.int32)
            # a gram belongs to the piece in which it starts
            at = np.flatnonzero(kept[hashed[:PIECE]]) if kept is not None else np.arange(min(len(hashed), PIECE))
            at = at[zero[at + n] == zero[at]]
            doc = np.searchsorted(starts, at + a, side="right") - 1
            found.append(np.unique(doc.astype(np.int64) << BITS | hashed[at]))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _groups(batches, text=1, most_rows=512, most_bytes=1 << 20):
    """Parts of batches whose texts (strings or bytes, null or not) stay near a size."""
    for batch in batches:
        at, size = 0, 0
        for i in range(batch.num_rows):
            x = batch.column(text)[i]
            size += len(x.as_buffer()) if x.is_valid else 0
            if i + 1 - at >= most_rows or size >= most_bytes or i + 1 == batch.num_rows:
                part = batch.slice(at, i + 1 - at)
                yield part, [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(text)]
                at, size = i + 1, 0
    tidy()


def _logistic(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient on sparse rows."""
    n, w, b = len(y), np.zeros(width), 0.0
    weight = weight / weight.sum()
    # a safe step: a quarter of the largest weighted row norm, squared, bounds the curvature
    norms = np.bincount(rows, x * x, n) + 1
    step = 4 / max(1e-9, float((weight * norms).sum()))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        z = np.bincount(rows, x * v[cols], n) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        w2 = v - step * (np.bincount(cols, x * g[rows], width) + L2 * v)
        b2 = vb - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fits on labelled documents outside the held-out third."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    seen = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    size = 1 << BITS
    if len(seen) < 2:
        share = float(next(iter(seen))) if seen else 0.5
        return Model(np.zeros(size, np.float32), np.zeros(size, bool), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    drawn = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * sample narrow rows
    picked = texts(docs).join(drawn, "doc_id").select("toxic", "text")

    def count(batches):
        total = np.zeros((2, size + 1), np.int64)
        for part, raws in _groups(batches):
            toxic = part.column(0).to_numpy()
            doc, h = _hits(raws, None)
            for c in (0, 1):
                total[c, :size] += np.bincount(h[toxic[doc] == c], minlength=size)
                total[c, size] += int((toxic == c).sum())
        step = size // SLICES
        if total[:, size].any():
            for s in range(SLICES):
                part = total[:, s * step : (s + 1) * step + (s == SLICES - 1)].astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["s", "counts"])

    def add(pdf):
        return pdf.iloc[:1].assign(counts=sum(np.frombuffer(c, "<i8") for c in pdf.counts).tobytes())

    parts = picked.mapInArrow(count, "s int, counts binary").groupBy("s").applyInPandas(add, "s int, counts binary").collect()
    if not parts:
        return Model(np.zeros(size, np.float32), np.zeros(size, bool), 0.0)
    n = np.concatenate([np.frombuffer(r["counts"], "<i8").reshape(2, -1) for r in sorted(parts, key=lambda r: r.s)], axis=1).astype(float)
    n, of = n[:, :size], n[:, size:]
    p = n + ALPHA
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())
    rate, mean = n / np.maximum(of, 1), n.sum(0) / of.sum()
    z = np.abs(rate[1] - rate[0]) / np.sqrt(mean * (1 - mean) + 1 / of.sum())
    best = np.lexsort((np.arange(size), -z))[:features]
    kept = np.zeros(size, bool)
    kept[best[z[best] > 0]] = True

    def choose(batches):
        for part, raws in _groups(batches):
            doc, h = _hits(raws, kept)
            each = np.split(h.astype("<i4"), np.searchsorted(doc, np.arange(1, len(raws))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.tobytes() for e in each], pa.binary())], ["toxic", "h"])

    rows = picked.mapInArrow(choose, "toxic int, h binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["toxic"], r["h"]))
    y = np.array([r["toxic"] for r in rows], float)
    h = [np.frombuffer(r["h"], "<i4") for r in rows]
    row, col = np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate(h)
    place = np.cumsum(kept) - 1
    weight = np.where(y == 1, seen[1] / max(1, y.sum()), seen[0] / max(1, (1 - y).sum()))
    w, bias = _logistic(row, place[col], ratio[col], y, weight, int(kept.sum()))
    weights = np.zeros(size, np.float32)
    weights[kept] = w * ratio[kept]
    return Model(weights, kept, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.kept, model.bias))

    def run(batches):
        weights, kept, bias = sent.value
        for part, raws in _groups(batches):
            doc, h = _hits(raws, kept)
            z = bias + np.bincount(doc, weights[h], len(raws))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that score below the threshold; rows never leave their task."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.kept, model.bias))
    limit = np.log(threshold / (1 - threshold))
    text = docs.columns.index("text")

    def run(batches):
        weights, kept, bias = sent.value
        for part, raws in _groups(batches, text):
            doc, h = _hits(raws, kept)
            yield part.filter(pa.array(bias + np.bincount(doc, weights[h], len(raws)) < limit))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): predicted is 1 from the threshold on."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
