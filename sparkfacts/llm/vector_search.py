"""Exact top-k inner products, pruned by multi-resolution segment statistics.

A vector is cut into segments; with the mean u and deviation s of each m-long segment,
|x - q|^2 >= sum m((u-u')^2 + (s-s')^2), that is x.q <= sum m(uu' + ss'). The bound is
taken with few segments, then with more, and exact products are made for what is left.

Queries go out in waves of at most WAVE vectors (a fixed size, broadcast); each wave reads
all candidates once, every task keeps its k best for each query, and a window merges them.
A wave starts with the k-th best score among its own queries as a sure lower limit.

Defined cases: vectors null or with null or non-finite components take no part; shorter
vectors count as padded with zeros; each row is a query and a candidate of its own even
where ids repeat, but a query never meets rows of its own id; ties go to the smaller id;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

K = 20
WAVE = 4096
LEVELS = (2, 8)
SCALE = 64.0
PAIRS = 1 << 22  # scores held at a time
HELD = 1 << 20  # candidates held before a task cuts back to the k best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows floor(64 x) as exact floats, padded to the longest vector or cut to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    wide = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), wide))
    col = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, fits = np.repeat(np.arange(len(lengths)), lengths), col < wide
    out[row[fits], col[fits]] = values[fits]
    return out


def _stats(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(m) times mean and deviation of each segment, side by side."""
    cuts = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    if not parts:
        return np.zeros((len(x), 1))
    return np.column_stack([f(p, axis=1) * math.sqrt(p.shape[1]) for p in parts for f in (np.mean, np.std)])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, as integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.vectorize(lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63), otypes=[np.int64])(whole(a) @ whole(b).T)


def _best(q, v, s, k):
    """Of (query, id, score) triples the k best for each query; also the order's query starts."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(q)) + 1)) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return q[keep], v[keep], s[keep], rank[keep]


def _scan(batches, ids, x, floor, k):
    """Of all candidates in the batches, those that may be among the k best of each query."""
    floor = floor.copy()
    levels = [(n, _stats(x, n)) for n in LEVELS]
    step = max(1, PAIRS // max(1, len(ids)))
    held, size = [], 0

    def cut():
        nonlocal held, size
        q, v, s, rank = _best(*(np.concatenate(c) for c in zip(*held)), k)
        last = rank == k - 1
        floor[q[last]] = np.maximum(floor[q[last]], s[last])
        held, size = [(q, v, s)], len(q)

    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            v, y = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), x.shape[1])
            alive = None
            for n, sx in levels:
                sy = _stats(y, n)
                if alive is None:
                    top = sx @ sy.T
                    # the slack covers rounding of the bound, which goes by the norms, so that none is lost
                    nx, ny = (np.sqrt((v * v).sum(axis=1)) for v in (sx, sy))
                    slack = 1e-9 * nx[:, None] * ny[None, :] + 1e-6
                    alive = np.nonzero(top + slack >= floor[:, None])
                elif len(alive[0]):
                    top = np.einsum("ij,ij->i", sx[alive[0]], sy[alive[1]]) if len(alive[0]) < 0.2 * len(ids) * len(v) else (sx @ sy.T)[alive]
                    fit = top + slack[alive] >= floor[alive[0]]
                    alive = (alive[0][fit], alive[1][fit])
            qi, ci = alive
            if not len(qi):
                continue
            if len(qi) < 0.05 * len(ids) * len(v):
                s = np.concatenate([np.rint(np.einsum("ij,ij->i", x[qi[a : a + 65536]], y[ci[a : a + 65536]])) for a in range(0, len(qi), 65536)])
                s = s.astype(np.int64) if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < 2**53 else _exact(x, y)[qi, ci]
            else:
                s = _exact(x, y)[qi, ci]
            fit = (s >= floor[qi]) & (v[ci] != ids[qi])
            held.append((qi[fit], v[ci][fit], s[fit]))
            size += int(fit.sum())
            if size > HELD:
                cut()
    if held:
        cut()
    return held


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row."""
    spark = vectors.sparkSession
    # rows that ask the same are one query and get the same rows each
    pool, asked = usable(vectors), staged(usable(queries).groupBy("vec_id", "x").agg(F.count("*").alias("n")), "queries")
    waves = max(1, math.ceil(asked.count() / wave))
    asked = asked.withColumn("w", F.pmod(F.xxhash64("vec_id", "x"), F.lit(waves)))
    out = None
    for w in range(waves):
        got = asked.filter(F.col("w") == w).select("vec_id", "x", "n").toArrow()
        ids, x, times = got.column(0).to_numpy(), _matrix(got.column(1)), got.column(2).to_numpy()
        own = _exact(x, x).astype(np.float64) if len(ids) else np.zeros((0, 0))
        own[ids[:, None] == ids[None, :]] = -np.inf
        floor = np.partition(own, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(ids), -np.inf)
        sent = spark.sparkContext.broadcast((ids, x, floor, times))

        def run(batches, sent=sent):
            ids, x, floor, times = sent.value
            for q, v, s in _scan(batches, ids, x, floor, k) if len(ids) else []:
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids[q]), pa.array(v), pa.array(s), pa.array(times[q])], ["q", "query_id", "vec_id", "score", "times"])

        near = pool.mapInArrow(run, "q long, query_id long, vec_id long, score long, times long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        best = near.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("t", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")
        best = staged(best, "wave") if waves > 1 else best
        out = best if out is None else out.unionByName(best)
    return out


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
