"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words. Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and
share the total; no target exceeds MOST times its source's size, what lies above is shared
again by weight. A source's target is met by whole passes over its documents, then by a
choice of documents whose sizes add up to the rest: counts by exact size are taken in
proportion, and a bounded-knapsack table fits what is left to the word. Which documents of
a size are taken follows a seeded hash of doc_id.

Only counts by (source, size) reach the fit, one group a source; the choice of documents
ranks inside hash buckets of about BUCKET rows, so a size that holds a third of all rows
is spread out.

Defined cases: null texts have size 0 and are never more than 0 words of the mix; a null
source is a source of its own; repeated rows are separate documents; an empty table gives
no rows; other columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, text_key

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 7
BUCKET = 1024
CAPACITY = 1 << 17  # words that the knapsack table spans, or twice the longest document if that is more


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, most: float = MOST) -> list[float]:
    """Targets of sources in order: shares by weight, capped, the excess shared again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if rest * w[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            open_.discard(i)
        rest -= sum(out[i] for i in over)
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, capacity: int = CAPACITY) -> np.ndarray:
    """How many documents of each size to take (at most ``counts``) so that words come near ``budget``.

    If proportional counts leave no way to the word, they give way by a few documents of
    each size, so that the table has more to choose from.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    capacity = max(capacity, 2 * int(sizes.max()))
    best = None
    for back in (0, 1, 4, 16):
        taken = _fit(sizes, counts, budget, capacity, back)
        left = budget - int((sizes * taken).sum())
        if best is None or left < best[0]:
            best = left, taken
        if not left:
            break
    return best[1]


def _fit(sizes: np.ndarray, counts: np.ndarray, budget: int, capacity: int, back: int) -> np.ndarray:
    share = counts * (budget / int((sizes * counts).sum()))
    taken = np.clip(np.floor(share).astype(np.int64) - back, 0, counts)
    rest = budget - int((sizes * taken).sum())
    # more documents of sizes that the rounding cut, until the table spans the rest; it alone decides the fit
    order = np.lexsort((sizes, -(share - taken)))
    for i in order[sizes[order] > 0]:
        if rest <= capacity // 2:
            break
        if taken[i] < counts[i] and sizes[i] <= rest:
            taken[i] += 1
            rest -= int(sizes[i])
    for i in np.argsort(-sizes):
        if rest <= capacity or not sizes[i]:
            break
        more = min(int(counts[i] - taken[i]), (rest - capacity // 2) // int(sizes[i]))
        if more > 0:
            taken[i] += more
            rest -= more * int(sizes[i])
    span = min(rest, capacity)
    if span <= 0:
        return taken
    # bounded knapsack: copies of a size in powers of two; first[v] is the item that first reached v
    items, bits, mask = [], 1, (1 << (span + 1)) - 1
    first = np.full(span + 1, -1, np.int32)
    for i in np.argsort(sizes):
        size, left = int(sizes[i]), int(counts[i] - taken[i])
        if not size:
            continue
        left, step = min(left, span // size), 1
        while left > 0:
            n = min(step, left)
            new = (bits << n * size) & mask & ~bits
            if new:
                got = np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(span // 8 + 1, "little"), np.uint8), bitorder="little"))
                first[got] = len(items)
                items.append((i, n))
                bits |= new
            left, step = left - n, step * 2
        if bits >> span & 1:
            break
    v = bits.bit_length() - 1
    while v:
        i, n = items[first[v]]
        taken[i] += n
        v -= n * int(sizes[i])
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    goal, total = float(group.target.iloc[0]), int(group.source_size.iloc[0])
    passes = int(min(MOST, goal // total)) if total else 0
    rest = int(round(goal - passes * total)) if passes < MOST else 0
    sizes, counts = group["size"].to_numpy(np.int64), group.n.to_numpy(np.int64)
    return pd.DataFrame({"no_source": group.no_source, "key": group.key, "size": sizes, "n": counts, "extra": fit(sizes, counts, rest), "passes": passes, "source_size": total, "target": goal})


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, no_source, key, size, k, row) of ``docs`` (doc_id, source, text, row), and ``more`` of its columns."""
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("key"), word_count().alias("size"), text_key().alias("k"), "row")


_KEYS = ["no_source", "key"]


def _plans(sized: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(no_source, key, size) with n, extra, passes, source_size and target, and the hashes of doc_ids that fill a bucket by themselves."""
    spark = sized.sparkSession
    counts = sized.groupBy(*_KEYS, "size").agg(F.count("*").alias("n"))
    totals = sorted((r.no_source, r.key.encode(), r.key, int(r.total)) for r in counts.groupBy(*_KEYS).agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect())
    goals = targets([t[3] for t in totals])
    goal = spark.createDataFrame([(a, c, t, g) for (a, _, c, t), g in zip(totals, goals)], "no_source boolean, key string, source_size long, target double")
    plan = counts.join(goal, _KEYS).groupBy(*_KEYS).applyInPandas(_plan, "no_source boolean, key string, size long, n long, extra long, passes int, source_size long, target double")
    many = _hashed(sized, seed).groupBy(*_KEYS, "size", "h").agg(F.count("*").alias("same")).filter(F.col("same") > BUCKET)
    return staged(plan, "mixplan"), staged(many, "repeated")


def _hashed(sized: DataFrame, seed: int) -> DataFrame:
    return sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))


def _bucketed(planned: DataFrame, many: DataFrame) -> DataFrame:
    """Rows with their plan and h, and the bucket (b, c) that they are ranked in."""
    # a doc_id that fills a bucket by itself is spread over buckets of its own; these are fewer than one in BUCKET rows
    part = planned.join(F.broadcast(many), [*_KEYS, "size", "h"], "left")
    part = part.withColumn("b", F.pmod(F.shiftrightunsigned("h", 20), F.ceil(F.col("n") / BUCKET)))
    return part.withColumn("c", F.when(F.col("same").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("k", "row"), F.ceil(F.col("same") / BUCKET))))


def _ranked(sized: DataFrame, plan: DataFrame, many: DataFrame, seed: int) -> DataFrame:
    """Rows with their plan, bucket and rank (from 1) among those of a source and size.

    ``row`` numbers rows; of rows of a size that share their doc_id, equal texts lie together
    and may be taken for one another.
    """
    part = _bucketed(_hashed(sized, seed).join(plan, [*_KEYS, "size"]), many)
    group = [*_KEYS, "size", "b", "c"]
    before = Window.partitionBy(*_KEYS, "size").orderBy("b", "c").rowsBetween(Window.unboundedPreceding, -1)
    at = part.groupBy(*group).agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    r = F.row_number().over(Window.partitionBy(*group).orderBy("h", "doc_id", "k", "row"))
    return part.withColumn("r", r).join(at, group).withColumn("rank", F.col("r") + F.col("before"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): size, source_size, target, copies, taken."""
    # narrow passes follow; texts are read once
    sized = staged(_sized(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))), "sizes")
    ranked = _ranked(sized, *_plans(sized, seed), seed)
    copies = F.col("passes") + (F.col("rank") <= F.col("extra")).cast("int")
    found = ranked.select("doc_id", F.expr("if(no_source, null, key)").alias("source"), "size", "source_size", "target", copies.alias("copies"))
    return found.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


#: Sources times sizes whose last taken rows go to every task; where there are more, rows meet them by a shuffle.
SENT_CUTS = 200_000


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged.

    Rows are numbered in a written table first, so each gets its own copies, whether ids
    repeat or are null; columns stay in one struct, so that no name clashes. What a row
    gets follows from where it stands to the last one taken of its source and size, so
    that texts are not shuffled.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    numbered = docs.select("doc_id", "source", "text", doc.alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = staged(_sized(numbered, "doc"), "rows")
    sized = rows.drop("doc")
    plan, many = _plans(sized, seed)
    place = F.struct("b", "c", "h", F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), "k", "row")
    last = _ranked(sized, plan, many, seed).filter("rank = extra").select(*_KEYS, "size", place.alias("last"))
    cuts = staged(plan.select(*_KEYS, "size", "n", "passes").join(last, [*_KEYS, "size"], "left"), "cuts")
    if cuts.limit(SENT_CUTS + 1).count() <= SENT_CUTS:
        cuts = F.broadcast(cuts)
    part = _bucketed(_hashed(rows, seed).join(cuts, [*_KEYS, "size"]), many)
    copies = F.col("passes") + F.coalesce(place <= F.col("last"), F.lit(False)).cast("int")
    return part.withColumn("copies", copies).filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")
