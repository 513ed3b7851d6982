"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

One scan turns every whole text into STATISTICS numbers. These are centred and scaled by
the training rows and mapped to cosines of random projections, which approximate a
Gaussian kernel. Each partition sums its rows' normal equations, by fold; the sums, whose
size depends on the number of features alone, meet at the driver. They give the ridge
weights without each fold, so the penalty is chosen by exact cross-validation, and every
training row a score from weights that haven't seen it. Pooled by score in BINS bins, these
fit the isotonic curve that turns scores into probabilities. All labelled rows outside the
held-out third are used: nothing is sampled.

Defined cases: null and empty texts have statistics of their own (zeros) and a score; a
doc_id labelled more than once counts with its highest label, labels other than 0 and 1
and of null doc_ids don't count; without labels every score is 0.5, with labels of one
class that class; repeated rows get equal scores; statistics of words and lines are taken in
pieces of PIECE bytes, cut at white space, and averaged by size, so that very long texts
need no more memory; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, staged, table, texts
from .rolling import tidy

FEATURES = 512
FOLDS = 5
WIDTH = 1.5  # of the kernel, in units of the square root of the number of statistics
PENALTIES = tuple(10.0**e for e in range(-5, 3))  # a row
BINS = 4096
ROWS = 100_000  # a partition's rows of the normal equations, at least
PIECE = 1 << 20
FARTHEST = 6.0  # standard deviations
SEED = 12
CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digits": range(48, 58), "blank": (9, 10, 11, 12, 13, 32), "stops": b".,;:", "calls": b"!?",
    "quotes": b"'\"()-", "marks": b"#$%&*+/<=>@[\\]^_`{|}~", "control": (*range(0, 9), *range(14, 32), 127), "other": range(192, 256),
}
_CLASS = np.zeros((256, len(CLASSES)))
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes), _i] = 1
STATISTICS = (
    "log_chars", "log_words", *(f"share_{c}" for c in CLASSES), "byte_entropy", "upper_of_letters",
    "word_length", "word_length_deviation", "distinct_words", "distinct_pairs", "same_as_before", "top_word", "capital_words", "equal_lines", "words_a_line",
)


def _words(piece: bytes) -> tuple[int, np.ndarray]:
    words = piece.split()
    n = len(words)
    if not n:
        return 0, np.zeros(9)
    sizes, each, lines = np.fromiter(map(len, words), float, n), Counter(words), piece.strip().split(b"\n")
    return n, np.array([
        sizes.mean(), sizes.std(), len(each) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), sum(map(eq, words, words[1:])) / max(1, n - 1),
        max(each.values()) / n, sum(map(bytes.isupper, words)) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    ])


def statistics(raw: bytes) -> np.ndarray:
    """The STATISTICS of a text's UTF-8 bytes."""
    counts, n, sums, at = np.zeros(256), 0, np.zeros(9), 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] > 32:
            end += 1
        piece = raw[at:end]
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        own, values = _words(piece)
        n, sums, at = n + own, sums + own * values, end
    chars = counts[:128].sum() + counts[192:].sum()
    classes = counts @ _CLASS
    shares = classes / max(1.0, chars)
    seen = counts[counts > 0] / max(1.0, counts.sum())
    upper = classes[1] / max(1.0, classes[0] + classes[1] + classes[-1])
    return np.concatenate(([np.log1p(chars), np.log1p(n)], shares, [-(seen * np.log(seen)).sum(), upper], sums / max(1, n)))


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row: its statistics, packed as doubles."""

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_buffer().to_pybytes()).astype("<f8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["doc_id", "x"])
        tidy()

    return texts(docs).mapInArrow(run, "doc_id long, x binary")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    direction: np.ndarray  # statistics x features
    phase: np.ndarray
    weights: np.ndarray  # features and one constant
    curve: tuple[np.ndarray, np.ndarray]  # ridge scores and their probabilities, both rising

    def features(self, x: np.ndarray) -> np.ndarray:
        near = np.clip((x - self.mean) / self.scale, -FARTHEST, FARTHEST)
        z = np.cos(near @ self.direction + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate((z, np.ones((len(x), 1))), axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights
        # a thousandth of the ridge score keeps texts apart that share a level of the curve
        return np.clip(0.999 * np.interp(raw, *self.curve) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), "<f8").reshape(len(column), -1)


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over partitions of the ``size`` doubles that ``make`` gives of a partition's batches."""
    part = 1 << 16

    def run(batches):
        total = make(batches)
        if total is not None:
            for s in range(0, size, part):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([total[s : s + part].astype("<f8").tobytes()], pa.binary())], ["s", "v"])

    def add(table):
        total = sum(np.frombuffer(x.as_buffer().to_pybytes(), "<f8") for x in table["v"])
        return pa.table({"s": table["s"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(run, "s int, v binary").groupBy("s").applyInArrow(add, "s int, v binary").collect()
    return np.concatenate([np.frombuffer(bytes(r.v), "<f8") for r in sorted(found, key=lambda r: r.s)]) if found else np.zeros(size)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to y by weighted squares, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for v, w in zip(y.tolist(), weight.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([p[0] for p in pools], [p[2] for p in pools])


def solve(a: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights of normal equations; the constant, in the last place, isn't penalised."""
    d = np.full(len(b), penalty)
    d[-1] = 1e-9
    return np.linalg.solve(a + np.diag(d), b)


def constant(share: float) -> Model:
    k = len(STATISTICS)
    return Model(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(2), (np.array([-1.0, 1.0]), np.array([share, share])))


def train(described_docs: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH) -> Model:
    """Fits on all labelled rows outside the held-out third; what reaches the driver doesn't grow with them."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    rows = staged(described_docs.join(known, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "y", "x"), "quality_rows")
    seen = rows.agg(F.count("*").alias("n"), F.avg("y").alias("share")).first()
    if not seen.n or seen.share in (0.0, 1.0):
        return constant(0.5 if not seen.n else seen.share)
    rows = rows.repartition(max(1, seen.n // ROWS))
    k = len(STATISTICS)

    def moments(batches):
        total = np.zeros(2 * k)
        for batch in batches:
            x = _matrix(batch.column("x"))
            total += np.concatenate((x.sum(0), (x * x).sum(0)))
        return total

    one, two = _summed(rows, moments, 2 * k).reshape(2, k) / seen.n
    rng = np.random.default_rng(SEED)
    base = Model(one, np.sqrt(np.maximum(two - one * one, 1e-8)), rng.normal(0, 1 / (width * np.sqrt(k)), (k, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), (np.zeros(1), np.zeros(1)))
    m = features + 1
    sent = rows.sparkSession.sparkContext.broadcast(base)

    def equations(batches):
        total = np.zeros((FOLDS, m + 1, m + 1))  # features and y against features and y
        for batch in batches:
            fold, y = (batch.column(c).to_numpy() for c in ("fold", "y"))
            for a in range(0, len(y), 4096):
                z = np.concatenate((sent.value.features(_matrix(batch.column("x")[a : a + 4096])), y[a : a + 4096, None]), axis=1)
                for f in range(FOLDS):
                    own = z[fold[a : a + 4096] == f]
                    total[f] += own.T @ own
        return total.reshape(-1)

    sums = _summed(rows, equations, FOLDS * (m + 1) ** 2).reshape(FOLDS, m + 1, m + 1)
    whole = sums.sum(0)
    best = None
    for p in PENALTIES:
        left_out = [solve(whole[:m, :m] - s[:m, :m], whole[:m, m] - s[:m, m], p * seen.n) for s in sums]
        error = sum(s[m, m] - 2 * w @ s[:m, m] + w @ s[:m, :m] @ w for w, s in zip(left_out, sums))
        if best is None or error < best[0]:
            best = (error, p, np.array(left_out))
    _, penalty, left_out = best

    def binned(batches):
        total = np.zeros((2, BINS))
        for batch in batches:
            fold, y = (batch.column(c).to_numpy() for c in ("fold", "y"))
            for a in range(0, len(y), 4096):
                raw = (sent.value.features(_matrix(batch.column("x")[a : a + 4096])) * left_out[fold[a : a + 4096]]).sum(1)
                at = np.clip((raw + 1) * (BINS / 3), 0, BINS - 1).astype(int)
                total += [np.bincount(at, minlength=BINS), np.bincount(at, y[a : a + 4096], BINS)]
        return total.reshape(-1)

    n, right = _summed(rows, binned, 2 * BINS).reshape(2, BINS)
    at = np.flatnonzero(n)
    centre = (at + 0.5) * (3 / BINS) - 1
    level = isotonic(right[at] / n[at], n[at])
    # one point a level, at its rows' mean score: straight lines between them rise
    starts = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
    mass = np.add.reduceat(n[at], starts)
    base.curve = np.add.reduceat(n[at] * centre, starts) / mass, level[starts]
    base.weights = solve(whole[:m, :m], whole[:m, m], penalty * seen.n)
    return base


def score(described_docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = described_docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.probability(_matrix(part.column("x"))))], ["doc_id", "score"])

    return described_docs.mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted): predicted is 1 from the threshold on."""
    known = staged(described(docs), "statistics")
    scored = score(known, train(known, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
