"""Language ID by prediction by partial matching (PPM) under frozen statistics.

Each language has a tree of byte contexts up to ORDER bytes; a byte costs the code length
that the longest known context gives it, with an escape (method C) to the next shorter one
where the context hasn't seen it. The language with the shortest code wins. Letters are
lower-cased (A-Z) and other ASCII bytes read as spaces, in learning and in prediction.

The trees are counted by Spark over at most SAMPLE documents of each language, in hash
order of doc_id; n-grams of three bytes and more need MIN_COUNT occurrences. Both bounds
are parameters, and the model's size follows them, not the corpus. Costs are laid out as
one row per n-gram with a column per language, so a position takes one look-up in most
cases; scores are those of walking the trees byte by byte.

Defined cases: texts null, empty or without a letter give ``und`` with score 0, and so
does every text if nothing can be learned; ties go to the language first in order;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, table, texts

ORDER = 4
SAMPLE = 500
SALTS = 64
MIN_COUNT = 2
PIECE = 1 << 19
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PAD = b" " * ORDER
NONE = "und"
_LETTER = re.compile(rb"[A-Za-z]")


def _grams(values: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position from n - 1 on, as one number."""
    out = values[: len(values) - n + 1].copy()
    for i in range(1, n):
        out = (out << np.uint64(8)) | values[i : len(values) - n + 1 + i]
    return out


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw)) or any(map(str.isalpha, raw.decode("utf-8", "ignore")))


class Lookup:
    """Row of a 64-bit key, or -1: two direct tables, and a sorted list for what collides in both."""

    def __init__(self, keys: np.ndarray):
        self.tables, rows = [], np.arange(len(keys), dtype=np.int32)
        for mult, spare in ((0x9E3779B97F4A7C15, 4), (0xC2B2AE3D27D4EB4F, 2)):
            bits = max(4, int(spare * max(1, len(keys)) - 1).bit_length())
            slot = self._slot(keys, mult, bits)
            _, first = np.unique(slot, return_index=True)
            at, row = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, -1, np.int32)
            at[slot[first]], row[slot[first]] = keys[first], rows[first]
            self.tables.append((mult, bits, at, row))
            keys, rows = np.delete(keys, first), np.delete(rows, first)
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    @staticmethod
    def _slot(keys, mult, bits):
        return ((keys * np.uint64(mult)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int32), None
        for mult, bits, at, row in self.tables:
            k = keys if open_ is None else keys[open_]
            slot = self._slot(k, mult, bits)
            hit = at[slot] == k
            if open_ is None:
                out = np.where(hit, row[slot], -1)
                open_ = np.flatnonzero(~hit)
            else:
                out[open_[hit]] = row[slot[hit]]
                open_ = open_[~hit]
        if len(self.keys) and len(open_):
            i = np.minimum(np.searchsorted(self.keys, keys[open_]), len(self.keys) - 1)
            hit = self.keys[i] == keys[open_]
            out[open_[hit]] = self.rows[i[hit]]
        return out


class Model:
    """Frozen costs in bits. ``costs[k]`` has a row per (k + 1)-gram, ``escapes[k]`` per k-byte context."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each order k, sorted (k + 1)-grams and their counts by language."""
        self.langs, self.grams, self.costs, self.contexts, self.escapes = langs, [], [], [], []
        for k, (keys, n) in enumerate(counts):
            context, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), len(langs))), np.zeros((len(context), len(langs)))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                known = -np.log2(n / (total[of] + kinds[of]))
            if k == 0:
                lower = np.full(n.shape, 8.0)
            else:
                below = Lookup(self.grams[-1][1])
                lower = self.costs[-1][below.find(keys & np.uint64((1 << 8 * k) - 1))].astype(float)
            self.costs.append(np.where(n > 0, known, escape[of] + lower).astype(np.float32))
            self.escapes.append(escape.astype(np.float32))
            self.grams.append((Lookup(keys), keys))
            self.contexts.append(Lookup(context))

    def position_costs(self, values: np.ndarray) -> np.ndarray:
        """Cost by language of each byte from ORDER on, given the bytes before it."""
        top = len(self.costs) - 1
        key = _grams(values, top + 1)
        row = self.grams[top][0].find(key)
        out = self.costs[top][row]
        at = np.flatnonzero(row < 0)
        if len(at):
            out[at] = 0
        for k in range(top, -1, -1):
            if not len(at):
                break
            if k < top:
                row = self.grams[k][0].find(key[at] & np.uint64((1 << 8 * (k + 1)) - 1))
                hit = row >= 0
                out[at[hit]] += self.costs[k][row[hit]]
                at = at[~hit]
            context = self.contexts[k].find((key[at] & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8))
            known = context >= 0
            out[at[known]] += self.escapes[k][context[known]]
        out[at] += 8.0
        return out

    def code_lengths(self, raws: list[bytes]) -> np.ndarray:
        """Total bits of each text by language."""
        out = np.zeros((len(raws), len(self.langs)))
        buf = np.frombuffer(b"".join(PAD + r.translate(PLAIN) for r in raws), np.uint8).astype(np.uint64)
        size = np.array([len(r) for r in raws], np.int64)
        end = np.cumsum(size + ORDER)
        begin = end - size
        for a in range(ORDER, len(buf), PIECE):
            b = min(a + PIECE, len(buf))
            cost = self.position_costs(buf[a - ORDER : b])
            docs = np.arange(np.searchsorted(end, a, side="right"), np.searchsorted(begin, b, side="left"))
            lo, hi = np.maximum(begin[docs], a) - a, np.minimum(end[docs], b) - a
            docs, lo, hi = docs[hi > lo], lo[hi > lo], hi[hi > lo]
            if len(docs):
                cuts = np.column_stack((lo, hi)).ravel()
                cuts = cuts[:-1] if cuts[-1] == len(cost) else cuts
                out[docs] += np.add.reduceat(cost, cuts, axis=0, dtype=np.float64)[::2]
        return out


def train(docs: DataFrame, sample: int = SAMPLE, min_count: int = MIN_COUNT) -> Model | None:
    """Counts the trees of every language outside the held-out third; None without any."""
    ids = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang").distinct()
    # the first of each language in hash order; those of SALTS shares come first, so that no task ranks a language whole
    h, drawn = F.xxhash64("doc_id"), ids
    for share in (["lang", F.pmod(h, F.lit(SALTS))], ["lang"]):
        drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy(*share).orderBy(h, "doc_id"))).filter(F.col("nth") <= sample).select("doc_id", "lang")
    langs = sorted(r.lang for r in drawn.select("lang").distinct().collect())
    if not langs:
        return None
    picked = texts(docs).join(F.broadcast(drawn), "doc_id").select("lang", "text").repartition(8, "lang", F.xxhash64("text") % 2)

    def count(batches):
        held: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, []).append(PAD + raw.as_py().translate(PLAIN))
        for lang, raws in held.items():
            for k in range(ORDER + 1):
                keys = [_grams(np.frombuffer(r, np.uint8).astype(np.uint64)[ORDER - k :], k + 1) for r in raws if len(r) > ORDER]
                gram, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "gram", "n"])

    total = picked.mapInArrow(count, "lang string, k int, gram long, n long").groupBy("k", "gram", "lang").agg(F.sum("n").alias("n")).filter((F.col("k") < 2) | (F.col("n") >= min_count)).toArrow()
    k, gram, n = (total.column(c).to_numpy() for c in ("k", "gram", "n"))
    lang = np.searchsorted(langs, total.column("lang").to_numpy(zero_copy_only=False).astype(str)) if total.num_rows else np.zeros(0, int)
    counts = []
    for order in range(ORDER + 1):
        m = k == order
        keys, of = np.unique(gram[m].astype(np.uint64), return_inverse=True)
        by = np.zeros((len(keys), len(langs)))
        by[of, lang[m]] = n[m]
        counts.append((keys, by))
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): score is the winner's share of 2^-bits over all languages."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            at, size = 0, 0
            for i in range(batch.num_rows):
                size += len(batch.column(1)[i].as_buffer())
                if i + 1 - at < 256 and size < 1 << 20 and i + 1 < batch.num_rows:
                    continue
                part, size = batch.slice(at, i + 1 - at), 0
                at = i + 1
                raws = [x.as_py() for x in part.column(1)]
                bits = model.code_lengths(raws)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.minimum(0, bits.min(axis=1)[:, None] - bits)).sum(axis=1)
                letter = np.array([has_letter(r) for r in raws])
                names = [model.langs[b] if ok else NONE for b, ok in zip(best, letter)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(letter, share, 0.0))], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
