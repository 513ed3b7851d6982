"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation; numbers, capitalised words (names) and units after
a number become typed placeholders. Windows of WINDOW template words of the benchmark and
of the documents are joined by hash. A pair counts if its slots are consistent: wherever
two slots of the item hold one value, those of the document do too, and the other way
round. So a question with other numbers or names is caught, one with slots mixed up isn't.
Beside them, the same windows of plain lower-cased words are joined by hash, so that a
verbatim copy is caught whatever its letter case makes of its names.

A bitmap of a fixed size drops document windows that no item can have before the join;
for each window one item, the smallest, stands for all that share it, so the join never
makes more rows than there are document windows, of templates and of plain words.

Defined cases: null and empty texts have no windows and are clean; items shorter than a
window are one window, of SHORTEST or more words a template, of PLAIN or more words plain
words only, and one or two words are no evidence; windows with fewer literal words than
half are matched by their plain words only; rows are judged each for itself, whether ids
repeat or are null, and equal rows alike; an empty benchmark leaves every document clean;
other columns are ignored by ``judge`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import as_rows, no_null_ids, null_ids_back, staged, table, text_key, texts

WINDOW = 10
SHORTEST = 5
PLAIN = 3
UNITS = ("mm cm m km g kg mg lb lbs oz l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
         "meter meters metre metres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
         "dollar dollars euro euros cent cents usd eur percent degree degrees celsius fahrenheit kb mb gb tb hz khz mhz w kw v")  # fmt: skip
CACHED_WORDS = 150_000

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*(%|°)?\Z")
_QUANTITY = re.compile(r"[$€£]?\d[\d.,]*([^\W\d_]{1,4})\Z")
_OUTER = re.compile(r"^[^\w$€£+-]+|[^\w%°]+$")


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) | 1


_UNITS = frozenset(UNITS.split())
NUM, NAME, UNIT = (_hash(x) for x in ("<number>", "<name>", "<unit>"))
_UNIT_HASHES = np.array(sorted(_hash(u) for u in _UNITS), np.uint64)
_SLOTS = np.array(sorted((NUM, NAME, UNIT)), np.uint64)


def core(word: bytes) -> str:
    return _OUTER.sub("", word.decode("utf-8", "replace"))


class Tokens(dict):
    """Template hash of each word; 0 drops the word. Unknown words are classified once."""

    def __missing__(self, word: bytes) -> int:
        text = core(word)
        if not any(c.isalnum() for c in text):
            out = 0
        elif _NUMBER.match(text) or ((m := _QUANTITY.match(text)) and m[1].lower() in _UNITS):
            out = NUM
        elif len(text) > 1 and text[0].isupper() and text[1:].islower():
            out = NAME
        else:
            out = _hash(text.lower())
        if len(self) < CACHED_WORDS and len(word) < 64:
            self[word] = out
        return out


class Plain(dict):
    """Hash of each word without case and outer punctuation."""

    def __missing__(self, word: bytes) -> int:
        out = _hash(core(word).lower())
        if len(self) < CACHED_WORDS and len(word) < 64:
            self[word] = out
        return out


_tokens, _plain = Tokens(), Plain()
_VERBATIM = np.uint64(_hash("<verbatim>"))  # keeps hashes of plain windows apart from those of templates


def template(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Template hashes, the words they stand for (by index), all words, and hashes of the plain words."""
    words = raw.split()
    t = np.fromiter(map(_tokens.__getitem__, words), np.uint64, len(words))
    at = np.flatnonzero(t)
    t = t[at]
    plain = t.copy()
    filled = np.flatnonzero((t == np.uint64(NUM)) | (t == np.uint64(NAME)))
    plain[filled] = np.fromiter((_plain[words[i]] for i in at[filled]), np.uint64, len(filled))
    if len(t) > 1:
        after = np.flatnonzero((t[:-1] == np.uint64(NUM)) & np.isin(t[1:], _UNIT_HASHES)) + 1
        t[after] = np.uint64(UNIT)
    return t, at, words, plain


def slots(t: np.ndarray, at: np.ndarray, words: list[bytes], start: int, width: int) -> int:
    """Hash of which slots of a window hold equal values."""
    seen: dict[tuple[int, str], int] = {}
    own = [int(x) for x in t[start : start + width]]
    kinds = {NUM, NAME, UNIT}
    return _hash(repr([seen.setdefault((x, core(words[i]).lower()), len(seen)) for x, i in zip(own, at[start : start + width]) if x in kinds])) - (1 << 63)


def _starts(stop: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that end in their text, whose end ``stop`` gives for each word."""
    start = np.arange(max(0, len(stop) - width + 1))
    return start[start + width <= stop[start]]


def _windows(t: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of windows with enough literal words."""
    literal = np.concatenate(([0], np.cumsum(~np.isin(t, _SLOTS))))
    start = start[2 * (literal[start + width] - literal[start]) >= width]
    return start, R.window(R.sums(t), start, start + width)


def _verbatim(plain: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of plain words."""
    return R.mix(R.window(R.sums(plain), start, start + width) ^ _VERBATIM)


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(h, slots, width, item_id): windows of all items, those of plain words with slots 0."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                t, at, words, plain = template(x.as_py())
                w = min(width, len(t))
                if w < PLAIN:
                    continue
                every = _starts(np.full(len(t), len(t)), w)
                for s, h in zip(*_windows(t, every, w)) if w >= SHORTEST else ():
                    rows.append((int(h.astype(np.int64)), slots(t, at, words, int(s), w), w, i))
                rows += [(int(h), 0, w, i) for h in _verbatim(plain, every, w).astype(np.int64)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["h", "slots", "width", "item_id"])

    items = benchmark.select(F.col("item_id").alias("doc_id"), "text")
    return texts(items).mapInArrow(run, "h long, slots long, width int, item_id long")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, k, item_id, p): windows of documents that match an item with consistent slots; k tells rows of one doc_id apart."""
    sc = docs.sparkSession.sparkContext
    known = staged(item_windows(benchmark, width).groupBy("h", "slots", "width").agg(F.min("item_id").alias("item_id")), "items")
    widths = sorted(r.width for r in known.select("width").distinct().collect())
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, k long, item_id long, p int")
    index = sc.broadcast(R.bitmap_of(known.select("h"), lambda bs: (b.column(0).to_numpy().astype(np.uint64) for b in bs), R.bits_for(known.count())))

    def probe(batches):
        for part, raws in R.buffers(batches, 2):
            ids, keys, read = part.column(0).to_pylist(), part.column(1).to_pylist(), [template(raw) for raw in raws]
            size = np.array([len(x[0]) for x in read])
            ends = np.cumsum(size)
            row, stop = np.repeat(np.arange(len(size)), size), np.repeat(ends, size)
            t, plain = np.concatenate([x[0] for x in read]), np.concatenate([x[3] for x in read])
            rows = []
            for w in widths:
                every = _starts(stop, w)
                start, h = _windows(t, every if w >= SHORTEST else every[:0], w)
                near = np.flatnonzero(R.member(index.value, h))
                for x, y in zip(start[near], h[near].astype(np.int64)):
                    own, p = read[row[x]], int(x - ends[row[x]] + size[row[x]])
                    rows.append((ids[row[x]], keys[row[x]], p, int(y), slots(*own[:3], p, w)))
                h = _verbatim(plain, every, w)
                near = np.flatnonzero(R.member(index.value, h))
                rows += [(ids[r], keys[r], int(p), int(y), 0) for r, p, y in zip(row[every[near]], every[near] - (ends - size)[row[every[near]]], h[near].astype(np.int64))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "k", "p", "h", "own"])
        part = raws = read = row = stop = t = plain = every = None
        R.tidy()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = source.mapInArrow(probe, "doc_id long, k long, p int, h long, own long")
    return found.join(known, "h").filter("own = slots").select("doc_id", "k", "item_id", "p")


def judge(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated (0 or 1), n_windows, item_id (the smallest matched)."""
    docs = no_null_ids(docs)
    found = hits(docs, benchmark, width).groupBy("doc_id", "k").agg(F.countDistinct("p").alias("n"), F.min("item_id").alias("item_id"))
    out = docs.select("doc_id", text_key().alias("k")).join(found, ["doc_id", "k"], "left")
    return null_ids_back(out).select("doc_id", F.col("n").isNotNull().cast("int").alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_windows"), "item_id")


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that match no item."""
    found = staged(hits(no_null_ids(docs), benchmark, width).select("doc_id", "k").distinct(), "contaminated")
    return as_rows(docs).join(found, ["doc_id", "k"], "left_anti").select("doc.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
