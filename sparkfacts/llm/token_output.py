"""Token-ID output: one wavelet matrix per shard file, with rank and select support.

Texts are encoded where they are read, ids (not texts) are dealt to ranges of doc_id, and
each range writes its shards in ascending doc_id order, one file a shard. A shard holds
the ids of whole documents, about SHARD_TOKENS of them, as packed bit planes in small
compressed blocks with ranks beside them; token access, counting and occurrence lookup
read a few blocks of each plane and leave the rest as it is (``WaveletMatrix``).

Defined cases: null and empty texts give the end id alone; rows that repeat a doc_id are
kept, in the order of a hash of their ids, and spread over ranges if there are many; a
very long text makes a shard of its own size; an empty table gives an empty file set and
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import no_null_ids, null_ids_back, staged, table, texts
from .rolling import tidy

SHARD_TOKENS = 1 << 20
CACHED_WORDS = 500_000
CACHED_LENGTH = 48
END_ID = 2
SPAN = 512  # bits between stored ranks
BLOCK = 4096  # bytes of a plane that are compressed together
HELD_BLOCKS = 64
HEAD = "<4sQHHI"


class WaveletMatrix:
    """Bit planes from the highest bit down; each plane moves zeros before ones, stably.

    Planes stay packed, eight bits a byte: as arrays where the matrix was built, as
    compressed blocks, of which HELD_BLOCKS are held open, where it was read.
    """

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.width, self.planes, self.opened = n, len(planes), planes, {}
        self.ranks = [self._count(p) for p in planes]
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    @staticmethod
    def _count(plane: np.ndarray) -> np.ndarray:
        """Ones before each span and before the end."""
        ones = np.bitwise_count(plane)
        return np.concatenate(([0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), SPAN // 8), dtype=np.int64)))) if len(ones) else np.zeros(1, np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, width: int | None = None) -> WaveletMatrix:
        width = width or max(1, int(ids.max(initial=0)).bit_length())
        kind = np.uint16 if width <= 16 else np.uint32
        ids, planes = np.ascontiguousarray(ids, dtype=kind), []
        for k in range(width - 1, -1, -1):
            one = (ids & kind(1 << k)) != 0
            planes.append(np.packbits(one))
            ids = np.concatenate((ids.take(np.flatnonzero(~one)), ids.take(np.flatnonzero(one))))
        return cls(len(ids), planes)

    def _block(self, plane: int, j: int) -> np.ndarray:
        if (plane, j) not in self.opened:
            import zstandard

            if len(self.opened) >= HELD_BLOCKS:
                self.opened.pop(next(iter(self.opened)))
            at, size = self.at[plane][j + 1], self.sizes[plane][j + 1]
            self.opened[plane, j] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.raw[at : at + size]), np.uint8)
        return self.opened[plane, j]

    def _span(self, plane: int, s: int) -> np.ndarray:
        """The packed bits of a span."""
        a = s * (SPAN // 8)
        if self.planes is not None:
            return self.planes[plane][a : a + SPAN // 8]
        return self._block(plane, a // BLOCK)[a % BLOCK : a % BLOCK + SPAN // 8]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones in the first i bits of a plane."""
        s, rest = divmod(i, SPAN)
        if not rest:
            return int(self.ranks[plane][s])
        span, whole = self._span(plane, s), rest // 8
        ones = int(self.ranks[plane][s]) + int(np.bitwise_count(span[:whole]).sum())
        return ones + (int(span[whole]) >> (8 - rest % 8)).bit_count() if rest % 8 else ones

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        r = self.ranks[plane]
        if not bit:
            r = np.minimum(np.arange(len(r)) * SPAN, self.n) - r
        s = int(np.searchsorted(r, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self._span(plane, s)) == bit)
        return s * SPAN + int(inside[k - int(r[s])])

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for k in range(self.width):
            bit, ones = int(self._span(k, i // SPAN)[i % SPAN // 8]) >> (7 - i % 8) & 1, self._rank1(k, i)
            out = out << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.width):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            if symbol >> (self.width - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions lo to hi."""
        if symbol >> self.width:
            return 0
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def find(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.width - 1, -1, -1):
            i = self._select(p, 1, i - self.zeros[p]) if symbol >> (self.width - 1 - p) & 1 else self._select(p, 0, i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up, one plane unpacked at a time."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(self.width - 1, -1, -1):
            if self.planes is not None:
                plane = self.planes[k]
            else:
                plane = np.concatenate([self._block(k, j) for j in range(len(self.sizes[k]) - 1)] or [np.zeros(0, np.uint8)])
            one, up = np.unpackbits(plane, count=self.n).view(bool), np.empty_like(out)
            up[np.flatnonzero(~one)] = out[: self.zeros[k]]
            up[np.flatnonzero(one)] = out[self.zeros[k] :] | kind(1 << (self.width - 1 - k))
            out = up
        return out

    def to_bytes(self) -> bytes:
        """Header; for each plane the sizes of its parts; then for each plane its ranks and its blocks, each compressed."""
        import zstandard

        c, sizes, parts = zstandard.ZstdCompressor(level=1), [], []
        for plane, r in zip(self.planes, self.ranks):
            own = [c.compress(r.astype("<u4").tobytes()), *(c.compress(plane[a : a + BLOCK].tobytes()) for a in range(0, len(plane), BLOCK))]
            sizes.append(np.array([len(x) for x in own], "<u4").tobytes())
            parts += own
        return struct.pack(HEAD, b"WMX2", self.n, self.width, SPAN, BLOCK) + b"".join(sizes) + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        import zstandard

        magic, n, width, span, block = struct.unpack_from(HEAD, raw)
        if (magic, span, block) != (b"WMX2", SPAN, BLOCK):
            raise ValueError("not a wavelet matrix shard")
        self = cls.__new__(cls)
        self.n, self.width, self.raw, self.planes, self.opened = n, width, raw, None, {}
        parts = 1 + -(-((n + 7) // 8) // BLOCK)
        head = struct.calcsize(HEAD)
        self.sizes = np.frombuffer(raw, "<u4", width * parts, head).astype(np.int64).reshape(width, parts)
        self.at = head + 4 * width * parts + (np.cumsum(self.sizes) - self.sizes.ravel()).reshape(width, parts)
        d = zstandard.ZstdDecompressor()
        self.ranks = [np.frombuffer(d.decompress(raw[a : a + m]), "<u4").astype(np.int64) for a, m in zip(self.at[:, 0], self.sizes[:, 0])]
        self.zeros = [n - int(r[-1]) for r in self.ranks]
        return self


_EDGE = re.compile(rb"(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])")

_KIND = np.zeros(256, np.uint8)  # 1: ASCII letters and digits, 2: signs that _EDGE names
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2


class Encoder:
    """Encodes UTF-8 texts with the tokenizers library, each distinct word once.

    Where the tokenizer's own pattern leaves out white space, no piece spans two words, so a
    text's ids are those of its words (split at ASCII white space) in a row. The library
    encodes the words not met lately, and about CACHED_WORDS are kept. With any other
    tokenizer whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        # kept words, with their ids in a row and the last call that met each
        self.vocabulary, self.held, self.calls = pa.array([], pa.large_string()), np.zeros(0, self.type), 0
        self.size = self.start = self.met = np.zeros(0, np.int64)
        spec = json.loads(self.tokenizer.to_str())
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        drops = first.get("type") == "Split" and (first.get("behavior"), first.get("invert")) == ("Removed", True) and (first["pattern"].get("Regex") or "").endswith(r"|[^\s\p{L}\p{N}]+")
        special = [re.escape(x["content"].encode()) for x in spec.get("added_tokens", [])]
        self.special = re.compile(b"|".join(special)) if special else None
        steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        self.lowers = any(x.get("type") == "Lowercase" for x in steps)
        byte_level = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []][1:] == ["ByteLevel"] and {x.get("type") for x in steps} <= {"NFC", "Replace", "Lowercase", None}
        # a run of ASCII letters is one piece then, which the model takes as it is
        self.letters_whole = byte_level and any(x.get("type") == "BPE" for x in [spec["model"]])
        self.folds = self.lowers and self.letters_whole
        self.by_word = drops and not any(x["lstrip"] or x["rstrip"] or x["content"].split() != [x["content"]] for x in spec.get("added_tokens", []))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of several words: letters by the library's model, others encoded in one text and told apart by where tokens start."""
        if self.letters_whole:
            letters = [w for w in words if w.isalpha()]
            if letters:
                model, kind = self.tokenizer.model.tokenize, {"<u2": "H", "<u4": "I"}[self.type.str]
                found = {w: array(kind, [t.id for t in model(w.decode().lower() if self.lowers else w.decode())]).tobytes() for w in letters}
                rest = [w for w in words if w not in found]
                found.update(zip(rest, self._joined(rest)) if rest else ())
                return [found[w] for w in words]
        return self._joined(words)

    def _joined(self, words: list[bytes]) -> list[bytes]:
        texts_ = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode(" ".join(texts_), add_special_tokens=False)
        ids = np.array(found.ids, self.type).tobytes()
        ends = np.cumsum([len(t) + 1 for t in texts_])
        of = np.searchsorted(ends, np.fromiter((o[0] for o in found.offsets), np.int64, len(found.offsets)), side="right")
        cut = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(words))))).tolist()
        m = self.type.itemsize
        return [ids[a * m : b * m] for a, b in zip(cut, cut[1:])]

    def ids(self, text: str | bytes) -> bytes:
        """The text's ids as little-endian integers of this encoder's type."""
        return self.many([text.encode() if isinstance(text, str) else text])[0]

    def _folded(self, raw: bytes) -> bytes:
        """A text with ASCII letters lower-cased, as the tokenizer does itself; not where that would make special tokens or other compositions with a diacritic."""
        low = raw if not self.folds or b"\xcc" in raw or b"\xcd" in raw else raw.lower()
        return raw if self.special and self.special.search(low) else low

    def many(self, raws: list[bytes]) -> list[bytes]:
        """The ids of several texts: Arrow numbers their words and looks them up, and those not met lately go to the library as one text."""
        if not self.by_word:
            return [self._whole(r.decode("utf-8", "replace")) for r in raws]
        # Arrow splits at the white space of bytes.split and gives empty words at the ends
        lists = pc.ascii_split_whitespace(self._cut([self._folded(r) for r in raws]))
        coded = lists.values.dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        n = self.size[place]
        end = np.concatenate(([0], np.cumsum(n)))
        out, m = self.held[np.repeat(self.start[place] - end[:-1], n) + np.arange(end[-1])].tobytes(), self.type.itemsize
        cuts = (end[lists.offsets.to_numpy()] * m).tolist()
        if len(self.size) > CACHED_WORDS or self.vocabulary.nbytes > CACHED_WORDS * CACHED_LENGTH:
            short = np.flatnonzero(pc.binary_length(self.vocabulary).to_numpy() <= CACHED_LENGTH)
            self._keep(short[np.argsort(-self.met[short], kind="stable")][: CACHED_WORDS // 2])
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def _keep(self, which: np.ndarray) -> None:
        """Only these of the kept words stay."""
        n = self.size[which]
        start = np.cumsum(n) - n
        self.held = self.held[np.repeat(self.start[which] - start, n) + np.arange(int(n.sum()))]
        self.vocabulary, self.size, self.start, self.met = self.vocabulary.take(pa.array(which)), n, start, self.met[which]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among the kept ones, with those not there added."""
        at = pc.index_in(words, value_set=self.vocabulary)
        new = words.filter(at.is_null())
        place, kept = at.fill_null(-1).to_numpy().astype(np.int64), len(self.size)
        place[place < 0] = kept + np.arange(len(new))
        if len(new):
            ids = self._words(new.cast(pa.large_binary()).to_pylist())
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.type.itemsize
            self.start = np.concatenate((self.start, len(self.held) + np.cumsum(n) - n))
            self.size, self.met = np.concatenate((self.size, n)), np.concatenate((self.met, np.zeros(len(n), np.int64)))
            self.held = np.concatenate((self.held, np.frombuffer(b"".join(ids), self.type)))
            self.vocabulary = pa.concat_arrays([self.vocabulary, new])
        self.calls += 1
        self.met[place] = self.calls
        return place

    def _cut(self, raws: list[bytes]) -> pa.Array:
        """Texts with a space where ASCII letters and signs meet, at a bound of the pattern, so that they are made of fewer distinct words; special tokens stay whole."""
        if self.special:
            raws = [b" ".join(w if self.special.search(w) else _EDGE.sub(b" ", w) for w in r.split()) if self.special.search(r) else r for r in raws]
            apart = np.array([self.special.search(r) is not None for r in raws], bool)
        else:
            apart = np.zeros(len(raws), bool)
        data, size = np.frombuffer(b"".join(raws), np.uint8), np.fromiter(map(len, raws), np.int64, len(raws))
        kind = _KIND[data]
        edge = np.zeros(len(data) + 1, bool)  # a space before this byte
        if len(data):
            edge[1:-1] = kind[1:] + kind[:-1] == 3
        offsets = np.concatenate(([0], np.cumsum(size)))
        for i in np.flatnonzero(apart):
            edge[offsets[i] : offsets[i + 1] + 1] = False
        before = np.flatnonzero(edge)
        out = np.insert(data, before, 32)
        offsets += np.searchsorted(before, offsets, side="left")
        return pa.LargeStringArray.from_buffers(len(raws), pa.py_buffer(offsets), pa.py_buffer(out))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _range_of(d: np.ndarray, spread: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Ranges of doc_ids: those of a doc_id that several cuts agree on are dealt by ``spread`` (from 0 to 1)."""
    low, high = (np.searchsorted(cuts, d, side=x) for x in ("left", "right"))
    return np.where(high > low, low + 1 + np.floor(spread * (high - low)).astype(np.int64), high)


def _groups(batch, most_rows: int = 1024, most_bytes: int = 1 << 22):
    """Slices of a batch with their texts as bytes, each of so many rows or bytes, or one text."""
    at = size = 0
    raws: list[bytes] = []
    for i, x in enumerate(batch.column(1)):
        raws.append(x.as_buffer().to_pybytes())
        size += len(raws[-1])
        if len(raws) == most_rows or size >= most_bytes or i + 1 == batch.num_rows:
            yield batch.slice(at, len(raws)), raws
            at, size, raws = i + 1, 0, []


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, cuts: list[float] = ()) -> DataFrame:
    """(range_id, doc_id, h, ids binary): ids of each whole text with the end id, in the encoder's type; h is their hash."""
    cuts = np.array(cuts, float)

    def run(batches):
        import xxhash

        enc = encoder(tokenizer)
        end = np.array([end_id], enc.type).tobytes()
        for batch in batches:
            for part, raws in _groups(batch):
                ids = [x + end for x in enc.many(raws)]
                h = np.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in ids], np.int64)
                r = _range_of(part.column(0).to_numpy().astype(float), h / 2.0**63 * (1 - 2.0**-50), cuts)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), part.column(0), pa.array(h), pa.array(ids, pa.large_binary())], ["range_id", "doc_id", "h", "ids"])
        batch = part = ids = None
        tidy()

    return texts(docs).mapInArrow(run, "range_id int, doc_id long, h long, ids binary")


SHARD_SCHEMA = "range_id int, shard int, start_in_range long, n_tokens long, n_docs int, doc_ids binary, lengths binary, matrix binary"


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shard files to the shared folder, one a shard, and returns them as read from there.

    Shards ascend by (range_id, shard), and so do their documents. Ranges come from
    quantiles of doc_id alone; how many there are follows spark.sql.shuffle.partitions.
    """
    spark, docs = docs.sparkSession, no_null_ids(docs)
    tokenizer = tokenizer or default_tokenizer()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("double").alias("d"))
    cuts = sorted(ids.approxQuantile("d", [i / n for i in range(1, n)], 0.25 / n)) if n > 1 else []
    item = encoder(tokenizer).type.str

    def run(batches):
        now, held, size, shard, start = None, [], 0, 0, 0

        def flush():
            nonlocal held, size, shard, start
            all_ids = np.frombuffer(b"".join(h[1] for h in held), item)
            lengths = np.array([len(h[1]) // all_ids.itemsize for h in held], "<u4")
            row = [now, shard, start, len(all_ids), len(held), np.array([h[0] for h in held], "<i8").tobytes(), lengths.tobytes(), WaveletMatrix.build(all_ids).to_bytes()]
            start, shard, held, size = start + len(all_ids), shard + 1, [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["range_id", "shard", "start_in_range", "n_tokens", "n_docs", "doc_ids", "lengths", "matrix"])

        for batch in batches:
            for r, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and (r != now or size >= shard_tokens):
                    yield flush()
                if r != now:
                    now, shard, start = r, 0, 0
                x = x.as_py()
                held.append((d, x))
                size += len(x) // np.dtype(item).itemsize
        if held:
            yield flush()
        batch = x = None
        tidy()

    dealt = encode(docs, tokenizer, end_id, cuts).repartition(n, "range_id").sortWithinPartitions("range_id", "doc_id", "h", "ids")
    return staged(dealt.select("range_id", "doc_id", "ids").mapInArrow(run, SHARD_SCHEMA), "shards", maxRecordsPerFile=1)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from its shard.

    The ranges' totals, one row a range, are summed on the driver.
    """
    spark = shards.sparkSession
    at, rows = 0, []
    for r in sorted(shards.groupBy("range_id").agg(F.sum("n_tokens").alias("n")).collect()):
        rows.append((r.range_id, at))
        at += r.n
    starts = spark.createDataFrame(rows, "range_id int, range_start long")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["matrix"]).decode().astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                starts_ = row["range_start"] + row["start_in_range"] + ends - lengths
                crc = [zlib.crc32(ids[e - m : e]) for e, m in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["doc_ids"], "<i8")), pa.array(starts_), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        batch = row = ids = None
        tidy()

    return null_ids_back(shards.join(F.broadcast(starts), "range_id").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def document(shards: DataFrame, doc_id: int) -> list[list[int]]:
    """Ids of the documents of this doc_id, each read by access to its positions alone."""

    def run(batches):
        for batch in batches:
            for d, m, w in zip(*(batch.column(i) for i in range(3))):
                lengths = np.frombuffer(m.as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                matrix = WaveletMatrix.from_bytes(w.as_py())
                ids = [[matrix.access(int(i)) for i in range(ends[j] - lengths[j], ends[j])] for j in np.flatnonzero(np.frombuffer(d.as_py(), "<i8") == doc_id)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64()))], ["ids"])

    return [r.ids for r in shards.select("doc_ids", "lengths", "matrix").mapInArrow(run, "ids array<long>").collect()]


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(range_id, shard, n): how often an id occurs in each shard, counted on the bit planes."""

    def run(batches):
        for batch in batches:
            n = [WaveletMatrix.from_bytes(m.as_py()).count(token) for m in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["range_id", "shard", "n"])

    return shards.select("range_id", "shard", "matrix").mapInArrow(run, "range_id int, shard int, n long")


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(table(spark, sf_dir, "documents")))
