"""Merkle dataset manifest: distributed block reduction, a small top tree at the driver, proofs finished on executors.

Rows become leaves by a hash of their fields and are ranked in their group (``lang``) by
doc_id. Runs of 2^BITS consecutive leaves are blocks; one task reduces a block to one
digest and packs its leaves into one row. Block digests go through further rounds of the
same reduction until at most TOP are left, whatever the number of rows or groups. The
driver takes these, builds the top tree and broadcasts each one's suffix path (at most TOP
paths of some 40 steps). Executors put a row's path together from its block and the
suffix, and fold its leaf along it.

Defined cases: a null field counts as "-", so null and empty texts differ; null doc_ids
come first, rows of one doc_id in the order of their leaves, equal rows are leaves of
their own; a null lang is a group of its own, before all others; one row is its own root;
an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import ranked
from .common import staged, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 12
TOP = 1 << 14
#: Steps of a path: no sibling, a sibling to the right, a sibling to the left, the group's root reached. All but the first carry a digest.
ALONE, RIGHT, LEFT, SUBROOT = range(4)


def _hash(*hexes: bytes) -> bytes:
    return sha256(b"".join(hexes)).hexdigest().encode()


def _levels(nodes: list[bytes], most: int | None) -> list[list[bytes]]:
    """The nodes and the levels above them, up to one node, or ``most`` levels if given."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        x = out[-1]
        out.append([_hash(*x[i : i + 2]) for i in range(0, len(x), 2)])
    return out


def _path(levels: list[list[bytes]], i: int) -> list[tuple[int, bytes]]:
    """Steps from node i of the lowest level to the highest level."""
    steps = []
    for level in levels[:-1]:
        j = i ^ 1
        steps.append((LEFT if i & 1 else RIGHT, level[j]) if j < len(level) else (ALONE, b""))
        i >>= 1
    return steps


def _pack(steps: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([kind]) + bytes.fromhex(digest.decode()) for kind, digest in steps)


def _unpack(packed: bytes) -> list[tuple[int, bytes]]:
    steps, at = [], 0
    while at < len(packed):
        wide = 32 if packed[at] != ALONE else 0
        steps.append((packed[at], packed[at + 1 : at + 1 + wide].hex().encode()))
        at += 1 + wide
    return steps


def fold(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root (hex) that a leaf (hex) gives along its path."""
    for kind, digest in steps:
        if kind != SUBROOT:
            leaf = _hash(digest, leaf) if kind == LEFT else _hash(leaf, digest)
    return leaf


def _heights(block: int, n: int, bits: int) -> int | None:
    """Levels of a block: a group's only block ends at one node, others all rise by ``bits``."""
    return None if block == 0 and n < 1 << bits else bits


def _digests(packed: bytes) -> list[bytes]:
    h = packed.hex().encode()
    return [h[i : i + 64] for i in range(0, len(h), 64)]


def leaves(docs: DataFrame, **instead) -> "F.Column":
    """Digest (32 bytes) of a row's fields; ``instead`` gives other Columns for some."""

    def part(c):
        x = instead.get(c, F.col(c)).cast("string")
        return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(part(c) for c in FIELDS)).cast("binary"), 256))


def _blocks(nodes: DataFrame, bits: int, carried: list[str]) -> DataFrame:
    """One row for each (tree, block) of ``nodes`` (tree, pos, digest): its root, its digests in order, and carried columns as lists."""
    kinds = dict(nodes.dtypes)
    dealt = nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "digest", *carried)
    schema = "tree string, block long, n int, root binary, digests binary" + "".join(f", {c} array<{kinds[c]}>" for c in carried)

    def reduce(key, rows):
        rows = rows.sort_by("pos").combine_chunks()
        own, n = rows["digest"].to_pylist(), rows.num_rows
        top = _levels([d.hex().encode() for d in own], _heights(key[1].as_py(), n, bits))[-1][0]
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x.chunk(0) if isinstance(x := rows[c], pa.ChunkedArray) else x) for c in carried]
        one = [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([n], pa.int32()), pa.array([bytes.fromhex(top.decode())], pa.binary()), pa.array([b"".join(own)], pa.binary())]
        return pa.Table.from_arrays([*one, *lists], ["tree", "block", "n", "root", "digests", *carried])

    return dealt.groupBy("tree", "block").applyInArrow(reduce, schema)


@dataclass
class Manifest:
    """``blocks`` of leaves, each with the ``suffix`` of its paths (a column, or broadcast by (tree, block))."""

    blocks: DataFrame
    suffixes: object
    root: str | None
    bits: int

    def walk(self, make, schema: str) -> DataFrame:
        """``make(doc_id, leaf, altered, steps, root)`` for each leaf, as rows of ``schema``; leaf and altered are hex or None."""
        bits, suffixes, root = self.bits, self.suffixes, self.root

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    own = _digests(row["digests"])
                    levels = _levels(own, _heights(row["block"], row["n"], bits))
                    after = _unpack(row["suffix"] if suffixes is None else suffixes.value[row["tree"], row["block"]])
                    rows = [make(i, own[at], other and other.hex().encode(), _path(levels, at) + after, root.encode()) for at, (i, other) in enumerate(zip(row["doc_ids"], row["altered"]))]
                    yield pa.RecordBatch.from_pylist(rows, _arrow(schema))

        return self.blocks.mapInArrow(run, schema)

    def proofs(self) -> DataFrame:
        """(doc_id, leaf, proof): proof holds the packed steps, for ``fold``."""
        return self.walk(lambda i, leaf, altered, steps, root: {"doc_id": i, "leaf": leaf.decode(), "proof": _pack(steps)}, "doc_id long, leaf string, proof binary")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _top(rows: list, lifted: bool) -> tuple[dict[tuple[str, int], bytes], str]:
    """Suffix paths of block roots by (tree, block), and the root of all; ``lifted``: the nodes are group roots already."""
    trees: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.tree.encode(), r.block)):
        trees.setdefault(r.tree, []).append(bytes(r.root).hex().encode())
    if lifted:
        levels = _levels(trees[""], None)
        return {("", i): _pack(_path(levels, i)) for i in range(len(trees[""]))}, levels[-1][0].decode()
    inner = {t: _levels(nodes, None) for t, nodes in trees.items()}
    outer = _levels([x[-1][0] for x in inner.values()], None)
    return {(t, i): _pack([*_path(x, i), (SUBROOT, x[-1][0]), *_path(outer, k)]) for k, (t, x) in enumerate(inner.items()) for i in range(len(x[0]))}, outer[-1][0].decode()


def _down(blocks: DataFrame, bits: int, lifted: bool, suffixes) -> DataFrame:
    """(tree, block, suffix) of the nodes that a round's blocks were made of."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = _digests(row["digests"])
                levels = _levels(own, _heights(row["block"], row["n"], bits))
                after = _unpack(row["suffix"] if suffixes is None else suffixes.value[row["tree"], row["block"]])
                paths = [_pack([*([(SUBROOT, own[i])] if lifted else []), *_path(levels, i), *after]) for i in range(len(own))]
                yield pa.RecordBatch.from_arrays([pa.array(row["trees"], pa.string()), pa.array(row["places"], pa.int64()), pa.array(paths, pa.binary())], ["tree", "block", "suffix"])

    return blocks.mapInArrow(run, "tree string, block long, suffix binary")


def build(docs: DataFrame, altered=None, bits: int = BITS, top: int = TOP) -> Manifest:
    """The manifest of all rows. ``altered``: a Column with another digest of some rows, carried along to be folded."""
    spark = docs.sparkSession
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_ids"), leaves(docs).alias("digest"), (F.lit(None).cast("binary") if altered is None else altered).alias("altered"))
    nodes = ranked(rows, [F.asc_nulls_first("doc_ids"), F.asc("digest"), F.asc_nulls_first("altered")], ("tree",)).withColumn("pos", F.col("rank") - 1)
    rounds = [(staged(_blocks(nodes, bits, ["doc_ids", "altered"]), "merkle_blocks"), False)]
    lifted = False
    while True:
        last = rounds[-1][0]
        seen = last.agg(F.count("*").alias("n"), F.max("block").alias("most")).first()
        if seen.n <= top:
            break
        nodes = last.select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"), F.col("tree").alias("trees"), F.col("block").alias("places"))
        lift = not lifted and seen.most == 0
        if lift:  # more groups than TOP, each down to one node: their roots are one tree
            nodes = ranked(nodes.drop("pos"), [F.asc("tree")]).withColumn("pos", F.col("rank") - 1).withColumn("tree", F.lit(""))
        lifted |= lift
        rounds.append((staged(_blocks(nodes, bits, ["trees", "places"]), "merkle_blocks"), lift))
    found = rounds[-1][0].select("tree", "block", "root").collect()  # at most TOP rows
    paths, root = _top(found, lifted) if found else ({}, None)
    suffixes = spark.sparkContext.broadcast(paths)
    for k in range(len(rounds) - 1, 0, -1):
        below = _down(rounds[k][0], bits, rounds[k][1], suffixes)
        rounds[k - 1] = (rounds[k - 1][0].join(staged(below, "merkle_paths"), ["tree", "block"]), rounds[k - 1][1])
        suffixes = None
    return Manifest(rounds[0][0], suffixes, root, bits)


def _judged(doc_id, leaf, altered, steps, root):
    folded = fold(altered or leaf, steps)
    return {
        "doc_id": doc_id, "leaf": leaf.decode(), "subroot": next(d for kind, d in steps if kind == SUBROOT).decode(), "root": root.decode(),
        "proof_sha256": sha256(b"".join(d for kind, d in steps if kind in (LEFT, RIGHT))).hexdigest(), "folded_root": folded.decode(), "verified": folded == root,
    }


def audit(docs: DataFrame, bits: int = BITS, top: int = TOP) -> DataFrame:
    """Each row's leaf, proof and fold; rows of which 7 divides the crc32 of doc_id are folded with one more in n_chars."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaves(docs, n_chars=F.col("n_chars") + 1))
    made = build(docs, tampered, bits, top)
    return made.walk(_judged, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384::BIGINT) ELSE {0} >> 1 END"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), generate_series(1, 8)), lambda v, _: {_STEP.format('v')})), 4294967295::BIGINT)"


def _field(x: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


_LEAF = " || ".join(_field(x) for x in FIELDS)
ORACLE = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN sha256({_LEAF.replace('n_chars', '(n_chars + 1)')}) END AS altered
  FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l
), up AS (
  SELECT 0 AS lvl, lang, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT lvl + 1, lang, pos // 2, (n + 1) // 2, sha256(h || coalesce(nx, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY pos) AS nx FROM up WHERE n > 1) WHERE pos % 2 = 0
), subs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(nx, '')) FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS nx FROM tops WHERE n > 1) WHERE pos % 2 = 0
), inner_fold AS (
  SELECT p.lang, p.pos AS id, 0 AS lvl, p.pos, p.n, coalesce(altered, leaf) AS h, '' AS proof FROM p
  UNION ALL
  SELECT f.lang, f.id, f.lvl + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM inner_fold f LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1
), outer_fold AS (
  SELECT f.lang, f.id, 0 AS lvl, s.pos, s.n, f.h, f.proof FROM inner_fold f JOIN subs s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL
  SELECT f.lang, f.id, f.lvl + 1, f.pos // 2, (f.n + 1) // 2, sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM outer_fold f LEFT JOIN tops s ON s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1
)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM p JOIN outer_fold f ON f.lang IS NOT DISTINCT FROM p.lang AND f.id = p.pos AND f.n = 1 JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
"""
