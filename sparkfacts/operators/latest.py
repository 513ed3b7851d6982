"""Latest-wins and write semantics over immutable, versioned rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written


def latest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in ``order``; the rank filter prunes before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't stored yet, one for each key."""
    return new.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def null_safe_new(new: DataFrame, existing: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``new`` that no stored row equals in all columns, nulls equal to nulls."""
    old = existing.select(*(F.col(c).alias(f"_{c}") for c in columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    return new.join(old, same, "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], stamp: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Newest row by key; a null in a ``keep_if_null`` column falls back to the newest value before."""
    both = old.unionByName(new)
    newest = latest_by(both, keys, [F.desc_nulls_last(stamp)])
    if not keep_if_null:
        return newest
    kept = both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(stamp))).alias(c) for c in keep_if_null))
    return newest.drop(*keep_if_null).join(kept, keys).select(*old.columns)


def revision_bump(incoming: DataFrame, existing: DataFrame, keys: list[str], checksum: str, parser: str | None = None) -> DataFrame:
    """Incoming rows whose payload (or parser) changed, with the next revision number."""
    seen = [checksum] + ([parser] if parser else [])
    last = existing.groupBy(*keys).agg(F.max("revision").alias("_rev"), F.max_by(F.struct(*seen), "revision").alias("_seen"))
    joined = incoming.join(last, keys, "left")
    return joined.filter(F.col("_seen").isNull() | ~F.struct(*seen).eqNullSafe(F.col("_seen"))).withColumn("revision", F.coalesce("_rev", F.lit(0)) + 1).drop("_rev", "_seen")


def newest_version(df: DataFrame, version: str) -> DataFrame:
    """Rows of the highest version, its dotted parts compared as numbers."""
    part = F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    top = df.agg(F.max(part).alias("_top"))
    return df.withColumn("_v", part).join(F.broadcast(top), F.col("_v") == F.col("_top")).drop("_v", "_top")


def reference_diff(before: DataFrame, after: DataFrame, key: str, tracked: list[str]) -> DataFrame:
    """(key, change): create, update or unchanged for each row of ``after``."""
    old = before.select(key, F.struct(*tracked).alias("_old"))
    new = after.select(key, F.struct(*tracked).alias("_new"))
    change = F.when(F.col("_old").isNull(), "create").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    return new.join(old, key, "left").select(key, change.alias("change"))


def guarded_tasks(proposed: DataFrame, open_tasks: DataFrame, identity: list[str]) -> DataFrame:
    """Review tasks whose identity isn't open already."""
    return insert_if_absent(proposed, open_tasks, identity)


_ROW = (1 << 33) - 1  # monotonically_increasing_id: partition above 33 bits, row of the partition in them


def ranked(df: DataFrame, order: list[Column], within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank`` (long, from 1, dense) over all rows in ``order``, or over the rows of each ``within``.

    Rows are dealt to ranges, sorted and numbered there once, and written; a row's rank is
    its number and the rows of the ranges before, counted from the written table, so that
    nothing depends on a second run of the exchange. Rows that ``order`` doesn't tell
    apart are ranked in the order of the input, and may be dealt to several ranges.
    """
    keys = [F.asc_nulls_first(c) for c in within] + list(order) + [F.asc("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = written(dealt.drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range: as many as shuffle partitions
    sizes = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = table.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("rank", F.col("_before") + F.col("_id").bitwiseAND(F.lit(_ROW)) + 1).drop("_part", "_before", "_id")
    if not within:
        return placed
    first = placed.groupBy(*within).agg(F.min("rank").alias("_first")).select(*(F.col(c).alias(f"_within_{i}") for i, c in enumerate(within)), "_first")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_within_{i}")) for i, c in enumerate(within)))
    return placed.join(first, same).withColumn("rank", F.col("rank") - F.col("_first") + 1).drop("_first", *(f"_within_{i}" for i in range(len(within))))


def retention(df: DataFrame, order: list[Column], keep: int = 3) -> DataFrame:
    """Snapshots with rank and whether they stay."""
    return ranked(df, order).withColumn("rank", F.col("rank").cast("int")).withColumn("kept", F.col("rank") <= keep)


def carry_forward(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Fills nulls of ``columns`` with the value before them in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
