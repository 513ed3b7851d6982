"""Run log, quarantine and gates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


class Run:
    """Counts what passes through a job without a pass of its own.

    ``counted`` attaches counters to a DataFrame; they are filled in by the action that
    writes it. ``row`` gives the run's log row.
    """

    def __init__(self, job: str, source: str):
        self.job, self.source, self.started, self.seen = job, source, datetime.now(timezone.utc).replace(tzinfo=None), {}

    def counted(self, df: DataFrame, **counters: Column) -> DataFrame:
        o = Observation()
        self.seen |= dict.fromkeys(counters, o)
        return df.observe(o, *(F.count_if(c).alias(k) for k, c in counters.items()))

    def row(self, spark, status: str) -> DataFrame:
        stats = {k: int(o.get[k]) for k, o in self.seen.items()}
        return spark.createDataFrame([(self.job, self.source, self.started, status, stats)], "job string, source string, started timestamp_ntz, status string, stats map<string,bigint>")


def ingest(run: Run, incoming: DataFrame, stored: DataFrame, keys: list[str], checksum: str, dropped: Column, bad: Column, reason: Column, path: str) -> DataFrame:
    """Writes what is new of ``incoming`` and what is to be quarantined, and counts every row in that one pass.

    Rows are dropped (not wanted), quarantined (bad), repeated (another row of their key
    comes first), unchanged (stored with this checksum), or inserted; a stored key with
    another checksum is a conflict and is quarantined. ``run`` gets a counter of each, and
    ``path`` a partition ``state`` of inserted and of quarantined rows, with the reason.
    Returns the written rows.
    """
    first = Window.partitionBy(*keys, F.coalesce(dropped, F.lit(False)), F.coalesce(bad, F.lit(True))).orderBy(F.asc_nulls_last(checksum))
    have = stored.select(*keys, F.col(checksum).alias("_have")).dropDuplicates(keys)
    marked = incoming.withColumn("_nth", F.row_number().over(first)).join(have, keys, "left")
    state = (
        F.when(F.coalesce(dropped, F.lit(False)), "dropped")
        .when(F.coalesce(bad, F.lit(True)), "quarantined")
        .when(F.col("_nth") > 1, "repeated")
        .when(F.col("_have") == F.col(checksum), "unchanged")
        .when(F.col("_have").isNotNull(), "conflict")
        .otherwise("inserted")
    )
    why = F.when(F.col("_state") == "conflict", "conflict").when(F.col("_state") == "quarantined", F.coalesce(reason, F.lit("bad")))
    marked = marked.withColumn("_state", state).withColumn("reason", why).drop("_nth", "_have")
    counted = run.counted(marked, **{s: F.col("_state") == s for s in ("inserted", "unchanged", "repeated", "dropped", "quarantined", "conflict")})
    kept = counted.filter(F.col("_state").isin("inserted", "quarantined", "conflict")).withColumn("state", F.when(F.col("_state") == "inserted", "inserted").otherwise("quarantined")).drop("_state")
    kept.write.partitionBy("state").parquet(path)
    return incoming.sparkSession.read.schema(kept.schema).parquet(path)


def quarantine(df: DataFrame, bad: Column, reason: Column, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the others as (reason, payload JSON)."""
    wrong = F.coalesce(bad, F.lit(True))
    return df.filter(~wrong), df.filter(wrong).select(reason.alias("reason"), F.to_json(F.struct(*payload)).alias("payload"))


def gate(quarantined: DataFrame, since: Column, resolved_count: bool = True) -> int:
    """Quarantined rows since a time; with ``resolved_count`` false only open ones stop a publication."""
    rows = quarantined.filter(F.col("at") >= since)
    n = (rows if resolved_count else rows.filter("not resolved")).count()
    if n:
        raise ValueError(f"{n} quarantined rows")
    return n


def shrink_alarm(now: DataFrame, before: DataFrame, key: str, share: float = 0.95) -> DataFrame:
    """(key, n_before, n_now, alarm): groups that lost more than a twentieth of their rows."""
    a, b = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((before, "n_before"), (now, "n_now")))
    both = a.join(b, key, "left").withColumn("n_now", F.coalesce("n_now", F.lit(0)))
    return both.withColumn("alarm", F.col("n_now") < share * F.col("n_before"))


def markdown(df: DataFrame) -> str:
    """A report table of a few rows."""
    rows = [list(map(str, r)) for r in df.limit(1000).collect()]  # reports are short
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])
