"""From staged filings and tall facts to stored filings, review tasks and eligible ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_by
from .metrics import RATIOS, ratio

# The concepts of a ratio, and those that have to be above zero or resolved.
INPUTS = {"operating_margin": ("total_revenue", "total_expenses")} | RATIOS
POSITIVE = {k: (b,) for k, (_, b) in RATIOS.items()} | {"operating_margin": ("total_revenue",)}
# Largest share of comparisons that may mismatch.
MOST_MISMATCHES = 0.05


def filing_chain(staged: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(filings to insert with ``authoritative``, review tasks) of staged filings (keys, object_id, amended).

    An amended filing comes before one that isn't, then the greater object_id, as text.
    The best staged filing of a key becomes authoritative where it comes before all stored
    ones, whether these are authoritative or not; a stored flag never changes. If it is
    amended and the best stored one is authoritative, both are for now: a task for review,
    with the filing it outranks. Object_ids stored already are not inserted again.
    """
    rank = lambda: F.struct(F.coalesce("amended", F.lit(False)).alias("amended"), F.col("object_id").cast("string").alias("id"))
    best = staged.groupBy(*keys).agg(F.max(rank()).alias("_best"))
    held = stored.groupBy(*keys).agg(F.max(rank()).alias("_held"), F.max_by(F.struct("object_id", "authoritative"), rank()).alias("_old"))
    new = staged.join(stored.select("object_id").distinct(), "object_id", "left_anti").dropDuplicates(["object_id"])
    # nulls in a key meet no stored filing, as they would not in SQL
    both = new.join(best, [new[k].eqNullSafe(best[k]) for k in keys]).drop(*(best[k] for k in keys)).join(held, keys, "left")
    wins = (rank() == F.col("_best")) & (F.col("_held").isNull() | (F.col("_best") > F.col("_held")))
    flagged = both.withColumn("authoritative", wins)
    tasks = flagged.filter(F.col("authoritative") & F.col("amended") & F.col("_old.authoritative"))
    return flagged.drop("_best", "_held", "_old").select(*staged.columns, "authoritative"), tasks.select(*keys, "object_id", F.col("_old.object_id").alias("outranks"))


def newest_facts(facts: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Of each (filing, concept) the row of the highest version."""
    return latest_by(facts, keys, [F.desc(v) for v in version])


def wide_facts(facts: DataFrame, keys: list[str], concepts: tuple[str, ...]) -> DataFrame:
    """One row a key with struct(status, amount) by concept, null where there is none; one pass, no pivot job."""
    one = F.struct("status", "amount")
    return facts.filter(F.col("concept").isin(*concepts)).groupBy(*keys).agg(*(F.max(F.when(F.col("concept") == c, one)).alias(c) for c in concepts))


def eligible_ratios(wide: DataFrame, keys: list[str], resolved: dict[str, tuple[str, ...]]) -> DataFrame:
    """(keys, metric, value): every ratio of every row, null where it is suppressed.

    A ratio needs its inputs, a positive denominator, and the concepts in ``resolved`` to
    have been read rather than taken as zero.
    """

    def value(name: str, a: str, b: str) -> Column:
        x, y = F.col(f"{a}.amount"), F.col(f"{b}.amount")
        ok = [F.col(f"{c}.amount") > 0 for c in POSITIVE[name]] + [F.col(f"{c}.status") == "resolved" for c in resolved.get(name, ())]
        out = ratio(x - y, x) if name == "operating_margin" else ratio(x, y)
        return F.when(reduce(lambda p, q: p & q, ok), F.round(out, 6))

    cells = F.array(*(F.struct(F.lit(n).alias("metric"), value(n, *ab).alias("value")) for n, ab in INPUTS.items()))
    return wide.select(*keys, F.inline(cells))


def suppressed(ratios: DataFrame) -> DataFrame:
    """(metric, n_values, n_suppressed)"""
    return ratios.groupBy("metric").agg(F.count("value").alias("n_values"), F.count_if(F.col("value").isNull()).alias("n_suppressed"))


def anchor_outcomes(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, concept, outcome): each anchor of ours against theirs.

    no_row where the other side has no filing of the key, null where it has no value,
    else match or mismatch; a value of ours that isn't there counts as zero.
    """
    have = theirs.select(*keys).distinct().withColumn("_row", F.lit(True))
    joined = ours.join(have, keys, "left").join(theirs.select(*keys, "concept", F.col("value").alias("_theirs")), [*keys, "concept"], "left")
    same = F.coalesce(F.col("value"), F.lit(0)) == F.col("_theirs")
    outcome = F.when(F.col("_row").isNull(), "no_row").when(F.col("_theirs").isNull(), "null").when(same, "match").otherwise("mismatch")
    return joined.select(*keys, "concept", outcome.alias("outcome"))


def outcome_report(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome, and whether mismatches are over the share that may be."""
    n = {o: F.count_if(F.col("outcome") == o) for o in ("match", "null", "no_row", "mismatch")}
    counts = outcomes.groupBy(*by).agg(F.count("*").alias("comparisons"), *(v.alias(f"n_{k}") for k, v in n.items()))
    return counts.withColumn("failed", F.col("n_mismatch") / F.col("comparisons") > MOST_MISMATCHES)


def display_precedence(filings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each tax year the filing to show: amended, then the later period, then the greater id."""
    return latest_by(filings, keys, [F.desc("amended"), F.desc("period_end"), F.desc("object_id")])
