"""Filings to facts to eligible metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest_by

# Metric, its numerator and denominator concepts.
RATIOS = {
    "contribution_dependency": ("contributions_grants", "total_revenue"),
    "program_service_share": ("program_service_expense", "total_revenue"),
    "compensation_intensity": ("salaries_benefits_total", "total_expenses"),
    "membership_dues_share": ("membership_dues", "total_revenue"),
}


def winning_filings(filings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the amended filing, then the one with the greatest object id."""
    return latest_by(filings, keys, [F.desc("amended"), F.desc("object_id")])


def late_amendments(winners: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Winning amended filings of keys that already have an authoritative filing: for review."""
    return winners.filter("amended").join(stored.filter("authoritative").select(*keys), keys, "left_semi")


def fact_rows(resolved: DataFrame) -> DataFrame:
    """Facts of (filing, concept, status, value): absent counts as zero, not_on_form gives none."""
    amount = F.when(F.col("status") == "absent", F.lit(0)).otherwise(F.col("value"))
    return resolved.filter("status <> 'not_on_form'").withColumn("amount", amount)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless both are known and the denominator is positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def wide_metrics(wide: DataFrame) -> DataFrame:
    """The five ratios of rows with one column per concept, at six decimals."""
    margin = ratio(F.col("total_revenue") - F.col("total_expenses"), F.col("total_revenue"))
    return wide.withColumns({"operating_margin": F.round(margin, 6)} | {k: F.round(ratio(F.col(a), F.col(b)), 6) for k, (a, b) in RATIOS.items()})


def cagr(series: DataFrame, keys: list[str], year: str, amount: str, least: int = 3) -> DataFrame:
    """Compound growth from the first to the last year, of keys with ``least`` years or more."""
    ends = series.groupBy(*keys).agg(
        F.count("*").alias("n_years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.min_by(amount, year).cast("double").alias("_a"), F.max_by(amount, year).cast("double").alias("_b"))
    ok = (F.col("n_years") >= least) & (F.col("last_year") > F.col("first_year")) & (F.col("_a") > 0) & (F.col("_b") > 0)
    growth = F.pow(F.col("_b") / F.col("_a"), 1.0 / (F.col("last_year") - F.col("first_year"))) - 1
    return ends.filter(ok).select(*keys, "n_years", "first_year", "last_year", F.round(growth, 6).alias("cagr"))


def identity_findings(df: DataFrame, whole: Column, parts: Column, tolerance: float = 1) -> DataFrame:
    """Rows whose whole differs from its parts by more than the tolerance; unknown parts give none."""
    return df.withColumn("gap", whole - parts).filter(F.abs("gap") > tolerance)


def cross_check(ours: Column, theirs: Column) -> Column:
    """match, null or mismatch of one anchor; ``derive.anchor_outcomes`` tells rows that aren't there apart."""
    return F.when(theirs.isNull(), "null").when(ours == theirs, "match").otherwise("mismatch")


def coverage_years(observed: DataFrame, keys: list[str], year: str) -> DataFrame:
    """One row for each year between a key's first and last, marked filed or missing."""
    span = observed.groupBy(*keys).agg(F.min(year).alias("_a"), F.max(year).alias("_b"))
    years = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(year))
    seen = observed.select(*keys, year).distinct().withColumn("status", F.lit("filed"))
    return years.join(seen, [*keys, year], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def mode_smallest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value by key, the smallest of equals."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return latest_by(counts, keys, [F.desc("n"), F.asc(value)])


def share_of_total(df: DataFrame, keys: list[str], line: str, amount: str) -> DataFrame:
    """Lines with their share of the key's total; keys without a positive total have null shares."""
    lines = df.groupBy(*keys, line).agg(F.sum(amount).alias("amount"))
    total = F.sum("amount").over(Window.partitionBy(*keys))
    return lines.withColumn("share", F.round(ratio(F.col("amount"), total), 6))


def common_years(series: DataFrame, org: str, year: str) -> DataFrame:
    """Years that every organisation has; without any, the newest year of any."""
    per = series.groupBy(year).agg(F.countDistinct(org).alias("n"))
    all_ = series.agg(F.countDistinct(org).alias("orgs"), F.max(year).alias("newest"))
    both = per.join(F.broadcast(all_))
    shared = both.filter("n = orgs").select(F.col(year))
    none = all_.join(shared.agg(F.count("*").alias("shared"))).filter("shared = 0").select(F.col("newest").alias(year))
    return shared.unionByName(none)


def propagate_quality(facts: DataFrame, findings: DataFrame, key: str, state: str = "quality_state") -> DataFrame:
    """Facts of a filing with findings go under review."""
    bad = findings.select(key).distinct().withColumn("_bad", F.lit(True))
    return facts.join(bad, key, "left").withColumn(state, F.when(F.col("_bad"), "under_review").otherwise(F.col(state))).drop("_bad")


def metric_quality(inputs: DataFrame, key: str, state: str = "quality_state") -> DataFrame:
    """A metric is under review if any of its inputs is."""
    return inputs.groupBy(key).agg(F.when(F.bool_or(F.col(state) == "under_review"), "under_review").otherwise("derived").alias(state))
