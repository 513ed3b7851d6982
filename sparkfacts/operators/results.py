"""Race results: entries, finish points, completeness of loads, people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import crew_role
from .latest import latest_by


def one_entry_each(entries: DataFrame, keys: list[str], time: Column, position: str) -> DataFrame:
    """Of entries that repeat, the first with a time, else the first; with the number dropped."""
    kept = latest_by(entries, keys, [time.isNull().asc(), F.asc(position)])
    dropped = entries.groupBy(*keys).agg((F.count("*") - 1).alias("n_dropped"))
    return kept.join(dropped, keys)


def finish_point(points: Column) -> Column:
    """Of split points (name, distance, value): the last called a finish, else the farthest, else the last."""
    named = F.filter(points, lambda p: F.contains(F.lower(p["name"]), F.lit("finish")))
    far = F.array_max(F.transform(F.filter(points, lambda p: p["distance"].isNotNull()), lambda p: F.struct(p["distance"], p["value"])))
    return F.coalesce(F.try_element_at(named, F.lit(-1))["value"], far["value"], F.try_element_at(points, F.lit(-1))["value"])


def date_span(days: Column) -> Column:
    """struct(first, last) of the dates in an array of timestamps written as text."""
    dates = F.transform(days, lambda x: F.try_to_date(F.substring(x, 1, 10)))
    return F.struct(F.array_min(dates).alias("first"), F.array_max(dates).alias("last"))


def elapsed(starts: list[Column], finishes: list[Column], text: Column) -> Column:
    """The first positive finish minus start, else the parsed text time."""
    return F.coalesce(*(F.when(f - s > 0, f - s) for s, f in zip(starts, finishes)), text)


def adjusted(raw: Column, handicap: Column) -> Column:
    """Raw time with handicap; without one the raw time itself."""
    return raw + F.coalesce(handicap, F.lit(0))


def metric_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Up to six measures of an entry as rows with units; times in seconds, nulls left out."""
    number = "decimal(18,3)"
    parts = ", ".join(f"'{name}', cast({value} as {number}), '{unit}'" for name, value, unit in (
        ("finish_time", "time_ms / 1000", "seconds"), ("adjusted_time", "adjusted_time_ms / 1000", "seconds"), ("margin", "margin_ms / 1000", "seconds"),
        ("penalty", "penalty_ms / 1000", "seconds"), ("place", "position", "rank"), ("adjusted_place", "adjusted_position", "rank")))
    return rows.select(*keys, F.expr(f"stack(6, {parts}) AS (metric_key, value, unit)")).filter("value is not null")


def to_fetch(races: DataFrame, payloads: DataFrame, key: str, start: str, today: Column, days: int = 14) -> DataFrame:
    """Races without a payload, or that started within the last days."""
    have = payloads.select(key).distinct().withColumn("_have", F.lit(True))
    return races.join(have, key, "left").filter(F.col("_have").isNull() | (F.col(start) >= F.date_sub(today, days))).drop("_have")


def complete(scheduled: DataFrame, staged: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Groups of which every scheduled key is staged, and the keys missing from the others."""
    missing = scheduled.join(staged.select(group, key), [group, key], "left_anti")
    return scheduled.select(group).distinct().join(missing.select(group).distinct(), group, "left_anti"), missing


def until_misses(probed: DataFrame, key: str, id_: str, hit: str, misses: int = 3) -> DataFrame:
    """Rows probed before (and with) the first run of so many misses in a row."""
    w = Window.partitionBy(key).orderBy(id_)
    run = F.sum((~F.col(hit)).cast("int")).over(w.rowsBetween(1 - misses, 0))
    stopped = F.max((run == misses).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return probed.withColumn("_stop", F.coalesce(stopped, F.lit(0))).filter("_stop = 0").drop("_stop")


def crews(people: DataFrame, keys: list[str], name: str, role: str, seat: str) -> DataFrame:
    """Crew of each entry in seat order as (role, name)."""
    pair = F.struct(F.col(seat).alias("seat"), crew_role(F.col(role)).alias("role"), F.col(name).alias("name"))
    return people.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: F.struct(p["role"], p["name"])).alias("crew"))


def latest_captures(people: DataFrame, keys: list[str], stamp: list[str]) -> DataFrame:
    """Newest capture of each person and title, nulls equal to nulls."""
    return latest_by(people, keys, [F.desc(c) for c in stamp])


def people_year(people: DataFrame, keys: list[str], parts: list[str], shown: Column | None = None) -> DataFrame:
    """Of a filing's people: total pay, how many are paid and how many volunteer; with ``shown`` the list of the paid."""
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    paid = [] if shown is None else [F.array_sort(F.collect_list(F.when(F.col("_t") > 0, shown))).alias("paid")]
    return people.withColumn("_t", total).groupBy(*keys).agg(F.sum("_t").alias("total"), F.count_if(F.col("_t") > 0).alias("n_paid"), F.count_if(F.col("_t") <= 0).alias("n_volunteers"), *paid)


def overlay(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` with every value that ``over`` has for their key in place of their own."""
    o = over.select(*keys, *(F.col(c).alias(f"_{c}") for c in over.columns if c not in keys))
    mine = [F.coalesce(f"_{c}", c).alias(c) if c in over.columns and c not in keys else F.col(c) for c in base.columns]
    return base.join(o, keys, "left").select(*mine)


def by_kind(payloads: DataFrame, key: str, kind: str, value: str, kinds: dict[str, str]) -> DataFrame:
    """One row a key that has every kind, one column a kind; one pass in place of a self join."""
    held = payloads.filter(F.col(kind).isin(*kinds.values())).groupBy(key).agg(*(F.max(F.when(F.col(kind) == k, F.col(value))).alias(c) for c, k in kinds.items()))
    return held.dropna(subset=list(kinds))


def coverage_percent(rows: DataFrame, by: list[str], covered: Column) -> DataFrame:
    """Rows of each group, and the percentage that is covered, at two decimals."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(covered) / F.count("*"), 2).alias("percent"))


def coverage_state(forms: DataFrame, key: str, form: str) -> DataFrame:
    """990 before 990ez before 990n_only, none without any."""
    rank = F.when(F.col(form) == "990", 3).when(F.col(form) == "990EZ", 2).when(F.col(form) == "990N", 1).otherwise(0)
    return forms.groupBy(key).agg(F.element_at(F.array(*map(F.lit, ("none", "990n_only", "990ez", "990"))), F.max(rank) + 1).alias("coverage"))


def resolve_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Statuses of concepts by group, and the share resolved of those that apply."""
    n = {s: F.count_if(F.col("status") == s) for s in ("resolved", "absent", "not_on_form")}
    return rows.groupBy(*by).agg(*(v.alias(k) for k, v in n.items())).withColumn("rate", F.round(F.try_divide("resolved", F.col("resolved") + F.col("absent")), 4))
