"""Read models: directory, trends, comparison, nested activity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_normalize


def directory_search(entries: DataFrame, term: str, fields: list[Column], facets: dict[str, list[str]]) -> DataFrame:
    """Entries whose any field holds the term, and that have one of the values of every facet asked for."""
    import re

    wanted = re.sub("[^a-z0-9]+", "", term.lower())
    hit = reduce(lambda a, b: a | b, (F.contains(search_normalize(f), F.lit(wanted)) for f in fields))
    kinds = dict(entries.dtypes)
    for column, values in facets.items():
        if values:
            own = F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))) if kinds[column].startswith("array") else F.col(column).isin(*values)
            hit = hit & own
    return entries.filter(hit)


def facets(entries: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(facet, value, n) in one pass: each entry gives one row a facet."""
    pairs = F.array(*(F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in columns.items()))
    return entries.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))


def sort_directory(entries: DataFrame, by: str) -> DataFrame:
    """By name, by state, or by revenue from the highest; unknown values last. Names in binary order of lower case."""
    name = [F.lower("name").asc_nulls_last(), F.asc("name")]
    return entries.orderBy(*{"name": name, "state": [F.asc_nulls_last("state"), *name], "revenue": [F.desc_nulls_last("revenue"), *name]}[by])


def gap_report(registry: DataFrame, loaded: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Covered and uncovered registry rows by group."""
    have = loaded.select(key).distinct().withColumn("_have", F.lit(True))
    return registry.join(have, key, "left").groupBy(*by).agg(F.count_if(F.col("_have").isNotNull()).alias("covered"), F.count_if(F.col("_have").isNull()).alias("uncovered"))


def trend_points(values: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """Values by year with the years between first and last that have none."""
    span = values.groupBy(*keys).agg(F.min(year).alias("_a"), F.max(year).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias(year))
    return span.join(values.select(*keys, year, value), [*keys, year], "left").withColumn("missing", F.col(value).isNull())


def compare_matrix(orgs: DataFrame, rows: list[str], series: DataFrame, most: int = 4) -> DataFrame:
    """Fixed rows by organisation; values under review and values not there are null.

    ``orgs`` is a request's few organisations, so rows are exploded per organisation.
    """
    wanted = F.posexplode(F.array(*map(F.lit, rows))).alias("_p", "row_key")
    out = orgs.select("org", wanted).withColumn("pos", F.col("_p") + 1)
    state = F.col("quality_state") == "under_review" if "quality_state" in series.columns else F.lit(False)
    cells = series.select("org", "row_key", F.when(state, None).otherwise(F.col("value")).alias("value"))
    return out.join(cells, ["org", "row_key"], "left").select("org", "pos", "row_key", "value")


def series_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least, greatest and missing years of each series."""
    return points.groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count_if("missing").alias("n_missing"))


def resolve_slugs(wanted: DataFrame, current: DataFrame, history: DataFrame) -> DataFrame:
    """kind (current, redirect, not_found) and target slug of each wanted slug."""
    now = current.select(F.col("slug").alias("_now"), F.col("id").alias("_id"))
    past = history.join(current.select("id", F.col("slug").alias("_new")), "id", "left").select(F.col("slug").alias("_old"), "_new")
    out = wanted.join(now, F.col("slug") == F.col("_now"), "left").join(past, F.col("slug") == F.col("_old"), "left")
    kind = F.when(F.col("_now").isNotNull(), "current").when(F.col("_old").isNotNull(), "redirect").otherwise("not_found")
    return out.withColumn("kind", kind).withColumn("target", F.coalesce("_now", "_new"))


def nest_activity(rows: DataFrame, org: str, season: str, date: str, regatta: str, entry: str) -> DataFrame:
    """One row an organisation: seasons from the newest, regattas from the newest, entries in order."""
    entries = rows.groupBy(org, season, date, regatta).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    by_date = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col(regatta).alias("regatta"), "entries")), lambda a, b: F.when(a.d > b.d, -1).when(a.d < b.d, 1).when(a.regatta < b.regatta, -1).when(a.regatta > b.regatta, 1).otherwise(0))
    seasons = entries.groupBy(org, season).agg(by_date.alias("regattas"))
    return seasons.groupBy(org).agg(F.sort_array(F.collect_list(F.struct(F.col(season).alias("season"), "regattas")), asc=False).alias("seasons"))


def flatten_activity(nested: DataFrame, org: str) -> DataFrame:
    """The nested form as rows with positions."""
    s = nested.select(org, F.posexplode("seasons").alias("sp", "s")).select(org, "sp", "s.season", F.posexplode("s.regattas").alias("rp", "r"))
    e = s.select(org, "season", F.col("r.regatta").alias("o_orderkey"), "sp", "rp", F.posexplode("r.entries").alias("ep", "l_linenumber"))
    return e.select(org, "season", "o_orderkey", "l_linenumber", *((F.col(a) + 1).alias(b) for a, b in (("sp", "season_pos"), ("rp", "regatta_pos"), ("ep", "entry_pos"))))


def export_csv(df: DataFrame, path: str, order: list[Column]) -> None:
    """One RFC 4180 file with CRLF line ends: a comparison's few rows."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)
