"""Published payloads: facts, profiles, directory entries, activity, compositions, comparisons, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest_by
from .metrics import ratio

# The facts of a profile's head, by concept.
HEAD_FACTS = {"total_revenue": "total_revenue", "total_expenses": "total_expenses", "net_assets_eoy": "net_assets", "contributions_grants": "grant_revenue"}
# Most organisations of a comparison, most matches of its picker.
MOST_COMPARED, MOST_PICKED = 4, 6
# Longest texts of a correction.
LONGEST = {"slug": 200, "field": 500, "message": 4000, "email": 320}


def head_facts(facts: DataFrame, org: str, year: str) -> DataFrame:
    """(org, key, year, amount) of the facts a profile shows, from each organisation's newest year."""
    newest = facts.groupBy(org).agg(F.max(year).alias(year))
    names = F.create_map(*(F.lit(x) for kv in HEAD_FACTS.items() for x in kv))
    return facts.join(newest, [org, year]).filter(F.col("concept").isin(*HEAD_FACTS)).select(org, names[F.col("concept")].alias("key"), year, "amount")


def profiles(orgs: DataFrame, head: DataFrame, coverage: DataFrame, people: DataFrame, notices: DataFrame, org: str, team: str | None = None, joined: str | None = None) -> DataFrame:
    """One row an organisation: ``facts`` by key, ``filed`` years, ``people`` by pay.

    ``people`` are held by organisation, or by ``team``, a column of ``orgs`` that many of
    them share: a team is gathered once and put beside its organisations last, where no
    shuffle carries it. With ``joined``, a separator, a team's people are one text, made
    once, and organisations are dealt so that those of a team lie together: a task has few
    of these texts however long they are, and a file that keeps equal values once (as
    Parquet's dictionaries do) grows with the teams' texts, not with organisations times them.

    An organisation without any filing but with a notice has the one fact that it files notices.
    """
    f = head.groupBy(org).agg(F.map_from_entries(F.collect_list(F.struct("key", "amount"))).alias("_facts"))
    c = coverage.groupBy(org).agg(F.sort_array(F.collect_list(F.struct("tax_year", "status"))).alias("coverage"))
    p = people.groupBy(team or org).agg(F.transform(F.sort_array(F.collect_list(F.struct("pay", "name")), asc=False), lambda x: x["name"]).alias("people"))
    p = p.withColumn("people", F.array_join("people", joined)) if joined else p
    n = notices.select(org).distinct().withColumn("_notice", F.lit(True))
    out = orgs.join(f, org, "left").join(c, org, "left").join(n, org, "left")
    if team and joined:
        spark = orgs.sparkSession
        out = out.repartitionByRange(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), team, org)
    # a team's list is broadcast: all of them are no more than the people
    out = out.join(F.broadcast(p), team, "left") if team else out.join(p, org, "left")
    only = F.when(F.col("coverage").isNull() & F.col("_notice"), F.create_map(F.lit("files_notices"), F.lit(1).cast("decimal(38,2)")))
    return out.withColumn("facts", F.coalesce(F.col("_facts").cast("map<string,decimal(38,2)>"), only)).drop("_facts", "_notice")


def directory_entries(profiled: DataFrame, org: str) -> DataFrame:
    """(org, n_filed, latest_year, latest_revenue) from profiles."""
    filed = F.transform(F.filter(F.coalesce("coverage", F.array()), lambda c: c.status == "filed"), lambda c: c.tax_year)
    return profiled.select(org, F.size(filed).alias("n_filed"), F.array_max(filed).alias("latest_year"), F.try_element_at("facts", F.lit("total_revenue")).alias("latest_revenue"))


def peer_cohorts(orgs: DataFrame, org: str, kind: str) -> DataFrame:
    return orgs.select(org, F.concat(F.lit("type:"), F.col(kind)).alias("cohort"), F.initcap(F.regexp_replace(kind, "[-_]", " ")).alias("label"))


def strings_of(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, place, value): every string that stands in the columns, nested ones by their path."""
    cells = F.array(*(F.struct(F.lit(c).alias("place"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(key, F.inline(cells)).filter("value is not null")


def measures_by_entry(rows: DataFrame, keys: list[str], metric: str, value: str) -> DataFrame:
    """One row an entry with its measures as a map by key."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(metric, value)))).alias("measures"))


def composition(rows: DataFrame, keys: list[str], line: str, amount: str, year: str, years: list[int]) -> DataFrame:
    """One row a line, one column a year, with its share of the year's total.

    Lines that are zero in every year go; a year without a total or a line leaves a hole.
    """
    per = rows.groupBy(*keys, line, year).agg(F.sum(amount).alias("_v"))
    total = F.sum("_v").over(Window.partitionBy(*keys, year))
    shares = per.withColumn("_s", F.round(ratio(F.col("_v"), total), 6))
    cells = [F.max(F.when(F.col(year) == y, F.col("_s"))).alias(f"y{y}") for y in years]
    return shares.groupBy(*keys, line).agg(F.max(F.abs("_v")).alias("_most"), *cells).filter("_most > 0").drop("_most")


def series_sentences(points: DataFrame, keys: list[str], year: str, value: str, amended: str) -> DataFrame:
    """What a chart says in words: least, greatest, missing and amended years."""
    years = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(year).cast("string")))), ", ")
    agg = points.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value).isNull()).alias("gaps"), years(F.col(amended)).alias("changed"))
    words = F.when(F.col("lo").isNull(), "No values.").otherwise(F.format_string("From %s to %s.", F.col("lo").cast("string"), F.col("hi").cast("string")))
    words = F.concat(words, F.when(F.col("gaps") > 0, F.format_string(" Missing: %d.", "gaps")).otherwise(""), F.when(F.col("changed") != "", F.concat(F.lit(" Amended: "), F.col("changed"), F.lit("."))).otherwise(""))
    return agg.select(*keys, words.alias("summary"))


def compared(asked: Column, known: DataFrame, requests: DataFrame, request: str, org: str) -> DataFrame:
    """(request, org, pos, state) of each organisation asked for, in the order asked.

    The first MOST_COMPARED that are known are selected, further ones overflow, others are unknown.
    """
    rows = requests.select(request, F.posexplode(asked).alias("_at", org)).join(known.select(org).distinct().withColumn("_known", F.lit(True)), org, "left")
    nth = F.sum(F.coalesce(F.col("_known"), F.lit(False)).cast("int")).over(Window.partitionBy(request).orderBy("_at"))
    state = F.when(F.col("_known").isNull(), "unknown").when(nth <= MOST_COMPARED, "selected").otherwise("overflow")
    return rows.select(request, org, (F.col("_at") + 1).alias("pos"), state.alias("state"))


def compare_rows(selected: DataFrame, cells: DataFrame, request: str, org: str, row: str) -> DataFrame:
    """Rows of a comparison's file: by organisation as asked, then by row; no holes and nothing under review."""
    good = cells.filter("value is not null and quality_state <> 'under_review'")
    joined = selected.filter("state = 'selected'").join(good, org)
    line = F.row_number().over(Window.partitionBy(request).orderBy("pos", row))
    return joined.select(request, line.alias("line"), org, row, "value")


def picker(orgs: DataFrame, selected: DataFrame, term: str, org: str, name: str) -> DataFrame:
    """The first few organisations by name that hold the term and aren't selected yet."""
    found = orgs.filter(F.contains(F.lower(name), F.lit(term.lower()))).join(selected.select(org), org, "left_anti")
    return found.orderBy(F.lower(name), name, org).limit(MOST_PICKED).select(org, name)


def corrections(submitted: DataFrame, published: DataFrame) -> DataFrame:
    """(id, outcome, org) of submissions (id, slug, field, message, email, website).

    A filled trap field is spam; texts that are empty, too long or no address are invalid; a
    slug that the published snapshot doesn't have gives no organisation but is kept.
    """
    size = {c: F.length(F.trim(F.coalesce(c, F.lit("")))) for c in LONGEST}
    address = F.trim(F.coalesce("email", F.lit(""))).rlike(r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$")
    good = (size["message"] > 0) & ((size["email"] == 0) | address)
    for c, most in LONGEST.items():
        good = good & (size[c] <= most)
    outcome = F.when(F.coalesce("website", F.lit("")) != "", "spam").when(~good, "invalid").otherwise("accepted")
    joined = submitted.join(published.select("slug", "org"), "slug", "left")
    return joined.withColumn("outcome", outcome).select("id", "outcome", F.when(F.col("outcome") == "accepted", F.col("org")).alias("org"))


def correction_queue(rows: DataFrame, directory: DataFrame, org: str) -> DataFrame:
    """Corrections with the newest directory name of their organisation, open ones first, then those in progress, newest first."""
    newest = latest_by(directory, [org], [F.desc("created_at"), F.desc("snapshot_id")]).select(org, "name")
    rank = F.when(F.col("status") == "open", 0).when(F.col("status") == "in_progress", 1).otherwise(2)
    return rows.join(newest, org, "left").withColumn("rank", rank)


def partition_replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with every partition that ``new`` has rows of replaced by them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def repointed(history: DataFrame, kept: DataFrame, active: str) -> DataFrame:
    """Slug history after retention: entries of snapshots that went point to the active one."""
    stays = kept.select("snapshot_id").withColumn("_kept", F.lit(True))
    return history.join(stays, "snapshot_id", "left").withColumn("snapshot_id", F.when(F.col("_kept"), F.col("snapshot_id")).otherwise(F.lit(active))).drop("_kept")
