"""The nine read tables of a release, assembled from organisations, filings, facts and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import profiles

# The read tables of a release.
TABLES = ("org_directory", "org_financial_series", "org_filing_coverage", "org_profile", "org_peer_cohort", "metric_catalog", "source_registry_public", "org_regatta_result", "org_slug_history")


def display_filings(filings: DataFrame) -> DataFrame:
    """Of each (org, tax_year) the filing that is shown: amended ones first, then the later period, then the greater id as text."""
    order = F.struct(F.coalesce("amended", F.lit(False)).alias("a"), F.col("period_end").alias("b"), F.col("filing_id").cast("string").alias("c"))
    return filings.groupBy("org", "tax_year").agg(F.max_by(F.struct("filing_id", "form", "period_end", "amended"), order).alias("f")).select("org", "tax_year", "f.*")


def coverage_rows(filings: DataFrame, notices: DataFrame) -> DataFrame:
    """(org, tax_year, fy_end, status) of every year from an organisation's first to its last.

    A filing stands before a notice (990n, its year's end where it has no period); years
    with neither are missing.
    """
    shown = display_filings(filings).select("org", "tax_year", "period_end", F.when(F.col("amended"), "amended").when(F.col("form") == "990", "990").otherwise("990ez").alias("status"))
    noted = notices.groupBy("org", "tax_year").agg(F.max_by("period_end", F.col("observation_id").cast("string")).alias("_end")).select("org", "tax_year", F.coalesce("_end", F.make_date("tax_year", F.lit(12), F.lit(31))).alias("_end"))
    years = filings.select("org", "tax_year").unionByName(notices.select("org", "tax_year"))
    span = years.groupBy("org").agg(F.explode(F.sequence(F.min("tax_year"), F.max("tax_year"))).alias("tax_year"))
    both = span.join(shown, ["org", "tax_year"], "left").join(noted, ["org", "tax_year"], "left")
    status = F.when(F.col("status").isNotNull(), F.col("status")).when(F.col("_end").isNotNull(), "990n").otherwise("missing")
    return both.select("org", "tax_year", F.coalesce("period_end", "_end").alias("fy_end"), status.alias("status"))


def directories(orgs: DataFrame, filings: DataFrame, notices: DataFrame, aliases: DataFrame) -> DataFrame:
    """(org, slug, display_name, coverage_state, aliases, search_document, fye_month); the month is the commonest, the earlier of equals."""
    forms = filings.groupBy("org").agg(F.max(F.col("form") == "990").alias("_full"), F.max(F.col("form") == "990EZ").alias("_short"))
    months = filings.groupBy("org", F.month("period_end").alias("m")).agg(F.count("*").alias("n")).groupBy("org").agg(F.max_by("m", F.struct("n", -F.col("m"))).alias("fye_month"))
    noted = notices.select("org").distinct().withColumn("_noted", F.lit(True))
    named = profiles_aliases(aliases)
    both = orgs.join(forms, "org", "left").join(months, "org", "left").join(noted, "org", "left").join(named, "org", "left")
    state = F.when(F.col("_full"), "990").when(F.col("_short"), "990ez").when(F.col("_noted"), "990n_only").otherwise("none")
    other = F.coalesce("aliases", F.array().cast("array<string>"))
    return both.select("org", "slug", "display_name", state.alias("coverage_state"), other.alias("aliases"), F.concat_ws(" ", "display_name", "slug", F.array_join(other, " ")).alias("search_document"), "fye_month").withColumn("search_document", F.trim("search_document"))


def profiles_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("org").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def period_label(tax_year: Column, begin: Column, end: Column) -> Column:
    """FY2021 (Jul 2020–Jun 2021); without a beginning the period is a year."""
    start = F.coalesce(begin, F.date_add(F.add_months(end, -12), 1))
    return F.concat(F.lit("FY"), tax_year.cast("string"), F.lit(" ("), F.date_format(start, "MMM yyyy"), F.lit("–"), F.date_format(end, "MMM yyyy"), F.lit(")"))


def source_ref(row: dict[str, Column], parser_version: str, metric: Column) -> Column:
    """Where a value comes from: value, unit, period, quality, source, retrieval, parser, metric."""
    source = F.struct(*(row[c].alias(c) for c in ("source_key", "form_type", "filing_id", "source_path", "raw_url", "is_amended")))
    period = F.struct(row["tax_year"].alias("tax_year"), row["end"].alias("fy_end"), period_label(row["tax_year"], row["begin"], row["end"]).alias("label"))
    return F.struct(row["value"].alias("value"), row["unit"].alias("unit"), period.alias("period"), row["quality_state"].alias("quality_state"), source.alias("source"), row["retrieved_at"].alias("retrieved_at"), F.lit(parser_version).alias("parser_version"), metric.alias("metric"))


_SERIES = ["org", "series_key", "series_version", "tax_year", "fiscal_year_end", "value", "quality_state", "is_amended", "source_ref"]


def fact_series(facts: DataFrame, doubtful: DataFrame, parser_version: str) -> DataFrame:
    """Series rows of facts; those of ``doubtful`` filings (filing_id) are under review."""
    marked = facts.join(doubtful.select("filing_id").distinct().withColumn("_doubt", F.lit(True)), "filing_id", "left")
    state = F.when(F.col("_doubt"), "under_review").otherwise(F.col("quality_state"))
    c = {x: F.col(x) for x in ("unit", "tax_year", "source_path", "raw_url", "retrieved_at")}
    row = c | {"value": F.col("amount"), "begin": F.col("period_begin"), "end": F.col("period_end"), "quality_state": state, "source_key": F.lit("irs_990_xml"), "form_type": F.col("form"), "filing_id": F.col("filing_id").cast("string"), "is_amended": F.col("amended")}
    ref = source_ref(row, parser_version, F.lit(None).cast("struct<key:string,version:int>"))
    return marked.select("org", F.col("concept").alias("series_key"), F.col("version").alias("series_version"), "tax_year", F.col("period_end").alias("fiscal_year_end"), F.col("amount").alias("value"), state.alias("quality_state"), F.col("amended").alias("is_amended"), ref.alias("source_ref")).select(*_SERIES)


def metric_series(metrics: DataFrame, doubtful: DataFrame, parser_version: str) -> tuple[DataFrame, DataFrame]:
    """(series rows of metrics, errors): a metric without a filing or path is an error.

    One with an input of a doubtful filing is under review; units that references don't
    know stand as USD; only a metric of one filing links to its document.
    """
    lost = F.col("filing_id").isNull() | F.coalesce(F.col("source_path") == "", F.lit(True))
    bad = metrics.filter(lost).select(F.col("metric_id"), F.lit("no provenance").alias("error"))
    inputs = metrics.select("metric_id", F.explode("input_filing_ids").alias("filing_id")).join(doubtful.select("filing_id").distinct(), "filing_id", "left_semi").select("metric_id").distinct().withColumn("_doubt", F.lit(True))
    marked = metrics.filter(~lost).join(inputs, "metric_id", "left")
    state = F.when(F.col("_doubt"), "under_review").otherwise(F.col("quality_state"))
    c = {x: F.col(x) for x in ("tax_year", "source_path", "retrieved_at", "value")}
    row = c | {
        "unit": F.when(F.col("unit").isin("USD", "count"), F.col("unit")).otherwise("USD"), "begin": F.col("period_begin"), "end": F.col("period_end"), "quality_state": state, "source_key": F.lit("irs_990_xml"), "form_type": F.col("form"),
        "filing_id": F.col("filing_id").cast("string"), "is_amended": F.col("amended"), "raw_url": F.when(F.size(F.array_distinct("input_filing_ids")) == 1, F.col("raw_url")),
    }
    ref = source_ref(row, parser_version, F.struct(F.col("metric_key").alias("key"), F.col("version").alias("version")))
    rows = marked.select("org", F.col("metric_key").alias("series_key"), F.col("version").alias("series_version"), "tax_year", F.col("period_end").alias("fiscal_year_end"), "value", state.alias("quality_state"), F.col("amended").alias("is_amended"), ref.alias("source_ref"))
    return rows.select(*_SERIES), bad


def profile_payloads(orgs: DataFrame, filings: DataFrame, series: DataFrame, coverage: DataFrame, notices: DataFrame) -> DataFrame:
    """(org, payload) with header, snapshot facts of the newest filing (or that notices are there), and coverage."""
    newest = filings.groupBy("org").agg(F.max_by(F.col("filing_id").cast("string"), F.struct("tax_year", "period_end", F.col("filing_id").cast("string"))).alias("_newest"))
    facts = series.filter(F.col("series_key").isin(*profiles.HEAD_FACTS) & F.col("source_ref.metric").isNull()).join(newest, "org").filter(F.col("source_ref.source.filing_id") == F.col("_newest"))
    last = Window.partitionBy("org", "series_key").orderBy(F.desc("series_version"))
    names = F.create_map(*(F.lit(x) for kv in profiles.HEAD_FACTS.items() for x in kv))
    shown = facts.withColumn("_n", F.row_number().over(last)).filter("_n = 1").groupBy("org").agg(F.array_sort(F.collect_list(F.struct(names[F.col("series_key")].alias("key"), F.col("value").cast("double").alias("value"), "quality_state"))).alias("_facts"))
    noted = notices.select("org").distinct().withColumn("_noted", F.lit(True))
    years = coverage.groupBy("org").agg(F.array_sort(F.collect_list(F.struct("tax_year", "fy_end", "status"))).alias("coverage"))
    both = orgs.join(newest, "org", "left").join(shown, "org", "left").join(noted, "org", "left").join(years, "org", "left")
    none = F.array().cast("array<struct<key:string,value:double,quality_state:string>>")
    notice = F.array(F.struct(F.lit("filing_presence").alias("key"), F.lit(1.0).alias("value"), F.lit("verified").alias("quality_state")))
    snapshot = F.when(F.col("_newest").isNotNull(), F.coalesce("_facts", none)).when(F.col("_noted"), notice).otherwise(none)
    return both.select("org", F.struct(F.col("org").cast("string").alias("org_id"), "slug", "display_name", snapshot.alias("snapshot"), F.coalesce("coverage", F.array().cast("array<struct<tax_year:int,fy_end:date,status:string>>")).alias("coverage")).alias("payload"))


def slug_conflicts(orgs: DataFrame, history: DataFrame) -> DataFrame:
    """(slug, org, owner): slugs of the history that another organisation bears now."""
    now = orgs.select("slug", F.col("org").alias("owner"))
    return history.select("slug", "org").distinct().join(now, "slug").filter(F.col("org") != F.col("owner"))
