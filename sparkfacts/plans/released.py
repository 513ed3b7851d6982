"""A release of nine read tables, from orders as filings and notices and lines as facts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import assembly, profiles, publish, releases
from ..session import table
from ..staging import shared_folder
from .catalog import query

_HEADS = list(profiles.HEAD_FACTS)
_CONCEPT = f"element_at(array({', '.join(repr(c) for c in _HEADS)}, 'other'), least(l_linenumber, {len(_HEADS) + 1}))"
_SQL_CONCEPT = f"[{', '.join(repr(c) for c in _HEADS)}, 'other'][least(l_linenumber, {len(_HEADS) + 1})]"
_FILED = "o_orderkey AS filing_id, o_custkey AS org, cast(year(o_orderdate) AS int) AS tax_year, last_day(o_orderdate) AS period_end, CASE WHEN o_orderpriority < '3' THEN '990' ELSE '990EZ' END AS form, o_orderstatus = 'F' AS amended"
_NOTICED = "o_orderkey AS observation_id, o_custkey AS org, cast(year(o_orderdate) AS int) AS tax_year, CASE WHEN o_orderpriority NOT LIKE '1%' THEN last_day(o_orderdate) END AS period_end"


def _source(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    filings = orders.filter("o_orderstatus <> 'P' and o_totalprice >= 100000").selectExpr("o_orderkey AS filing_id", "o_custkey AS org", "cast(year(o_orderdate) AS int) AS tax_year", "last_day(o_orderdate) AS period_end", "CASE WHEN o_orderpriority < '3' THEN '990' ELSE '990EZ' END AS form", "o_orderstatus = 'F' AS amended")
    notices = orders.filter("o_orderstatus = 'P'").selectExpr("o_orderkey AS observation_id", "o_custkey AS org", "cast(year(o_orderdate) AS int) AS tax_year", "CASE WHEN o_orderpriority NOT LIKE '1%' THEN last_day(o_orderdate) END AS period_end")
    orgs = table(spark, d, "customer").selectExpr("c_custkey AS org", "concat('c', c_custkey) AS slug", "c_name AS display_name", "lower(c_mktsegment) AS kind")
    return orders, lines, filings, notices, orgs


def _facts(filings, lines):
    lines = lines.join(filings.selectExpr("filing_id AS l_orderkey"), "l_orderkey", "left_semi")  # sent by filing once, and no lines of others
    rows = lines.selectExpr("l_orderkey AS filing_id", f"{_CONCEPT} AS concept", "l_partkey AS version", "cast(l_extendedprice AS decimal(16,2)) AS amount", "if(l_returnflag = 'R', 'partial', 'verified') AS quality_state", "l_shipdate AS retrieved_at", "l_suppkey")
    rows = rows.groupBy("filing_id", "concept", "version").agg(F.max_by(F.struct("amount", "quality_state", "retrieved_at"), F.struct("amount", "quality_state", "retrieved_at")).alias("v")).select("filing_id", "concept", "version", "v.*")
    return rows.join(filings, "filing_id").withColumns({"unit": F.lit("USD"), "period_begin": F.when(F.col("form") == "990", F.add_months("period_end", -6)), "source_path": F.concat(F.lit("/x/"), "concept"), "raw_url": F.concat(F.lit("https://example.org/"), F.col("filing_id").cast("string"))})


_BASE = f"""WITH filings AS (SELECT {_FILED} FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 100000), notices AS (SELECT {_NOTICED} FROM orders WHERE o_orderstatus = 'P'),
facts AS (SELECT l_orderkey AS filing_id, {_SQL_CONCEPT} AS concept, l_partkey AS version, max(struct_pack(a := CAST(l_extendedprice AS DECIMAL(16,2)), b := CASE WHEN l_returnflag = 'R' THEN 'partial' ELSE 'verified' END, c := l_shipdate)) AS v FROM lineitem GROUP BY ALL),
series AS (SELECT org, filing_id, concept, version, tax_year, period_end, v.a AS value, CASE WHEN filing_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000) THEN 'under_review' ELSE v.b END AS quality_state, amended, form FROM facts JOIN filings USING (filing_id)),
shown AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY org, tax_year ORDER BY amended DESC, period_end DESC, CAST(filing_id AS VARCHAR) DESC) = 1),
noted AS (SELECT org, tax_year, coalesce(period_end, make_date(tax_year, 12, 31)) AS fy_end FROM notices QUALIFY row_number() OVER (PARTITION BY org, tax_year ORDER BY CAST(observation_id AS VARCHAR) DESC) = 1),
span AS (SELECT org, CAST(unnest(generate_series(min(tax_year), max(tax_year))) AS INT) AS tax_year FROM (SELECT org, tax_year FROM filings UNION ALL SELECT org, tax_year FROM notices) GROUP BY org),
coverage AS (SELECT org, tax_year, coalesce(s.period_end, n.fy_end) AS fy_end, CASE WHEN s.org IS NOT NULL THEN CASE WHEN amended THEN 'amended' WHEN form = '990' THEN '990' ELSE '990ez' END WHEN n.org IS NOT NULL THEN '990n' ELSE 'missing' END AS status
  FROM span LEFT JOIN shown s USING (org, tax_year) LEFT JOIN noted n USING (org, tax_year))
"""


@query(_BASE + "SELECT org, tax_year, fy_end, status FROM coverage")
def coverage_statuses(spark, d):
    _, _, filings, notices, _ = _source(spark, d)
    return assembly.coverage_rows(filings, notices)


@query(_BASE + """, months AS (SELECT org, month(period_end) AS m, count(*) AS n FROM filings GROUP BY ALL), fye AS (SELECT org, CAST(m AS INT) AS fye_month FROM months QUALIFY row_number() OVER (PARTITION BY org ORDER BY n DESC, m) = 1)
SELECT c_custkey AS org, 'c' || c_custkey AS slug, c_name AS display_name, CASE WHEN c_custkey IN (SELECT org FROM filings WHERE form = '990') THEN '990' WHEN c_custkey IN (SELECT org FROM filings) THEN '990ez' WHEN c_custkey IN (SELECT org FROM notices) THEN '990n_only' ELSE 'none' END AS coverage_state,
  c_name || ' c' || c_custkey || CASE WHEN c_acctbal > 0 THEN ' ' || c_mktsegment ELSE '' END AS search_document, fye_month FROM customer LEFT JOIN fye ON org = c_custkey""")
def directory_rows(spark, d):
    _, _, filings, notices, orgs = _source(spark, d)
    aliases = table(spark, d, "customer").filter("c_acctbal > 0").selectExpr("c_custkey AS org", "c_mktsegment AS alias")
    return assembly.directories(orgs, filings, notices, aliases).drop("aliases")


def _series(spark, d):
    orders, lines, filings, _, _ = _source(spark, d)
    return assembly.fact_series(_facts(filings, lines), orders.filter("o_totalprice > 450000").selectExpr("o_orderkey AS filing_id"), "p1")


@query(_BASE + """SELECT org, concept AS series_key, version AS series_version, tax_year, period_end AS fiscal_year_end, CAST(value AS DOUBLE) AS value, quality_state, amended AS is_amended, 'https://example.org/' || filing_id AS raw_url,
  'FY' || tax_year || ' (' || strftime(CASE WHEN form = '990' THEN CAST(period_end - INTERVAL 6 MONTH AS DATE) ELSE CAST(period_end - INTERVAL 12 MONTH + INTERVAL 1 DAY AS DATE) END, '%b %Y') || '–' || strftime(period_end, '%b %Y') || ')' AS label FROM series""")
def sourced_series(spark, d):
    s = _series(spark, d)
    return s.select("org", "series_key", "series_version", "tax_year", "fiscal_year_end", F.col("value").cast("double").alias("value"), "quality_state", "is_amended", F.col("source_ref.source.raw_url").alias("raw_url"), F.col("source_ref.period.label").alias("label"))


def _tables(spark, d):
    orders, lines, filings, notices, orgs = _source(spark, d)
    series, coverage = _series(spark, d), assembly.coverage_rows(filings, notices)
    aliases = table(spark, d, "customer").filter("c_acctbal > 0").selectExpr("c_custkey AS org", "c_mktsegment AS alias")
    results = lines.selectExpr("l_suppkey AS org", "l_orderkey AS regatta", "l_linenumber AS entry", "l_extendedprice AS value").join(orders.selectExpr("o_orderkey AS regatta", "year(o_orderdate) AS season"), "regatta")
    made = (
        assembly.directories(orgs, filings, notices, aliases), series, coverage, lambda made: assembly.profile_payloads(orgs, filings, made["org_financial_series"], made["org_filing_coverage"], notices), profiles.peer_cohorts(orgs, "org", "kind"),
        table(spark, d, "part").selectExpr("p_type AS metric_key", "1 AS metric_version").distinct(), orders.selectExpr("o_orderpriority AS source_key").distinct(), results, orgs.select("slug", "org"),
    )
    return dict(zip(assembly.TABLES, made))


def _rules(written):
    """What must have no rows: by the written tables themselves."""
    orgs, series = written["org_directory"], written["org_financial_series"]
    return publish.snapshot_violations(series.select("org", "series_key", "series_version", "tax_year", F.col("source_ref.source.filing_id").alias("filing_id"), F.col("tax_year").alias("season")).join(orgs.select("org", "slug"), "org"), orgs, ["org", "series_key", "series_version", "tax_year", "filing_id"]) | {
        "slug_of_other": assembly.slug_conflicts(orgs, written["org_slug_history"]),
    }


@query(_BASE + """SELECT 'org_directory' AS name, count(*) AS n_rows FROM customer UNION ALL SELECT 'org_financial_series', count(*) FROM series UNION ALL SELECT 'org_filing_coverage', count(*) FROM coverage UNION ALL SELECT 'org_profile', count(*) FROM customer UNION ALL SELECT 'org_peer_cohort', count(*) FROM customer
UNION ALL SELECT 'metric_catalog', count(DISTINCT p_type) FROM part UNION ALL SELECT 'source_registry_public', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'org_regatta_result', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'org_slug_history', count(*) FROM customer""")
def release_manifest(spark, d):
    """Nine tables written, validated and released together; what their manifest says of each."""
    r = releases.Releases(spark, f"{shared_folder(spark)}/release-{uuid.uuid4().hex}")
    number = r.release(_tables(spark, d), _rules)
    return spark.createDataFrame([(name, t["rows"]) for name, t in r.manifest(number)["tables"].items()], "name string, n_rows long")


@query(_BASE + """, newest AS (SELECT org, filing_id FROM filings QUALIFY row_number() OVER (PARTITION BY org ORDER BY tax_year DESC, period_end DESC, CAST(filing_id AS VARCHAR) DESC) = 1),
heads AS (SELECT s.org, concept, value FROM series s JOIN newest n ON n.org = s.org AND n.filing_id = s.filing_id WHERE concept <> 'other' QUALIFY row_number() OVER (PARTITION BY s.org, concept ORDER BY version DESC) = 1)
SELECT c_custkey AS org, CASE WHEN c_custkey IN (SELECT org FROM newest) THEN (SELECT count(*) FROM heads h WHERE h.org = c_custkey) WHEN c_custkey IN (SELECT org FROM notices) THEN 1 ELSE 0 END AS n_facts, (SELECT CAST(sum(value) AS DOUBLE) FROM heads h WHERE h.org = c_custkey) AS total,
  (SELECT count(*) FROM coverage v WHERE v.org = c_custkey) AS n_years, (SELECT count(*) FROM coverage v WHERE v.org = c_custkey AND status = 'missing') AS n_missing FROM customer""")
def released_profiles(spark, d):
    """Profiles read back from a release."""
    r = releases.Releases(spark, f"{shared_folder(spark)}/release-{uuid.uuid4().hex}")
    r.release({k: v for k, v in _tables(spark, d).items() if k in ("org_directory", "org_financial_series", "org_filing_coverage", "org_profile", "org_slug_history")}, _rules)
    p = r.read("org_profile").select("org", "payload.*")
    total = F.aggregate("snapshot", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + F.when(x["key"] == "filing_presence", 0).otherwise(x["value"]).cast("decimal(38,2)")).cast("decimal(38,2)"))
    has = F.size(F.filter("snapshot", lambda x: x["key"] != "filing_presence")) > 0
    return p.select("org", F.size("snapshot").cast("long").alias("n_facts"), F.when(has, total.cast("double")).alias("total"), F.size("coverage").cast("long").alias("n_years"), F.size(F.filter("coverage", lambda c: c["status"] == "missing")).cast("long").alias("n_missing"))
