"""Named queries: landed documents (XML, JSON, pages) to rows; documents are built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import filings, pages
from ..session import table
from .catalog import query

_XML = """concat('<Return returnVersion="2020v1.0"><ReturnHeader><TaxPeriodEndDt>', date_add(date'2015-12-31', cast(c_custkey % 900 as int)), '</TaxPeriodEndDt>',
 if(c_custkey % 4 = 0, '<AmendedReturnInd>X</AmendedReturnInd>', ''), '<Filer><EIN>', lpad(cast(c_custkey as string), 9, '0'), '</EIN><BusinessName><BusinessNameLine1Txt>', replace(c_name, '#', ' '), '</BusinessNameLine1Txt></BusinessName></Filer></ReturnHeader><ReturnData>',
 case c_custkey % 3
  when 0 then concat('<IRS990><CYTotalRevenueAmt>', cast(floor(c_acctbal) as bigint), '</CYTotalRevenueAmt>', if(c_custkey % 2 = 0, concat('<CYTotalExpensesAmt>', c_custkey, '</CYTotalExpensesAmt>'), ''),
   '<FundraisingGrossIncomeAmt>', 500 + c_custkey, '</FundraisingGrossIncomeAmt><FundraisingDirectExpensesAmt>', c_custkey % 100, '</FundraisingDirectExpensesAmt><CompCurrentOfcrDirectorsAmt>7</CompCurrentOfcrDirectorsAmt><TotalEmployeeCnt>', c_custkey % 9, '</TotalEmployeeCnt></IRS990>')
  when 1 then concat('<IRS990EZ><TotalRevenueAmt>', cast(floor(c_acctbal) as bigint), '</TotalRevenueAmt>', if(c_custkey % 2 = 0, concat('<TotalExpensesAmt>', c_custkey, '</TotalExpensesAmt>'), ''),
   '<OfficerDirectorTrusteeEmplGrp><CompensationAmt>10</CompensationAmt></OfficerDirectorTrusteeEmplGrp><OfficerDirectorTrusteeEmplGrp><CompensationAmt>', c_custkey, '</CompensationAmt></OfficerDirectorTrusteeEmplGrp></IRS990EZ>')
  else '<IRS990PF/>' end, '</ReturnData></Return>')"""


def _parsed(spark, d):
    return filings.parse_filings(table(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), F.expr(_XML).alias("xml")))


@query("""SELECT c_custkey AS object_id, CASE c_custkey % 3 WHEN 0 THEN '990' WHEN 1 THEN '990EZ' END AS form_type, '2020v1.0' AS return_version, strftime(DATE '2015-12-31' + CAST(c_custkey % 900 AS INT), '%Y-%m-%d') AS tax_period_end,
  lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ein, replace(c_name, '#', ' ') AS filer_name, c_custkey % 4 = 0 AS amended FROM customer""")
def filing_headers(spark, d):
    return _parsed(spark, d).select("object_id", "form_type", "return_version", "tax_period_end", "ein", "filer_name", "amended")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS f, CAST(floor(c_acctbal) AS BIGINT) AS bal FROM customer WHERE c_custkey % 3 < 2),
r AS (SELECT k, f, 'total_revenue' AS concept, bal AS value, CASE f WHEN 0 THEN 'CYTotalRevenueAmt' ELSE 'TotalRevenueAmt' END AS path FROM c
 UNION ALL SELECT k, f, 'total_expenses', CASE WHEN k % 2 = 0 THEN k END, CASE WHEN k % 2 = 0 THEN CASE f WHEN 0 THEN 'CYTotalExpensesAmt' ELSE 'TotalExpensesAmt' END END FROM c
 UNION ALL SELECT k, f, 'fundraising_events_net', CASE f WHEN 0 THEN 500 + k - k % 100 END, CASE f WHEN 0 THEN 'FundraisingGrossIncomeAmt - FundraisingDirectExpensesAmt' END FROM c
 UNION ALL SELECT k, f, 'officer_compensation', CASE f WHEN 0 THEN 7 ELSE 10 + k END, CASE f WHEN 0 THEN 'CompCurrentOfcrDirectorsAmt' ELSE 'sum(OfficerDirectorTrusteeEmplGrp/CompensationAmt) over 2 node(s)' END FROM c
 UNION ALL SELECT k, f, 'employee_count', CASE f WHEN 0 THEN k % 9 END, CASE f WHEN 0 THEN 'TotalEmployeeCnt' END FROM c)
SELECT k AS object_id, CASE f WHEN 0 THEN '990' ELSE '990EZ' END AS form_type, concept, CASE WHEN value IS NOT NULL THEN 'resolved' WHEN concept = 'employee_count' AND f = 1 THEN 'not_on_form' ELSE 'absent' END AS status, value, path FROM r""")
def filing_concepts(spark, d):
    return filings.concept_rows(_parsed(spark, d)).filter(F.col("concept").isin("total_revenue", "total_expenses", "fundraising_events_net", "officer_compensation", "employee_count"))


@query("""SELECT o_custkey, o_orderkey AS id, o_totalprice AS price FROM orders""")
def catalog_pages(spark, d):
    body = F.to_json(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))))
    landed = table(spark, d, "orders").groupBy("o_custkey").agg(body.alias("body"))
    landed = landed.withColumn("body", F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit('{"count": 1, "value": '), "body", F.lit("}"))).otherwise(F.col("body")))
    return landed.select("o_custkey", F.inline(pages.envelope_rows(F.col("body"), "struct<id:bigint,price:double>")))


_LANDED = """WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END AS status, CASE WHEN event_id % 5 = 2 THEN '<html>' ELSE props END AS body FROM events)
"""


def _landed(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr("case event_id % 5 when 0 then 404 when 1 then 500 else 200 end").alias("status"), F.expr("if(event_id % 5 = 2, '<html>', props)").alias("body"))
    return pages.landed_payloads(rows, "event_id", "status", "body")


@query(_LANDED + "SELECT event_id, sha256(body) AS checksum FROM l WHERE status = 200 AND body[1] IN ('{', '[')")
def landed_payloads(spark, d):
    return _landed(spark, d)[0].select("event_id", "checksum")


@query(_LANDED + "SELECT event_id, CASE WHEN status = 404 THEN 'not_found' WHEN status = 500 THEN 'failed' ELSE 'not_json' END AS reason FROM l WHERE status <> 200 OR body IS NULL OR body[1] NOT IN ('{', '[')")
def landed_quarantine(spark, d):
    return _landed(spark, d)[1]


@query(_LANDED + "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' WHEN event_id % 3 = 1 THEN 'same' ELSE 'conflict' END AS state FROM l WHERE status = 200 AND body[1] IN ('{', '[')")
def raw_store_states(spark, d):
    good = _landed(spark, d)[0]
    stored = good.filter("event_id % 3 <> 0").select("event_id", F.when(F.col("event_id") % 3 == 1, F.col("checksum")).otherwise("other").alias("checksum"))
    return pages.store_states(good, stored, "event_id", "checksum")


@query("""SELECT page_id, u.href FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]+)"', 1)) AS href FROM pages) u""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(pages.anchors(F.col("html"))).alias("href"))


@query("""SELECT o_orderkey, n AS pos, CASE n WHEN 0 THEN '1' ELSE '' END AS place, CAST(o_custkey AS VARCHAR) AS lane, CASE n WHEN 0 THEN '1' ELSE CAST(o_custkey AS VARCHAR) END AS entry_key FROM orders, (VALUES (0), (1)) t(n)""")
def result_tables(spark, d):
    row = lambda place: F.concat(F.lit(f"<tr><td>{place}</td><td>"), F.col("o_custkey").cast("string"), F.lit("</td><td>Club &amp; Co</td><td></td><td>6:01.2</td><td>0</td></tr>"))
    html = F.concat(F.lit("<table>"), row("1"), row(""), F.lit("<tr><td colspan=6>note</td></tr></table>"))
    good, _ = pages.result_rows(table(spark, d, "orders").withColumn("html", html), "o_orderkey", "html")
    return good.select("o_orderkey", "pos", "place", "lane", "entry_key")
