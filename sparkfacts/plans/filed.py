"""Filings put together from orders, one element an order, and read back: all concepts, people, quarantine.

A customer's orders, by key, are the elements of its filing. An order's key picks the
concept, its day the candidate path; its price is the amount and, for priorities that
start with 4, the priority itself stands there (no number). Orders over a price are
people. Customers of one segment file a form without concepts, and those of another with
a negative balance file a document that breaks off.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import filings
from ..session import table
from .catalog import query

_FORM = "CASE WHEN c_mktsegment = 'FURNITURE' THEN 'IRS990PF' WHEN c_nationkey % 2 = 0 THEN 'IRS990' ELSE 'IRS990EZ' END"
_BROKEN = "(c_mktsegment = 'MACHINERY' AND c_acctbal < 0)"
_PATHS = [(i, form, k, path) for i, c in enumerate(filings.CONCEPTS) for f, form in enumerate(filings.FORMS.values()) for k, path in enumerate(filings._paths(c[1 + f]))]
_WIDTH = len(filings.CONCEPTS)
_PERSON = {f: (g, p["title"][0], p["avg_hours"][0], p["comp"][0]) for f, (g, p) in filings.PEOPLE.items()}
_ROLE = list(filings.ROLES)


def _documents(spark, d):
    """(object_id, xml) of every customer with orders."""
    paths = spark.createDataFrame(_PATHS, "concept int, form string, nth int, path string").withColumn("n", F.expr("count(*) over (partition by concept, form)"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).withColumn("form", F.expr(_FORM)).withColumn("concept", F.expr(f"cast(o_orderkey % {_WIDTH} as int)"))
    placed = orders.join(F.broadcast(paths), ["concept", "form"], "left").filter("path is null or dayofmonth(o_orderdate) % n = nth")
    amount = F.when(F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    outer, inner = F.element_at(F.split("path", "/"), 1), F.get(F.split("path", "/"), F.lit(1))
    element = F.when(inner.isNull(), F.concat(F.lit("<e:"), outer, F.lit(' unit="usd"> '), amount, F.lit("<!-- 7 --></e:"), outer, F.lit(">"))).otherwise(
        F.concat(F.lit("<e:"), outer, F.lit("><e:Note>1</e:Note><e:"), inner, F.lit(">"), amount, F.lit("</e:"), inner, F.lit("></e:"), outer, F.lit(">"))
    )
    person = F.lit("")
    for form, (group, title, hours, comp) in _PERSON.items():
        roles = F.concat(*(F.when(F.col("o_orderpriority").startswith(str(i)), f"<e:{tag}>X</e:{tag}>").otherwise("") for i, tag in enumerate(_ROLE, 1)))
        own = F.concat(
            F.lit(f"<e:{group}><e:NamePerson>"), "c_name", F.lit("</e:NamePerson>"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("<e:PersonNm>Dr. &amp; "), "c_name", F.lit("</e:PersonNm>"))).otherwise(""),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(f"<e:{title}>"), "o_orderpriority", F.lit(f"</e:{title}>"))).otherwise(""), F.lit(f"<e:{hours}>"), F.dayofmonth("o_orderdate").cast("string"), F.lit(f"</e:{hours}><e:{comp}>"),
            F.col("o_totalprice").cast("string"), F.lit(f"</e:{comp}>"), roles, F.lit(f"</e:{group}>"),
        )
        person = F.when((F.col("form") == form) & (F.col("o_totalprice") > 300_000), own).otherwise(person)
    parts = F.sort_array(F.collect_list(F.struct("o_orderkey", F.concat(F.coalesce(element, F.lit("")), person).alias("x"))))
    made = placed.groupBy("o_custkey").agg(parts.alias("parts"), F.first("form").alias("form"), F.first("c_name").alias("name"), F.first(F.expr(_BROKEN)).alias("broken"), F.max("o_orderdate").alias("last"))
    head = F.concat(
        F.lit('<?xml version="1.0"?><e:Return xmlns:e="http://example.org/e" returnVersion="v'), F.year("last").cast("string"), F.lit('"><e:ReturnHeader><e:TaxPeriodEndDate>'), F.date_format("last", "yyyy-MM-dd"),
        F.lit("</e:TaxPeriodEndDate><e:Filer><e:EIN>"), F.col("o_custkey").cast("string"), F.lit("</e:EIN><e:Name><e:BusinessNameLine1>"), "name", F.lit('</e:BusinessNameLine1></e:Name></e:Filer></e:ReturnHeader><e:ReturnData><e:'), "form", F.lit(' documentId="1">'),
    )
    tail = F.when(F.col("broken"), "").otherwise(F.concat(F.lit("</e:"), "form", F.lit("></e:ReturnData></e:Return>")))
    return made.select(F.col("o_custkey").alias("object_id"), F.concat(head, F.array_join(F.col("parts.x"), ""), tail).alias("xml"))


_VALUES = ", ".join(f"({i}, '{form}', {k}, '{path}')" for i, form, k, path in _PATHS)
_NODES = f"""WITH paths AS (SELECT *, count(*) OVER (PARTITION BY concept, form) AS n FROM (VALUES {_VALUES}) t(concept, form, nth, path)),
o AS (SELECT *, {_FORM} AS form, {_BROKEN} AS broken, CAST(o_orderkey % {_WIDTH} AS INT) AS concept FROM orders JOIN customer ON o_custkey = c_custkey),
good AS (SELECT * FROM o WHERE NOT broken AND form <> 'IRS990PF'),
nodes AS (
  SELECT o_custkey AS k, form, path, o_orderkey AS ord, CASE WHEN o_orderpriority[1] <> '4' THEN CAST(round_even(o_totalprice, 0) AS BIGINT) END AS v FROM good JOIN paths USING (concept, form) WHERE day(o_orderdate) % n = nth
  UNION ALL SELECT o_custkey, form, 'OfficerDirectorTrusteeEmplGrp/CompensationAmt', o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) FROM good WHERE form = 'IRS990EZ' AND o_totalprice > 300000
), firsts AS (SELECT k, form, path, min_by(v, ord) AS v, sum(v) AS total, count(*) AS n FROM nodes WHERE v IS NOT NULL GROUP BY ALL)
"""


def _rule(form: str, i: int, name: str, spec) -> str:
    """SELECT of (k, value, path) of one concept."""
    who = f"(SELECT DISTINCT o_custkey AS k FROM good WHERE form = '{form}')"
    if isinstance(spec, dict) and "sum" in spec:
        parts = ", ".join(f"'{p}'" for p in spec["sum"])
        order = " ".join(f"WHEN '{p}' THEN {j}" for j, p in enumerate(spec["sum"]))
        return f"SELECT k, '{name}' AS concept, '{form}' AS form, CAST(sum(total) AS BIGINT) AS value, 'sum(' || string_agg(path, ' + ' ORDER BY CASE path {order} END) || ') over ' || CAST(sum(n) AS BIGINT) || ' node(s)' AS path FROM firsts WHERE form = '{form}' AND path IN ({parts}) GROUP BY k"
    if isinstance(spec, dict):
        a, b = spec["sub"]
        return f"SELECT a.k, '{name}', '{form}', a.v - coalesce(b.v, 0), '{a} - {b}' FROM firsts a LEFT JOIN firsts b ON b.k = a.k AND b.form = a.form AND b.path = '{b}' WHERE a.form = '{form}' AND a.path = '{a}'"
    if spec is None:
        return f"SELECT k, '{name}', '{form}', NULL, 'none' FROM {who}"
    order = " ".join(f"WHEN '{p}' THEN {j}" for j, p in enumerate(spec))
    parts = ", ".join(f"'{p}'" for p in spec)
    return f"SELECT k, '{name}', '{form}', min_by(v, CASE path {order} END), min_by(path, CASE path {order} END) FROM firsts WHERE form = '{form}' AND path IN ({parts}) GROUP BY k"


_RULES = " UNION ALL ".join(_rule(form, i, c[0], c[1 + f]) for i, c in enumerate(filings.CONCEPTS) for f, form in enumerate(filings.FORMS.values()))


@query(_NODES + f""", found(k, concept, form, value, path) AS ({_RULES}), names AS (SELECT unnest([{', '.join(f"'{c[0]}'" for c in filings.CONCEPTS)}]) AS concept)
SELECT g.k AS object_id, CASE g.form WHEN 'IRS990' THEN '990' ELSE '990EZ' END AS form_type, concept, CASE WHEN f.path = 'none' THEN 'not_on_form' WHEN f.value IS NULL THEN 'absent' ELSE 'resolved' END AS status, f.value, nullif(f.path, 'none') AS path
FROM (SELECT DISTINCT o_custkey AS k, form FROM good) g CROSS JOIN names LEFT JOIN found f USING (k, form, concept)""")
def filed_concepts(spark, d):
    """All concepts of both forms, with second candidates, sums, differences and texts that are no numbers."""
    return filings.concept_rows(filings.parse_filings(_documents(spark, d)))


@query(_NODES + f""", people AS (SELECT *, o_custkey AS object_id FROM good WHERE o_totalprice > 300000),
groups AS (
  SELECT object_id, o_orderkey, 1 AS half FROM people
  UNION ALL SELECT o_custkey, o_orderkey, 0 FROM good WHERE form = 'IRS990EZ' AND concept = {[c[0] for c in filings.CONCEPTS].index('officer_compensation')}
), placed AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY o_orderkey, half) - 1 AS pos FROM groups)
SELECT object_id, CAST(pos AS INT) AS pos, CASE WHEN o_orderstatus = 'F' THEN 'Dr. & ' ELSE '' END || c_name AS name, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title, CAST(round_even(o_totalprice, 0) AS BIGINT) AS comp,
  CAST(day(o_orderdate) AS VARCHAR) AS avg_hours, CASE WHEN form = 'IRS990' THEN CASE o_orderpriority[1] {' '.join(f"WHEN '{i}' THEN '{flag}'" for i, flag in enumerate(filings.ROLES.values(), 1))} ELSE '' END ELSE '' END AS role_flags
FROM people JOIN placed USING (object_id, o_orderkey) WHERE half = 1""")
def filed_people(spark, d):
    """People of filings, with titles, hours, amounts and roles."""
    people = filings.people_rows(filings.parse_filings(_documents(spark, d)))
    return people.select("object_id", "pos", "name", "title", "comp", "avg_hours", F.array_join("role_flags", ",").alias("role_flags"))


@query(_NODES + """SELECT o_custkey AS object_id, CASE WHEN max(broken) THEN 'malformed' ELSE 'no_form' END AS reason FROM o GROUP BY o_custkey HAVING max(broken) OR max(form) = 'IRS990PF'""")
def filed_quarantine(spark, d):
    """Documents that break off or have neither form: a row each, and the job goes on."""
    return filings.quarantined(filings.parse_filings(_documents(spark, d))).drop("detail")


@query(_NODES + """SELECT o_custkey AS object_id, CASE any_value(form) WHEN 'IRS990' THEN '990' WHEN 'IRS990EZ' THEN '990EZ' END AS form_type, 'v' || year(max(o_orderdate)) AS return_version, strftime(max(o_orderdate), '%Y-%m-%d') AS tax_period_end, strftime(max(o_orderdate), '%m') AS fye_month,
  CAST(o_custkey AS VARCHAR) AS ein, any_value(c_name) AS filer_name FROM o WHERE NOT broken GROUP BY o_custkey""")
def filed_headers(spark, d):
    """Headers by their second names, of every document that can be read."""
    parsed = filings.parse_filings(_documents(spark, d)).filter("error is null or error = 'no_form'")
    return parsed.select("object_id", "form_type", "return_version", "tax_period_end", "fye_month", "ein", "filer_name")
