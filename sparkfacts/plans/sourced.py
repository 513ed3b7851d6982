"""Landed files and raw texts, made of the tables' own texts, read by the sources and parsers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import forms, text
from ..sources import delimited, pages
from ..session import table
from ..staging import shared_folder
from .catalog import query


def _landed(spark, df, kind: str, **options) -> str:
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


_REGISTRY = """WITH r AS (SELECT CASE WHEN c_acctbal < 0 THEN '12-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') WHEN c_acctbal > 9000 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 9, '1') END AS ein, c_mktsegment || CASE WHEN c_nationkey % 3 = 0 THEN ' ROWING CLUB, "' || c_name || '"' WHEN c_nationkey % 3 = 1 THEN ' GROWING' ELSE ' CREW' END AS name, c_mktsegment AS state FROM customer),
v AS (SELECT regexp_replace(ein, '[^0-9]', '', 'g') AS ein, name, state FROM r WHERE length(regexp_replace(ein, '[^0-9]', '', 'g')) = 9), w AS (SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 9, '1') AS ein FROM supplier)
"""


def _registry(spark, d):
    c = table(spark, d, "customer").selectExpr(
        "CASE WHEN c_acctbal < 0 THEN concat('12-', lpad(cast(c_custkey AS string), 7, '0')) WHEN c_acctbal > 9000 THEN cast(c_custkey AS string) ELSE lpad(cast(c_custkey AS string), 9, '1') END AS EIN",
        "concat(c_mktsegment, CASE WHEN c_nationkey % 3 = 0 THEN concat(' ROWING CLUB, \"', c_name, '\"') WHEN c_nationkey % 3 = 1 THEN ' GROWING' ELSE ' CREW' END) AS NAME", "c_mktsegment AS STATE",
    )
    return _landed(spark, c, "csv", header=True, escape='"')


@query(_REGISTRY + "SELECT ein AS EIN, name AS NAME, state AS STATE FROM v WHERE regexp_matches(name, 'ROWING CLUB|CREW') OR ein IN (SELECT ein FROM w)")
def watched_registry(spark, d):
    """Registrations with a whole number that have a telling name or are watched."""
    path = _registry(spark, d)
    watched = table(spark, d, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 9, "1").alias("ein"))
    return delimited.registry_csv(spark, path, watched)


_ENDINGS = "CASE s_nationkey % 8 WHEN 0 THEN ', LLC' WHEN 1 THEN ' L.L.C.' WHEN 2 THEN ' Inc.' WHEN 3 THEN ', incorporated' WHEN 4 THEN ' B' WHEN 5 THEN ' 2a' WHEN 6 THEN ', INC A' ELSE ' Incline' END"


@query(rf"SELECT s_suppkey, trim(regexp_replace(regexp_replace(trim(replace(s_name, '#', ' Club ') || {_ENDINGS}), '\s+([A-Za-z]|[0-9]+[A-Za-z]?)$', ''), '(?i),?\s+(L\.?L\.?C\.?|INC\.?|INCORPORATED)$', '')) AS name FROM supplier")
def match_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.match_name(F.expr(f"concat(replace(s_name, '#', ' Club '), {_ENDINGS})")).alias("name"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(replace(lower(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[^\pL\pN_\s]', '', 'g')), 'ß', 'ss'), '\s+'), lambda w: w <> ''))), ' ') AS key FROM pages""")
def person_keys(spark, d):
    """Words of titles, in four languages, as names are compared; by the JVM where they are plain, in Python elsewhere."""
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    both = table(spark, d, "pages").select("page_id", text.person_key(title).alias("key"), F.array_join(text.name_words(title), " ").alias("same"))
    return both.filter(F.col("key") == F.col("same")).select("page_id", "key")


_CLOCK = "CAST(CAST(floor(l_extendedprice) AS BIGINT) // 6000 AS VARCHAR) || ':' || CAST(CAST(floor(l_extendedprice) AS BIGINT) % 100 AS VARCHAR) || '.' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) // 6000 AS m, CAST(floor(l_extendedprice) AS BIGINT) % 100 AS s, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS f, {_CLOCK} AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s < 60 THEN (m * 60 + s) * 1000 + CAST(left(f || '000', 3) AS BIGINT) END AS ms, s >= 60 AS bad FROM t""")
def strict_times(spark, d):
    p = F.floor("l_extendedprice")
    raw = F.concat(F.lit(" "), F.floor(p / 6000).cast("string"), F.lit(":"), (p % 100).cast("string"), F.lit("."), F.col("l_quantity").cast("long").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.strict_time(raw).alias("t")).select("l_orderkey", "l_linenumber", "l_partkey", "t.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN year(o_orderdate) WHEN o_orderpriority < '4' THEN year(o_orderdate) + 1 END AS season, CASE WHEN o_orderstatus <> 'O' AND o_orderpriority >= '4' THEN 'neither a start date nor a year in the key' END AS problem FROM orders""")
def season_problems(spark, d):
    """Years of dates, or of the keys of the one source whose keys tell them; the others are problems."""
    start, key = F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")), F.concat_ws("/", F.lit("r/1999"), (F.year("o_orderdate") + 1).cast("string"))
    source = F.when(F.col("o_orderpriority") < "4", "time_team").otherwise("herenow")
    season = forms.season(start, key, source == "time_team")
    return table(spark, d, "orders").select("o_orderkey", season.alias("season"), forms.season_problem(start, key, source).alias("problem"))


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS year, arg_min('/a?y=' || year(o_orderdate) || '&n=' || o_orderkey, o_orderkey) AS url FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def archived_years(spark, d):
    """The first link of each year in an archive's list."""
    o = table(spark, d, "orders")
    option = F.concat(F.lit('<option selected value="'), F.when(F.col("o_orderstatus") == "P", "/none").otherwise(F.concat(F.lit("/a?y="), F.year("o_orderdate").cast("string"), F.lit("&n="), F.col("o_orderkey").cast("string"))), F.lit('">x</option>'))
    html = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", option.alias("h")))), lambda x: x["h"]), "\n").alias("html"))
    return html.select("o_custkey", F.explode(pages.archive_years(F.col("html"))).alias("year", "url"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, 'Prio ' || o_orderpriority AS category, '/x/' || month(o_orderdate) AS href, lag(year(o_orderdate)) OVER w AS py, lag(o_orderpriority) OVER w AS pp, o_orderpriority AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderpriority, o_orderkey))
SELECT o_custkey, 'Season ' || y AS date, category, href, 'Race & ' || o_orderkey AS label FROM i QUALIFY row_number() OVER (PARTITION BY o_custkey, y, href ORDER BY p, o_orderkey) = 1""")
def carried_links(spark, d):
    """Links of a listing with the date and category above them, the first of equal ones."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy("y", "o_orderpriority", "o_orderkey")
    head = F.when(~F.col("y").eqNullSafe(F.lag("y").over(w)), F.concat(F.lit('<table><tr bgcolor="#FFCC00"><td>Season '), F.col("y").cast("string"), F.lit("</td></tr></table>"))).otherwise("")
    kind = F.concat(F.lit('<span class="newscat2">Prio '), "o_orderpriority", F.lit("</span>"))
    link = F.concat(F.lit('<ul><li><a class="x" href="/x/'), F.month("o_orderdate").cast("string"), F.lit('">Race &amp; '), F.col("o_orderkey").cast("string"), F.lit("</a></li></ul>"))
    parts = o.select("o_custkey", "y", "o_orderpriority", "o_orderkey", F.concat(head, kind, link).alias("h"))
    html = parts.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "o_orderpriority", "o_orderkey", "h"))), lambda x: x["h"]), "\n").alias("html"))
    return pages.directory_links(html, "o_custkey", "html").select("o_custkey", "date", "category", "href", "label")
