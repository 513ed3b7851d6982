"""Further named queries: loads, people, keys and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import latest, results, runs
from ..session import table
from .catalog import query


@query("""SELECT o_custkey, o_orderkey, n_dropped FROM (
  SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) - 1 AS n_dropped,
    row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P'), o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def entry_dedup(spark, d):
    o = table(spark, d, "orders")
    return results.one_entry_each(o, ["o_custkey"], F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), "o_orderkey").select("o_custkey", "o_orderkey", "n_dropped")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_returnflag = 'A' THEN 'Finish line' ELSE '500 m' END AS name, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INT) END AS distance, l_partkey AS value FROM lineitem)
SELECT l_orderkey, coalesce(arg_max(value, (n, value)) FILTER (WHERE name = 'Finish line'), arg_max(value, (distance, value)) FILTER (WHERE distance IS NOT NULL), arg_max(value, (n, value))) AS value FROM p GROUP BY l_orderkey""")
def finish_point(spark, d):
    lines = table(spark, d, "lineitem")
    point = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("value"), F.when(F.col("l_returnflag") == "A", "Finish line").otherwise("500 m").alias("name"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int")).alias("distance"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("points")).select("l_orderkey", results.finish_point(F.col("points")).alias("value"))


@query("""SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY o_custkey""")
def date_spans(spark, d):
    days = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderdate").cast("string")).alias("days"))
    return days.select("o_custkey", F.inline(F.array(results.date_span(F.col("days")))))


@query("""SELECT l_orderkey, l_linenumber, metric_key, CAST(value AS DOUBLE) AS value, unit FROM (
  SELECT l_orderkey, l_linenumber, 'finish_time' AS metric_key, CAST(l_extendedprice AS DECIMAL(18,3)) AS value, 'seconds' AS unit FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'place', l_linenumber, 'rank' FROM lineitem WHERE l_returnflag <> 'R')""")
def result_metrics(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(round(l_extendedprice * 1000) AS bigint) AS time_ms", "cast(null AS bigint) AS adjusted_time_ms", "cast(null AS bigint) AS margin_ms",
        "cast(null AS bigint) AS penalty_ms", "if(l_returnflag <> 'R', l_linenumber, null) AS position", "cast(null AS int) AS adjusted_position")
    return results.metric_rows(rows, ["l_orderkey", "l_linenumber"]).withColumn("value", F.col("value").cast("double"))


@query("""SELECT o_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey
WHERE l_orderkey IS NULL OR CAST(o_orderdate AS DATE) >= DATE '1998-07-01' - 14""")
def races_to_fetch(spark, d):
    o = table(spark, d, "orders").withColumn("start", F.col("o_orderdate").cast("date"))
    have = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return results.to_fetch(o, have, "o_orderkey", "start", F.lit("1998-07-01").cast("date")).select("o_orderkey")


@query("""SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'P') = 0""")
def complete_loads(spark, d):
    o = table(spark, d, "orders")
    return results.complete(o, o.filter("o_orderstatus <> 'P'"), "o_custkey", "o_orderkey")[0]


@query("""WITH r AS (SELECT user_id, event_id, event_type <> 'error' AS hit, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS 1 PRECEDING) = 2 AS stop FROM events),
s AS (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM r)
SELECT user_id, event_id FROM s WHERE NOT over_""")
def probe_until_misses(spark, d):
    e = table(spark, d, "events").withColumn("hit", F.col("event_type") != "error")
    return results.until_misses(e, "user_id", "event_id", "hit", 2).select("user_id", "event_id")


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, array_to_string(list(CASE WHEN role = 'user' THEN 'stroke' ELSE 'rower' END ORDER BY turn), ',') AS crew FROM c GROUP BY conv_id""")
def crew_roles(spark, d):
    c = table(spark, d, "conversations").withColumn("job", F.when(F.col("role") == "user", "Stroke seat").otherwise("3"))
    return results.crews(c, ["conv_id"], "text", "job", "turn").select("conv_id", F.array_join(F.transform("crew", lambda x: x["role"]), ",").alias("crew"))


@query("""SELECT l_suppkey, CAST(sum(coalesce(CASE WHEN l_linenumber > 1 THEN CAST(l_quantity AS BIGINT) END, 0) + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS total,
  count(*) FILTER (WHERE l_linenumber > 1 OR l_returnflag = 'A') AS n_paid, count(*) FILTER (WHERE l_linenumber = 1 AND l_returnflag <> 'A') AS n_volunteers FROM lineitem GROUP BY l_suppkey""")
def people_pay(spark, d):
    people = table(spark, d, "lineitem").selectExpr("l_suppkey", "if(l_linenumber > 1, cast(l_quantity AS bigint), null) AS comp", "if(l_returnflag = 'A', 1L, null) AS other_comp")
    return results.people_year(people, ["l_suppkey"], ["comp", "other_comp"])


@query("""SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) WHEN 3 THEN '990' WHEN 2 THEN '990ez' WHEN 1 THEN '990n_only' ELSE 'none' END AS coverage FROM orders GROUP BY o_custkey""")
def coverage_states(spark, d):
    forms = table(spark, d, "orders").select("o_custkey", F.expr("case o_orderstatus when 'F' then '990' when 'O' then '990EZ' when 'P' then '990N' end AS form"))
    return results.coverage_state(forms, "o_custkey", "form")


@query("""WITH r AS (SELECT p_type, p_brand, CASE p_size % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'absent' ELSE 'not_on_form' END AS s FROM part)
SELECT p_type, p_brand, count(*) FILTER (WHERE s = 'resolved') AS resolved, count(*) FILTER (WHERE s = 'absent') AS absent, count(*) FILTER (WHERE s = 'not_on_form') AS not_on_form,
  CASE WHEN count(*) FILTER (WHERE s <> 'not_on_form') > 0 THEN round(count(*) FILTER (WHERE s = 'resolved') / count(*) FILTER (WHERE s <> 'not_on_form'), 4) END AS rate FROM r GROUP BY ALL""")
def resolve_rates(spark, d):
    r = table(spark, d, "part").selectExpr("p_type", "p_brand", "case p_size % 3 when 0 then 'resolved' when 1 then 'absent' else 'not_on_form' end AS status")
    return results.resolve_rates(r, ["p_type", "p_brand"])


@query("""WITH b AS (SELECT o_orderpriority AS p, count(*) AS n_before FROM orders GROUP BY ALL), a AS (SELECT o_orderpriority AS p, count(*) AS n_now FROM orders WHERE o_orderkey % 25 > 0 OR o_orderpriority < '3' GROUP BY ALL)
SELECT p AS o_orderpriority, n_before, coalesce(n_now, 0) AS n_now, coalesce(n_now, 0) < 0.95 * n_before AS alarm FROM b LEFT JOIN a USING (p)""")
def shrink_alarm(spark, d):
    o = table(spark, d, "orders")
    return runs.shrink_alarm(o.filter("o_orderkey % 25 > 0 or o_orderpriority < '3'"), o, "o_orderpriority")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS raw, CASE WHEN length(CAST(o_orderkey + 99999000 AS VARCHAR)) = 9 THEN CAST(o_orderkey + 99999000 AS VARCHAR) END AS strict, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS padded FROM orders""")
def ein_forms(spark, d):
    raw = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select(raw.alias("raw"), text.ein((F.col("o_orderkey") + 99999000).cast("string")).alias("strict"), text.ein(raw, pad=True).alias("padded"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'time_team' WHEN 1 THEN 'herenow' WHEN 2 THEN 'crewtimer' ELSE 'regattatiming' END AS provider,
  CASE page_id % 4 WHEN 0 THEN 'head-' || page_id || '/2024' WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN 'r' || page_id ELSE CAST(page_id AS VARCHAR) END AS key FROM pages""")
def provider_keys(spark, d):
    url = F.expr("case page_id % 4 when 0 then concat('https://usrowing.regatta.time-team.com/head-', page_id, '/2024/races') when 1 then concat('https://www.herenow.com/#/races/', page_id, '/results')"
                 " when 2 then concat('https://crewtimer.com/regatta/R', page_id) else concat('https://results.regattatiming.com/event.jsp?raceId=', page_id) end")  # fmt: skip
    provider = text.provider_of_host(F.parse_url(url, F.lit("HOST")))
    return table(spark, d, "pages").select("page_id", provider.alias("provider"), text.provider_key(url, provider).alias("key"))


@query("""SELECT p_partkey, (CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END) AS minor FROM part""")
def minors(spark, d):
    name = F.expr("case p_size % 5 when 0 then concat('Girls U12 ', p_partkey) when 1 then 'Under 13 double' when 2 then 'U15 single' when 3 then 'WU-10B' else 'Open 113U' end")
    return table(spark, d, "part").select("p_partkey", text.is_under13(name).alias("minor"))


@query("""WITH RECURSIVE h AS (SELECT s_suppkey, s_name, 1 AS i, CAST(2166136261 AS BIGINT) AS h FROM supplier
  UNION ALL SELECT s_suppkey, s_name, i + 1, (xor(h, CAST(ascii(s_name[i]) AS BIGINT)) * 16777619) & 4294967295 FROM h WHERE i <= length(s_name))
SELECT s_suppkey, h AS hash, h % 12 AS shape FROM h WHERE i = length(s_name) + 1""")
def name_hash(spark, d):
    h = text.fnv1a(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", h.alias("hash"), (h % 12).alias("shape"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(generate_series(min(l_linenumber), max(l_linenumber)) || [CAST(max(l_linenumber) + 2 AS BIGINT)])), ',') AS ids FROM lineitem GROUP BY l_orderkey""")
def id_ranges(spark, d):
    spec = F.concat(F.min("l_linenumber").cast("string"), F.lit("-"), F.max("l_linenumber").cast("string"), F.lit(", "), (F.max("l_linenumber") + 2).cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(spec.alias("spec")).select("l_orderkey", F.array_join(text.id_ranges(F.col("spec")).cast("array<string>"), ",").alias("ids"))


@query("""SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20""")
def latest_audit(spark, d):
    """The twenty newest rows: a report."""
    return table(spark, d, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts")


@query("""SELECT c_custkey, ordinal, money FROM (SELECT c_custkey,
  CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
  CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs(c_acctbal) >= 1000 THEN CAST(CAST(floor(abs(c_acctbal) / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(CAST(floor(abs(c_acctbal) + 0.5) AS BIGINT) AS VARCHAR) END AS money FROM customer)""")
def display_forms(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.ordinal(F.col("c_custkey")).alias("ordinal"), text.compact_usd(F.col("c_acctbal")).alias("money"))


@query("""WITH t AS (SELECT o_custkey AS entity, 'inclusion' AS kind FROM orders WHERE o_orderstatus = 'F'), open AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_orderstatus = 'P')
SELECT DISTINCT entity, kind FROM t WHERE entity NOT IN (SELECT entity FROM open)""")
def guarded_tasks(spark, d):
    o = table(spark, d, "orders")
    proposed = o.filter("o_orderstatus = 'F'").selectExpr("o_custkey AS entity", "'inclusion' AS kind")
    return latest.guarded_tasks(proposed, o.filter("o_orderstatus = 'P'").selectExpr("o_custkey AS entity", "'inclusion' AS kind"), ["entity", "kind"])


@query("""SELECT event_id, user_id, event_type, value, props, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INT) AS rank, row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 100 AS kept FROM events""")
def retained_snapshots(spark, d):
    """Every event a snapshot, with its whole payload beside the rank."""
    return latest.retention(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 100).drop("ts")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank FROM lineitem""")
def ranked_within(spark, d):
    """Ranks within three large groups, none of which meets in one task."""
    order = [F.desc("l_shipdate"), *(F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))]
    return latest.ranked(table(spark, d, "lineitem"), order, ("l_returnflag",)).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", "rank")
