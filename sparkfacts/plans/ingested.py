"""Rows counted while they are written, and catalogs by the page."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import latest, runs
from ..sources import pages
from ..session import table
from ..staging import shared_folder
from .catalog import query

_INCOMING = """WITH incoming AS (SELECT l_orderkey AS k, l_shipdate AS checksum, l_returnflag AS kind, l_tax FROM lineitem), stored AS (SELECT o_orderkey AS k, o_orderdate AS checksum FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT l_orderkey, min(l_shipdate) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_returnflag <> 'R' AND l_tax > 0 GROUP BY 1 HAVING min(l_linenumber) = 1),
m AS (SELECT i.*, s.checksum AS have, row_number() OVER (PARTITION BY i.k, kind = 'R', l_tax = 0 ORDER BY i.checksum) AS nth FROM incoming i LEFT JOIN stored s ON s.k = i.k),
states AS (SELECT *, CASE WHEN kind = 'R' THEN 'dropped' WHEN l_tax = 0 THEN 'quarantined' WHEN nth > 1 THEN 'repeated' WHEN have = checksum THEN 'unchanged' WHEN have IS NOT NULL THEN 'conflict' ELSE 'inserted' END AS state FROM m)
"""


def _ingested(spark, d):
    incoming = table(spark, d, "lineitem").selectExpr("l_orderkey AS k", "l_shipdate AS checksum", "l_returnflag AS kind", "l_tax")
    orders = table(spark, d, "orders")
    same = table(spark, d, "lineitem").filter("l_returnflag <> 'R' and l_tax > 0").join(orders.filter("o_orderstatus = 'F'"), F.expr("o_orderkey = l_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_shipdate").alias("checksum"), F.min("l_linenumber").alias("n")).filter("n = 1").drop("n")
    stored = orders.filter("o_orderstatus <> 'F'").selectExpr("o_orderkey AS k", "o_orderdate AS checksum").unionByName(same)
    run = runs.Run("ingest", "lines")
    rows = runs.ingest(run, incoming, stored, ["k"], "checksum", F.col("kind") == "R", F.col("l_tax") == 0, F.lit("no_tax"), f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}")
    return run, rows


@query(_INCOMING + ", names AS (SELECT unnest(['inserted', 'unchanged', 'repeated', 'dropped', 'quarantined', 'conflict']) AS counter) SELECT counter, (SELECT count(*) FROM states WHERE state = counter) AS n FROM names")
def ingest_counters(spark, d):
    """What became of every incoming row, from the run's log row."""
    run, _ = _ingested(spark, d)
    return run.row(spark, "succeeded").select(F.explode("stats").alias("counter", "n"))


@query(_INCOMING + "SELECT k, checksum, CASE state WHEN 'inserted' THEN 'inserted' ELSE 'quarantined' END AS state, CASE state WHEN 'conflict' THEN 'conflict' WHEN 'quarantined' THEN 'no_tax' END AS reason FROM states WHERE state IN ('inserted', 'quarantined', 'conflict')")
def ingested_rows(spark, d):
    return _ingested(spark, d)[1].select("k", "checksum", "state", "reason")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem WHERE l_discount > 0) SELECT i // 5000 AS page, l_orderkey AS id, l_linenumber AS line, l_partkey AS part FROM r""")
def paged_catalog(spark, d):
    """Pages of 5,000 as lists and as envelopes, the last one short; a stray page behind it isn't read."""
    rows = latest.ranked(table(spark, d, "lineitem").filter("l_discount > 0"), [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    item = F.struct(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    page = rows.groupBy(F.expr("(rank - 1) div 5000").alias("page")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"])).alias("body"))
    body = F.when(F.col("page") % 2 == 0, F.col("body")).otherwise(F.concat(F.lit('{"odata": 1, "value": '), "body", F.lit("}")))
    stray = page.groupBy().agg((F.max("page") + 1).alias("page"), F.min("body").alias("value"))
    path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    page.select("page", body.alias("value")).unionByName(stray).write.partitionBy("page").option("lineSep", "\n").text(path)
    return pages.paged_catalog(spark, path, "struct<id:bigint,line:int,part:bigint>")
