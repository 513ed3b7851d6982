"""Ratings from entries to organisations, the fit to convergence said in recursive SQL.

An order is a race event, a customer a regatta, a line an entry of the club of its
supplier. Divisions are (year, priority, segment, order status); one segment is masters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links, ratings
from ..session import table
from ..staging import written
from .catalog import _FIELDS, SQL, query

DIVISION = ["season", "boat", "age", "gender"]
_ENTRIES = """WITH RECURSIVE entries AS (
  SELECT l_orderkey AS event, CASE WHEN l_quantity <> 50 THEN l_suppkey END AS club, CAST(l_linenumber AS VARCHAR) || '/' || l_partkey AS entry, o_custkey AS regatta,
    CAST(year(o_orderdate) AS INT) AS season, o_orderpriority AS boat, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Masters' ELSE lower(c_mktsegment) END AS age, o_orderstatus AS gender,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'D.N.F.' WHEN l_tax = 0.08 THEN 'scratched late' ELSE l_returnflag || ' official' END AS status, l_discount = 0.1 AS ooc,
    CASE WHEN l_tax >= 0.02 THEN l_linenumber END AS position, CASE WHEN l_quantity >= 10 THEN CAST(l_extendedprice AS BIGINT) END AS time_ms,
    CASE WHEN l_discount > 0 THEN CAST(l_extendedprice AS BIGINT) - CAST(l_quantity AS BIGINT) * 100 END AS adjusted_time_ms, CASE WHEN l_tax < 0.05 THEN l_linenumber END AS adjusted_position
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""


_DIVISION = ("year(o_orderdate) AS season", "o_orderpriority AS boat", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Masters' ELSE lower(c_mktsegment) END AS age", "o_orderstatus AS gender")


def _races(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))


def _entries(spark, d):
    # the lines come last, dealt by their event once, as its order, fields and fit need them
    rows = _races(spark, d).join(table(spark, d, "lineitem"), F.expr("l_orderkey = o_orderkey"))
    return rows.selectExpr(
        "l_orderkey AS event", "CASE WHEN l_quantity <> 50 THEN l_suppkey END AS club", "concat(l_linenumber, '/', l_partkey) AS entry", "o_custkey AS regatta",
        *_DIVISION,
        "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'D.N.F.' WHEN l_tax = 0.08D THEN 'scratched late' ELSE concat(l_returnflag, ' official') END AS status", "l_discount = 0.1D AS ooc",
        "CASE WHEN l_tax >= 0.02D THEN l_linenumber END AS position", "CASE WHEN l_quantity >= 10 THEN cast(round(l_extendedprice) AS bigint) END AS time_ms",
        "CASE WHEN l_discount > 0 THEN cast(round(l_extendedprice) AS bigint) - cast(l_quantity AS bigint) * 100 END AS adjusted_time_ms", "CASE WHEN l_tax < 0.05D THEN l_linenumber END AS adjusted_position",
    ).withColumn("age_bracket", F.col("age"))


_ORDERS = _ENTRIES + """, counted AS (
  SELECT *, age = 'Masters' AND count(*) OVER e >= 3 AND min(CASE WHEN coalesce(adjusted_time_ms, 0) > 0 THEN 1 ELSE 0 END) OVER e = 1 AS by_adjusted
  FROM entries WHERE club IS NOT NULL AND NOT ooc AND status NOT IN ('D.N.F.', 'scratched late') WINDOW e AS (PARTITION BY event)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY event ORDER BY CASE WHEN by_adjusted OR position > 0 THEN 0 ELSE 1 END,
    CASE WHEN by_adjusted THEN adjusted_time_ms WHEN position > 0 THEN position ELSE time_ms END,
    CASE WHEN by_adjusted THEN coalesce(adjusted_position, 999999999999) WHEN position > 0 THEN coalesce(time_ms, 999999999999) ELSE 999999999999 END, CAST(club AS VARCHAR), entry) AS place
  FROM counted WHERE by_adjusted OR coalesce(position, 0) > 0 OR coalesce(time_ms, 0) > 0
), best AS (
  SELECT event, club, min(place) AS place, any_value(by_adjusted) AS by_adjusted, any_value(regatta) AS regatta, any_value(season) AS season, any_value(boat) AS boat, any_value(age) AS age, any_value(gender) AS gender FROM placed GROUP BY event, club
), fields AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY event ORDER BY place) AS INT) AS pos, count(*) OVER (PARTITION BY event) AS n FROM best QUALIFY n >= 3
)"""


def _fields(spark, d):
    events = _races(spark, d).selectExpr("o_orderkey AS event", "o_custkey AS regatta", *_DIVISION).dropDuplicates(["event"])
    return ratings.event_orders(_entries(spark, d)).join(events, "event")


@query(_ORDERS + " SELECT event, club, pos, n, by_adjusted FROM fields")
def event_orders(spark, d):
    return ratings.event_orders(_entries(spark, d))


def _fit_sql(tolerance: float, steps: int, keys: str = ", ".join(DIVISION)) -> str:
    return f""", fit AS (
  SELECT {keys}, club, CAST(0 AS INT) AS steps, CAST(1 AS DOUBLE) AS s, CAST(1 AS DOUBLE) AS moved FROM fields GROUP BY ALL
  UNION ALL
  SELECT {keys}, club, steps, s, max(abs(ln(s / old))) OVER (PARTITION BY {keys}) FROM (
    SELECT {keys}, club, any_value(steps) + 1 AS steps, any_value(s) AS old, (sum(CASE WHEN pos < n THEN 1 ELSE 0 END) + 0.1::DOUBLE) / (sum(w) + 0.1::DOUBLE) AS s FROM (
      SELECT *, sum(stage) OVER (PARTITION BY event ORDER BY pos ROWS UNBOUNDED PRECEDING) AS w FROM (
        SELECT f.*, r.steps, r.s, CASE WHEN pos < n THEN 1 / sum(s) OVER (PARTITION BY event ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE 0 END AS stage
        FROM fields f JOIN fit r USING ({keys}, club) WHERE r.moved >= {tolerance} AND r.steps < {steps}))
    GROUP BY {keys}, club)
), fitted AS (SELECT {keys}, club, s, steps, moved < {tolerance} AS converged FROM fit WHERE steps > 0 AND (moved < {tolerance} OR steps = {steps}))"""


@query(_ORDERS + _fit_sql(ratings.TOLERANCE, ratings.MOST_STEPS) + " SELECT season, boat, age, gender, club, round(s, 6) AS s, steps, converged FROM fitted")
def pl_fit_divisions(spark, d):
    """The fit of each division to convergence, or to its last step."""
    return ratings.fit(_fields(spark, d), DIVISION, "event", "club").withColumn("s", F.round("s", 6))


SQL["pl_fit"] = (
    _FIELDS.replace("WITH r AS", "WITH RECURSIVE r AS").replace("fields AS (", "unseasoned AS (")
    + ", fields AS (SELECT u.*, CAST(year(o_orderdate) AS INT) AS season FROM unseasoned u JOIN orders ON o_orderkey = event)"
    + _fit_sql(ratings.TOLERANCE, ratings.MOST_STEPS, "season") + " SELECT season, club, round(s, 4) AS s, steps, converged FROM fitted"
)


@query(_ORDERS + _fit_sql(0.02, 8) + " SELECT season, boat, age, gender, club, round(s, 6) AS s, steps, converged FROM fitted")
def pl_fit_shuffled(spark, d):
    """The same steps by shuffles only, as for divisions that outgrow a task; a wide tolerance, so that some converge in few steps."""
    return ratings.fit_large(_fields(spark, d), DIVISION, "event", "club", 0.02, 8).withColumn("s", F.round("s", 6))


_LINKED = """, candidates AS (
  SELECT s_suppkey AS club, s_nationkey AS org FROM supplier WHERE s_acctbal >= 0
  UNION SELECT p_partkey, p_size % 25 FROM part WHERE p_type = 'ECONOMY' AND p_partkey <= (SELECT max(s_suppkey) FROM supplier)
), links AS (SELECT club, min(org) AS org FROM candidates GROUP BY club HAVING count(DISTINCT org) = 1)"""
_PROGRAMS = _ORDERS + _fit_sql(ratings.TOLERANCE, ratings.MOST_STEPS) + _LINKED + """, rated AS (
  SELECT *, 1500 + 400 * log10(s / exp(avg(ln(s)) OVER (PARTITION BY season, boat, age, gender))) AS rating FROM fitted WHERE converged
), met AS (
  SELECT season, boat, age, gender, org, event, regatta, sum(rating) AS total, count(*) AS clubs, max(n) AS n, max(CASE WHEN by_adjusted THEN 1 ELSE 0 END) AS adjusted
  FROM fields JOIN rated USING (season, boat, age, gender, club) JOIN links USING (club) GROUP BY ALL
), programs AS (
  SELECT season, boat, age, gender, org, round(sum(total) / sum(clubs), 6) AS rating, count(*) AS n_fields, count(DISTINCT regatta) AS n_regattas, min(n) AS least_field, CAST(sum(adjusted) AS BIGINT) AS adjusted_fields, max(clubs) > 1 AS self_competition,
    count(*) >= 5 AND count(DISTINCT regatta) >= 2 AND min(n) >= 3 AS eligible, round(1 / sqrt(count(*)), 6) AS sigma FROM met GROUP BY ALL
)"""


def _programs(spark, d):
    # both are read several times
    fields = written(_fields(spark, d), "rated_fields")
    fitted = written(ratings.fit(fields, DIVISION, "event", "club"), "fitted")
    supplier = table(spark, d, "supplier")
    most = supplier.agg(F.max("s_suppkey").alias("_most"))
    named = table(spark, d, "part").filter("p_type = 'ECONOMY'").join(F.broadcast(most), F.expr("p_partkey <= _most")).selectExpr("p_partkey AS club", "p_size % 25 AS org")
    found = links.link_candidates(supplier.filter("s_acctbal >= 0").selectExpr("s_suppkey AS club", "s_nationkey AS org"), named)
    return fields, fitted, ratings.program_ratings(fields, fitted, links.unambiguous(found, "club", "org"), DIVISION)


@query(_PROGRAMS + " SELECT * FROM programs")
def program_ratings(spark, d):
    """Entries to organisations: statuses, order, fit, links, eligibility."""
    return _programs(spark, d)[2]


@query(_PROGRAMS + """ SELECT f.*, c.clubs, c.steps, c.converged, coalesce(p.programs, 0) AS programs, coalesce(p.eligible_programs, 0) AS eligible_programs
FROM (SELECT season, boat, age, gender, count(DISTINCT event) AS fields FROM fields GROUP BY ALL) f
JOIN (SELECT season, boat, age, gender, count(*) AS clubs, any_value(steps) AS steps, any_value(converged) AS converged FROM fitted GROUP BY ALL) c USING (season, boat, age, gender)
LEFT JOIN (SELECT season, boat, age, gender, count(*) AS programs, count(*) FILTER (WHERE eligible) AS eligible_programs FROM programs GROUP BY ALL) p USING (season, boat, age, gender)""")
def rating_coverage(spark, d):
    """One row a division; those that didn't converge have no programs and are for review."""
    return ratings.rating_coverage(*_programs(spark, d), DIVISION)
