"""Rank-ordered fields and Plackett-Luce ratings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excluded_status
from ..staging import forget, paths, written

# Fixed values of the fit: prior pseudo-count, tolerance of the largest log step, most iterations.
PRIOR = 0.1
TOLERANCE = 1e-6
MOST_STEPS = 200
# Rows of a division that one task fits; larger divisions are fitted by shuffles.
MOST_ROWS = 1 << 25
# Rows of fields of one size that a step takes at a time.
BLOCK = 1 << 18
# Fixed values of eligibility and of the display scale.
LEAST_FIELD, LEAST_FIELDS, LEAST_REGATTAS = 3, 5, 2
SCALE_MEAN, SCALE_FACTOR = 1500.0, 400.0


def ranked_fields(entries: DataFrame, event: str, club: str, order: list[Column], least: int = LEAST_FIELD) -> DataFrame:
    """(event, club, pos, n): each club once at its best place, fields of ``least`` clubs or more."""
    w = Window.partitionBy(event)
    placed = entries.withColumn("_at", F.row_number().over(w.orderBy(*order)))
    best = placed.groupBy(event, club).agg(F.min("_at").alias("_at"))
    ranked = best.withColumn("pos", F.row_number().over(w.orderBy("_at"))).withColumn("n", F.count("*").over(w))
    return ranked.filter(F.col("n") >= least).select(event, club, "pos", "n")


def event_orders(entries: DataFrame, least: int = LEAST_FIELD) -> DataFrame:
    """(event, club, pos, n, by_adjusted): the order of clubs of each event that has one.

    ``entries`` has event, club, entry, status, ooc, age_bracket, position, time_ms,
    adjusted_time_ms and adjusted_position. Entries without a club, out of competition or
    with an excluded status don't count. A masters event of which all entries that count
    have an adjusted time, and of which there are ``least``, is ordered by these; any other
    by position, then time, and entries with neither are left out. A club stands at its
    best place; events of fewer than ``least`` clubs have no order.
    """
    number = lambda c: F.col(c).cast("double")
    positive, last = lambda c: F.coalesce(number(c) > 0, F.lit(False)), F.lit(float("inf"))
    counted = entries.filter(F.col("club").isNotNull() & ~F.coalesce("ooc", F.lit(False)) & ~F.coalesce(excluded_status(F.col("status")), F.lit(False)))
    marked = adjusted_mode(counted, "event", F.lower("age_bracket") == "masters", number("adjusted_time_ms"), least)
    usable = marked.filter(F.col("by_adjusted") | positive("position") | positive("time_ms"))
    placed, time = positive("position"), F.coalesce(number("time_ms"), last)
    order = [
        (~F.col("by_adjusted") & ~placed).cast("int"),
        F.when(F.col("by_adjusted"), number("adjusted_time_ms")).when(placed, number("position")).otherwise(time),
        F.when(F.col("by_adjusted"), F.coalesce(number("adjusted_position"), last)).when(placed, time).otherwise(last),
        F.col("club").cast("string"), F.coalesce(F.col("entry").cast("string"), F.lit("")),
    ]
    w = Window.partitionBy("event")
    best = usable.withColumn("_at", F.row_number().over(w.orderBy(*order))).groupBy("event", "club").agg(F.min("_at").alias("_at"), F.first("by_adjusted").alias("by_adjusted"))
    ranked = best.withColumn("pos", F.row_number().over(w.orderBy("_at"))).withColumn("n", F.count("*").over(w))
    return ranked.filter(F.col("n") >= least).select("event", "club", "pos", "n", "by_adjusted")


def adjusted_mode(entries: DataFrame, event: str, masters: Column, adjusted: Column, least: int = LEAST_FIELD) -> DataFrame:
    """Marks events ranked by adjusted times: masters, large enough, and every entry has one."""
    w = Window.partitionBy(event)
    full = F.min((F.coalesce(adjusted, F.lit(0)) > 0).cast("int")).over(w) == 1
    return entries.withColumn("by_adjusted", F.coalesce(masters, F.lit(False)) & full & (F.count("*").over(w) >= least))


def pl_step(fields: DataFrame, strength: DataFrame, event: str, club: str) -> DataFrame:
    """One minorise-maximise step: (club, s). Choice stages are all places but the last."""
    w = Window.partitionBy(event).orderBy("pos")
    joined = fields.join(strength, club)
    below = F.sum("s").over(w.rowsBetween(0, Window.unboundedFollowing))
    stage = joined.withColumn("_stage", F.when(F.col("pos") < F.col("n"), 1 / below).otherwise(0.0))
    weight = F.sum("_stage").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stage.withColumn("_w", weight).groupBy(club).agg(((F.sum((F.col("pos") < F.col("n")).cast("int")) + PRIOR) / (F.sum("_w") + PRIOR)).alias("s"))


def pl_steps(fields: DataFrame, event: str, club: str, steps: int) -> DataFrame:
    """A fixed number of distributed steps from equal strengths."""
    s = fields.select(club).distinct().withColumn("s", F.lit(1.0))
    for _ in range(steps):
        s = pl_step(fields, s, event, club)
    return s


def _fit(who: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, int, bool]:
    """(strengths, steps, converged) of n clubs: ``who`` has the clubs of one field after another, best first.

    Fields of one size are the rows of matrices of about BLOCK cells, so that sums stay
    within a field and a step needs little beside four bytes a club of a field.
    """
    first = np.cumsum(sizes) - sizes
    blocks = []
    for k in np.unique(sizes):
        at = first[sizes == k]
        each = max(1, BLOCK // int(k))
        blocks += [who[at[i : i + each, None] + np.arange(k)].astype(np.int32) for i in range(0, len(at), each)]
    wins, s = np.zeros(n), np.ones(n)
    for x in blocks:
        wins += np.bincount(x[:, :-1].ravel(), minlength=n)
    for step in range(1, MOST_STEPS + 1):
        weight = np.zeros(n)
        for x in blocks:
            inverse = 1 / np.cumsum(s[x[:, ::-1]], axis=1)[:, ::-1]
            inverse[:, -1] = 0.0
            weight += np.bincount(x.ravel(), np.cumsum(inverse, axis=1).ravel(), n)
        new = (wins + PRIOR) / (weight + PRIOR)
        moved = np.abs(np.log(new / s)).max()
        s = new
        if moved < TOLERANCE:
            break
    return s, step, bool(moved < TOLERANCE)


def fit_group(pdf: pd.DataFrame, event: str, club: str) -> pd.DataFrame:
    """Fit of one division: strengths, steps and whether it converged."""
    pdf = pdf.sort_values([event, "pos"])
    clubs, who = np.unique(pdf[club].to_numpy(), return_inverse=True)
    first = np.flatnonzero(np.r_[True, pdf[event].to_numpy()[1:] != pdf[event].to_numpy()[:-1]])
    s, step, converged = _fit(who, np.diff(np.r_[first, len(pdf)]), len(clubs))
    return pd.DataFrame({club: clubs, "s": s, "steps": step, "converged": converged})


def fit_large(fields: DataFrame, division: list[str], event: str, club: str, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS) -> DataFrame:
    """Fits divisions of any size by shuffles only; (division, club, s, steps, converged).

    Fields are held once by (number of the division, club). A step joins strengths, takes
    two running sums over each event and one sum by club, and is written; then each
    division's greatest log step (one row a division) tells which have converged. Those
    leave: the next step joins the strengths of the others only.
    """
    spark, kinds = fields.sparkSession, dict(fields.dtypes)
    # divisions by number: one row a division, written, so that numbers stay
    names = written(fields.select(*(F.col(c).alias(f"_{c}") for c in division)).distinct().withColumn("_d", F.monotonically_increasing_id()), "divisions")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in division))
    own = fields.join(F.broadcast(names), same).select("_d", F.col(event).alias("_event"), F.col(club).alias("_club"), "pos", "n")
    # held where strengths join it: a step shuffles strengths, fields with them, and sums by club
    work = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_d", "_club").persist(StorageLevel.DISK_ONLY)
    strength = work.select("_d", "_club").distinct().withColumn("s", F.lit(1.0))
    w = Window.partitionBy("_d", "_event").orderBy("pos")
    out, last = [], None
    for step in range(1, most_steps + 1):
        below = F.sum("s").over(w.rowsBetween(0, Window.unboundedFollowing))
        chosen = F.col("pos") < F.col("n")
        stages = work.join(strength, ["_d", "_club"]).withColumn("_stage", F.when(chosen, 1 / below).otherwise(0.0))
        exposed = stages.withColumn("_w", F.sum("_stage").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        new = exposed.groupBy("_d", "_club").agg(((F.sum(chosen.cast("int")) + PRIOR) / (F.sum("_w") + PRIOR)).alias("s"), F.max("s").alias("_old"))
        table = written(new.withColumn("_moved", F.abs(F.ln(F.col("s") / F.col("_old")))).drop("_old"), "strength")
        path = paths(spark)[-1]
        moved = table.groupBy("_d").agg(F.max("_moved").alias("_most"))
        done = F.col("_most") < tolerance
        n = moved.agg(F.count(F.when(done, 1)).alias("done"), F.count(F.when(~done, 1)).alias("open")).first()
        ends = step == most_steps
        if n.done or ends:
            finished = table.join(moved.filter(F.lit(ends) | done), "_d")
            out.append(finished.select("_d", "_club", "s", F.lit(step).alias("steps"), done.alias("converged")))
        strength = table.join(moved.filter(~done), "_d", "left_semi").select("_d", "_club", "s")
        if last:  # nothing reads the step before any more
            forget(spark, last)
        last = None if n.done or ends else path
        if not n.open:
            break
    work.unpersist()
    if not out:
        return spark.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in [*division, club]) + ", s double, steps int, converged boolean")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.join(F.broadcast(names), "_d").select(*(F.col(f"_{c}").alias(c) for c in division), F.col("_club").alias(club), "s", "steps", "converged")


def fit(fields: DataFrame, division: list[str], event: str, club: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """The fit of each division (season, boat, age, gender): (division, club, s, steps, converged).

    Divisions of up to ``most_rows`` rows are fitted in a task each, by arrays of four bytes
    a row; larger ones by ``fit_large``; both take the same steps. Fields are written once,
    a row an event. Of large divisions there are at most as many as ``most_rows`` goes into
    all rows, so their keys are broadcast.
    """
    kinds = dict(fields.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*division, club]) + ", s double, steps int, converged boolean"

    def run(key, table):
        lists = table.column("_clubs")
        coded = pa.chunked_array([x.flatten() for x in lists.chunks]).combine_chunks().dictionary_encode()
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists.chunks])
        n = len(coded.dictionary)
        s, step, converged = _fit(coded.indices.to_numpy(), sizes, n)
        ends = {"s": pa.array(s), "steps": pa.array(np.full(n, step, np.int32)), "converged": pa.array(np.full(n, converged))}
        return pa.table({**{c: pa.repeat(v, n) for c, v in zip(division, key)}, club: coded.dictionary, **ends})

    clubs = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(club).alias("_club")))), lambda x: x["_club"])
    packed = written(fields.groupBy(*division, event).agg(clubs.alias("_clubs")), "fields").withColumn("_d", F.struct(*division))
    large = written(packed.groupBy("_d").agg(F.sum(F.size("_clubs")).alias("_n")).filter(F.col("_n") > most_rows).select("_d"), "large_divisions")
    small = packed.join(F.broadcast(large), "_d", "left_anti").select(*division, "_clubs")
    fitted = small.groupBy(*division).applyInArrow(run, schema)
    if large.isEmpty():
        return fitted
    apart = packed.join(F.broadcast(large), "_d", "left_semi").select(*division, event, F.size("_clubs").alias("n"), F.posexplode("_clubs").alias("_at", club))
    return fitted.unionByName(fit_large(apart.withColumn("pos", F.col("_at") + 1).drop("_at"), division, event, club))


def display(strength: DataFrame, division: list[str]) -> DataFrame:
    """1500 at a division's geometric mean, 400 a decade."""
    centre = strength.groupBy(*division).agg(F.avg(F.ln("s")).alias("_centre"))
    # one row a division, a single row without any
    joined = strength.join(centre, division) if division else strength.join(F.broadcast(centre))
    return joined.withColumn("rating", SCALE_MEAN + SCALE_FACTOR * F.log10(F.col("s") / F.exp("_centre"))).drop("_centre")


def eligible(coverage: DataFrame) -> DataFrame:
    """Marks programs with enough fields, regattas and boats in the smallest field."""
    ok = (F.col("n_fields") >= LEAST_FIELDS) & (F.col("n_regattas") >= LEAST_REGATTAS) & (F.col("least_field") >= LEAST_FIELD)
    return coverage.withColumn("eligible", ok).withColumn("sigma", F.round(1 / F.sqrt("n_fields"), 6))


def weighted_rating(rows: DataFrame, org: str) -> DataFrame:
    """Mean rating of an organisation's clubs, weighted by appearances."""
    return rows.groupBy(org).agg((F.sum(F.col("rating") * F.col("n")) / F.sum("n")).alias("rating"), F.sum("n").cast("long").alias("n"))


def program_ratings(fields: DataFrame, fitted: DataFrame, links: DataFrame, division: list[str]) -> DataFrame:
    """One row for each (division, org) of a converged division: rating, sigma, coverage, eligibility.

    ``fields`` has division, event, regatta, club, n and by_adjusted; ``links`` one org a
    club. The rating is the mean of the clubs' display ratings over their appearances.
    """
    rated = display(fitted.filter("converged"), division).select(*division, "club", "rating")
    linked = fields.join(rated, [*division, "club"]).join(links.select("club", "org"), "club")
    # by event first: a field counts once, however many of its clubs are the organisation's
    met = linked.groupBy(*division, "org", "event", "regatta").agg(F.sum("rating").alias("_sum"), F.count("*").alias("_clubs"), F.max("n").alias("n"), F.max(F.col("by_adjusted").cast("int")).alias("_adjusted"))
    rows = met.groupBy(*division, "org").agg(
        (F.sum("_sum") / F.sum("_clubs")).alias("rating"), F.count("*").alias("n_fields"), F.countDistinct("regatta").alias("n_regattas"), F.min("n").alias("least_field"),
        F.sum("_adjusted").alias("adjusted_fields"), (F.max("_clubs") > 1).alias("self_competition"),
    )
    return eligible(rows).withColumn("rating", F.round("rating", 6))


def rating_coverage(fields: DataFrame, fitted: DataFrame, programs: DataFrame, division: list[str]) -> DataFrame:
    """One row a division: fields, clubs, linked and eligible programs, whether the fit converged (those that didn't are for review)."""
    events = fields.groupBy(*division).agg(F.countDistinct("event").alias("fields"))
    clubs = fitted.groupBy(*division).agg(F.count("*").alias("clubs"), F.first("steps").alias("steps"), F.first("converged").alias("converged"))
    linked = programs.groupBy(*division).agg(F.count("*").alias("programs"), F.count(F.when(F.col("eligible"), 1)).alias("eligible_programs"))
    return events.join(clubs, division).join(linked, division, "left").fillna(0, ["programs", "eligible_programs"])
