"""Orders of events case by case; the fit by shuffles against the fit in one task; programs of organisations."""

import itertools

import pytest

ENTRY = "event string, club string, entry string, status string, ooc boolean, age_bracket string, position int, time_ms long, adjusted_time_ms long, adjusted_position int"


def orders(spark, rows):
    from sparkfacts.operators import ratings

    found = ratings.event_orders(spark.createDataFrame(rows, ENTRY)).collect()
    return {e: ("".join(r.club for r in sorted(g, key=lambda r: r.pos)), g[0].by_adjusted) for e in {r.event for r in found} for g in [[r for r in found if r.event == e]]}


def entry(event, club, position=None, time=None, adjusted=None, adjusted_position=None, status="Official", ooc=False, age="open", key="1"):
    return (event, club, key, status, ooc, age, position, time, adjusted, adjusted_position)


def test_event_orders(spark):
    rows = [
        # positions first, then times; a club stands at its best place
        entry("raw", "B", 2), entry("raw", "A", 1), entry("raw", "C", None, 90), entry("raw", "A", None, 10, key="2"), entry("raw", "D", None, 95),
        # out of competition, without a club, excluded
        entry("out", "A", 1, ooc=True), entry("out", "B", 2), entry("out", None, 3), entry("out", "C", 4, status="D.N.F. at 1000"), entry("out", "D", 5), entry("out", "E", 6),
        # too few are left
        entry("few", "A", 1), entry("few", "B", 2), entry("few", "C", 3, status="Scratched"), entry("few", "D"),
        # masters with all adjusted times; equal ones by adjusted place
        *(entry("full", c, p, 100, adj, ap, age="MASTERS") for c, p, adj, ap in (("A", 1, 90, None), ("B", 2, 80, 2), ("C", 3, 80, 1))),
        # one adjusted time is missing: raw order, and who has only an adjusted time is left out
        *(entry("part", c, p, None, adj, age="masters") for c, p, adj in (("A", 1, 90), ("B", 2, None), ("C", 3, 70), ("D", None, 1))),
        # adjusted times don't count elsewhere
        *(entry("open", c, p, None, adj) for c, p, adj in (("A", 1, 90), ("B", 2, 80), ("C", 3, 70))),
        # zero is no place and no time
        entry("zero", "A", 0, 50), entry("zero", "B", 0, 40), entry("zero", "C", 7), entry("zero", "D", 0, 0),
    ]
    assert orders(spark, rows) == {"raw": ("ABCD", False), "out": ("BDE", False), "full": ("CBA", True), "part": ("ABC", False), "open": ("ABC", False), "zero": ("CBA", False)}


def fields_of(spark):
    rows = []
    for d, (season, boat) in enumerate([(2024, "8+"), (2024, "2x"), (2025, None), (None, "8+")]):
        clubs = "ABCDE"[: 3 + d % 3]
        for e, order in enumerate(itertools.islice(itertools.permutations(clubs), 0, None, 1 + 2 * d)):
            rows += [(season, boat, f"{d}/{e}", c, p + 1, len(order)) for p, c in enumerate(order[: 3 if d < 3 else 5])]
    n = {}
    for r in rows:
        n[r[2]] = n.get(r[2], 0) + 1
    rows = [(*r[:5], n[r[2]]) for r in rows] + [(2026, "1x", "one", c, p, 3) for p, c in enumerate("XYZ", 1)]
    return spark.createDataFrame(rows, "season int, boat string, event string, club string, pos int, n int")


def test_fit_by_shuffles_is_the_fit_in_one_task(spark, monkeypatch):
    from sparkfacts.operators import ratings

    fields = fields_of(spark)
    key = lambda r: (str(r.season), str(r.boat), r.club)
    small = {key(r): r for r in ratings.fit(fields, ["season", "boat"], "event", "club").collect()}
    monkeypatch.setattr(ratings, "MOST_STEPS", 25)
    few = {}
    for d, pdf in fields.toPandas().groupby(["season", "boat"], dropna=False):
        for r in ratings.fit_group(pdf, "event", "club").itertuples():
            few[str(None if d[0] != d[0] else int(d[0])), str(None if d[1] != d[1] else d[1]), r.club] = r
    large = {key(r): r for r in ratings.fit_large(fields, ["season", "boat"], "event", "club", 1e-6, 25).collect()}
    assert few.keys() == large.keys() == small.keys()
    for k, r in large.items():
        assert r.s == pytest.approx(few[k].s, rel=1e-9) and (r.steps, r.converged) == (few[k].steps, few[k].converged)
        assert not r.converged or small[k].s == pytest.approx(r.s, rel=1e-6)


def test_converged_divisions_leave(spark):
    from sparkfacts.operators import ratings

    got = ratings.fit_large(fields_of(spark), ["season", "boat"], "event", "club", 0.2, 12).collect()
    steps = {(r.season, r.boat): (r.steps, r.converged) for r in got}
    assert len(steps) == 5 and all(c for _, c in steps.values()) and len({n for n, _ in steps.values()}) > 1


def test_large_divisions_by_size(spark, monkeypatch):
    from sparkfacts.operators import ratings

    seen = []

    def large(fields, *rest):
        seen.extend((r.season, r.boat) for r in fields.select("season", "boat").distinct().collect())
        return real(fields, *rest, 0.5, 1)

    real = ratings.fit_large
    monkeypatch.setattr(ratings, "fit_large", large)
    fields = fields_of(spark)
    sizes = {(r.season, r.boat): r["count"] for r in fields.groupBy("season", "boat").count().collect()}
    limit = sorted(sizes.values())[2]
    got = ratings.fit(fields, ["season", "boat"], "event", "club", limit)
    assert sorted(map(str, seen)) == sorted(str(k) for k, n in sizes.items() if n > limit)
    assert got.count() == fields.select("season", "boat", "club").distinct().count()
    assert ratings.fit(fields.limit(0), ["season", "boat"], "event", "club").collect() == [] == ratings.fit_large(fields.limit(0), ["season", "boat"], "event", "club").collect()


def test_programs(spark):
    from sparkfacts.operators import ratings

    rows = [(2024, f"e{e}", f"r{e % 2}", c, p + 1, 3, e == 0) for e, order in enumerate(["ABC", "ACB", "BAC", "BCA", "CAB", "CBA"]) for p, c in enumerate(order)]
    fields = spark.createDataFrame(rows, "season int, event string, regatta string, club string, pos int, n long, by_adjusted boolean")
    fitted = spark.createDataFrame([(2024, c, s, 9, True) for c, s in (("A", 1.0), ("B", 10.0), ("C", 0.1))] + [(2025, "A", 5.0, 200, False)], "season int, club string, s double, steps int, converged boolean")
    links = spark.createDataFrame([("A", "one"), ("B", "one"), ("C", "two"), ("Z", "three")], "club string, org string")
    programs = ratings.program_ratings(fields, fitted, links, ["season"])
    got = {r.org: r for r in programs.collect()}
    assert sorted(got) == ["one", "two"]
    one, two = got["one"], got["two"]
    assert (one.rating, one.n_fields, one.n_regattas, one.least_field, one.adjusted_fields, one.self_competition, one.eligible, one.sigma) == (1700.0, 6, 2, 3, 1, True, True, 0.408248)
    assert (two.rating, two.self_competition) == (1100.0, False)
    (c,) = ratings.rating_coverage(fields, fitted, programs, ["season"]).collect()
    assert (c.fields, c.clubs, c.programs, c.eligible_programs, c.converged) == (6, 3, 2, 2, True)
