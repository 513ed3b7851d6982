"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from sparkfacts.plans import catalog, more  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(rows, columns):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(float(r[i]), 9) if isinstance(r[i], float) else r[i] if r[i] is None or isinstance(r[i], (int, bool)) else str(r[i]) for i in by) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    df, want = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def plain_fit(rows, most):
    """Strengths, steps and whether the last step moved none by 1e-6, by the formula of one club at a time."""
    import math

    events = {e: [c for f, c, _, _ in sorted(rows, key=lambda r: r[2]) if f == e] for e, *_ in rows}
    s, moved, n = {c: 1.0 for _, c, *_ in rows}, 1.0, 0
    while moved >= 1e-6 and n < most:
        new = {}
        for c in s:
            own = [o for o in events.values() if c in o]
            wins = sum(o[-1] != c for o in own)
            exposed = sum(1 / sum(s[x] for x in o[k:]) for o in own for k in range(min(o.index(c) + 1, len(o) - 1)))
            new[c] = (wins + 0.1) / (exposed + 0.1)
        moved, s, n = max(abs(math.log(new[c] / s[c])) for c in s), new, n + 1
    return s, n, moved < 1e-6


def test_full_fit_agrees_with_steps(spark):
    from sparkfacts.operators import ratings

    rows = [(e, c, p + 1, 3) for e, order in enumerate(["ABC", "ACB", "BAC", "BCA", "CAB", "CBA", "ABC"]) for p, c in enumerate(order)]
    fields = spark.createDataFrame(rows, "event int, club string, pos int, n int")
    steps = {r.club: r.s for r in ratings.pl_steps(fields, "event", "club", 12).collect()}
    fitted = ratings.fit_group(fields.toPandas(), "event", "club")
    assert [c for c in sorted(steps, key=steps.get)] == list(fitted.sort_values("s").club)
    # the weak prior pulls the common scale in slowly: seven fields use up all steps, one field converges
    full = {r.club: r.s for r in ratings.pl_steps(fields.coalesce(1), "event", "club", 3).collect()}
    assert plain_fit(rows, 3)[0] == pytest.approx(full)
    for few, done in ((rows, False), (rows[:3], True)):
        want, n, converged = plain_fit(few, ratings.MOST_STEPS)
        got = ratings.fit_group(fields.toPandas().iloc[: len(few)], "event", "club")
        assert dict(zip(got.club, got.s)) == pytest.approx(want) and set(got.steps) == {n} and set(got.converged) == {converged} == {done}


def test_one_step_by_hand(spark):
    from sparkfacts.operators import ratings

    one = spark.createDataFrame([(1, "A", 1, 3), (1, "B", 2, 3), (1, "C", 3, 3)], "event int, club string, pos int, n int")
    got = {r.club: round(r.s, 6) for r in ratings.pl_steps(one, "event", "club", 1).collect()}
    assert got == {"A": 2.538462, "B": 1.178571, "C": 0.107143}


def test_similar_names_lose_no_pair(spark):
    import difflib
    import random

    random.seed(1)
    words = ["row", "rowing", "club", "crew", "boat", "lake", "lakes", "harbor", "harbour", "oars", "st", "x"]
    name = lambda: " ".join(random.sample(words, random.randint(1, 4)))
    a, b = [(i, name()) for i in range(40)], [(i, name()) for i in range(60)]
    from sparkfacts.operators.links import similar_names

    df = lambda rows: spark.createDataFrame(rows, "id long, name string")
    got = {(r.left_id, r.right_id): r.score for r in similar_names(df(a), df(b)).collect()}
    sort = lambda x: " ".join(sorted(set(x.split())))
    want = {(i, j): round(s, 4) for i, x in a for j, y in b if (s := difflib.SequenceMatcher(None, sort(x), sort(y)).ratio()) >= 0.6}
    assert got == want
