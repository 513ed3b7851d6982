"""Steps that have to grow no faster than their input, and what copies of keys and names may not change."""

import pytest


@pytest.fixture
def nation(spark, tmp_path):
    """Tables of one nation: 1000 clubs, 30 organisations."""
    spark.sql("SELECT id AS c_custkey, concat('c', id) AS c_name, 1 AS c_nationkey, 0D AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(1000)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT id AS s_suppkey, concat('s', id % 10) AS s_name, 1 AS s_nationkey, 0D AS s_acctbal FROM range(30)").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_clubs_alike_are_scored_once(spark, nation):
    from sparkfacts.plans import derive

    assert derive._scored(spark, nation, derive._SCORE)[1].count() == 101 * 30
    assert derive.club_candidates(spark, nation).count() == 1000 * 30


@pytest.mark.parametrize("together", [256, 4])
def test_a_candidate_stands_in_rows_on_end(spark, nation, monkeypatch, together):
    """Equal values follow each other, which Parquet writes in next to nothing."""
    from sparkfacts.plans import derive

    monkeypatch.setattr(derive, "_TOGETHER", together)
    for query, columns in ((derive.club_candidates, ("org", "rank")), (derive.open_pairs, ("org", "score"))):
        rows = [tuple(r[c] for c in columns) for r in query(spark, nation).collect()]
        assert sum(x != y for x, y in zip(rows, rows[1:])) < len(rows) / (together if together < 9 else 4) * 1.6
    got = {(r.club, r.org): r.rank for r in derive.club_candidates(spark, nation).collect()}
    score = lambda club, org: (club * 7 + org * 13) % 101
    ranked = {c: sorted(range(30), key=lambda o: (-score(c, o), o % 3, o)) for c in range(0, 1000, 37)}
    assert len(got) == 30000 and all(got[c, o] == i + 1 for c, x in ranked.items() for i, o in enumerate(x))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_newest_capture_is_taken_before_people_meet_it(spark, nation):
    from sparkfacts.plans import forms

    df = forms.newest_captures(spark, nation)
    assert {r.c_custkey for r in df.collect()} == {998} and df.count() == 30
    assert plan(df).index("Join") < plan(df).index("Window")


def test_a_team_is_gathered_once(spark, nation):
    from sparkfacts.operators import profiles

    orgs = spark.sql("SELECT id AS org, id % 2 AS team FROM range(6)")
    none = spark.sql("SELECT 1L AS org, 'total_revenue' AS key, 2000 AS tax_year, 1BD AS amount, 'filed' AS status").limit(0)
    people = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (3, "c", 1.0)], "team long, name string, pay double")
    df = profiles.profiles(orgs, none, none, people, orgs.select("org").limit(0), "org", "team")
    assert {r.org: r.people for r in df.collect()} == {i: ["b", "a"] if i % 2 == 0 else None for i in range(6)}
    assert "Join" in plan(df).split("collect_list(struct(pay")[0]


def test_a_teams_text_is_made_once_and_its_organisations_lie_together(spark):
    from pyspark.sql import functions as F

    from sparkfacts.operators import profiles

    orgs = spark.sql("SELECT id AS org, nullif(id % 6, 5) AS team FROM range(3000)").repartition(7)
    none = spark.sql("SELECT 1L AS org, 'total_revenue' AS key, 2000 AS tax_year, 1BD AS amount, 'filed' AS status").limit(0)
    people = spark.sql("SELECT id % 4 AS team, concat('p', id) AS name, cast(id AS double) AS pay FROM range(400)")
    df = profiles.profiles(orgs, none, none, people, orgs.select("org").limit(0), "org", "team", "|")
    texts = {t: "|".join(f"p{i}" for i in range(399, -1, -1) if i % 4 == t) for t in range(4)}
    rows = df.select("org", "people", F.spark_partition_id().alias("part")).collect()
    assert {r.org: r.people for r in rows} == {i: texts.get(i % 6) for i in range(3000)}
    parts = {}
    for r in rows:
        parts.setdefault(r.part, []).append(r.people)
    # however many tasks there are, each has few of the texts and no more than its share of rows
    assert len(parts) >= 8 and max(len(set(x)) for x in parts.values()) <= 2 and max(map(len, parts.values())) <= 1000


def test_people_of_one_name_are_redacted_by_key(spark, nation):
    import duckdb

    from sparkfacts.plans import catalog, profile

    spark.sql("SELECT id AS o_orderkey, id % 9 AS o_custkey FROM range(40)").write.parquet(f"{nation}/orders.parquet")
    spark.sql("SELECT id % 40 AS l_orderkey, cast(1 AS int) AS l_linenumber, id % 31 AS l_suppkey, id AS l_partkey FROM range(90)").write.parquet(f"{nation}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "supplier"):
        con.sql(f"create view {t} as select * from '{nation}/{t}.parquet/*.parquet'")
    got = profile.redacted_activity(spark, nation).select("l_orderkey", "l_linenumber", "crew_label", "names").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.sql(catalog.SQL["redacted_activity"]).fetchall(), key=repr)


def test_copies_of_names_are_members_not_pairs(spark):
    from sparkfacts.operators import links

    names = ["lake club", "Club, Lake", "lake clubs", "river", "lake club", "", None, "river"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    rows = links.similar_classes(df).collect()
    first = {r.left_id: r.right_id for r in rows if r.member}
    assert first == {1: 0, 4: 0, 7: 3} and len(rows) == 8
    pairs = {(r.left_id, r.right_id): r.score for r in rows if not r.member}
    rep = {i: first.get(i, i) for i, n in enumerate(names) if n}
    opened = {(a, b): pairs[rep[a], rep[b]] for a in rep for b in rep if (rep[a], rep[b]) in pairs}
    assert opened == {(r.left_id, r.right_id): r.score for r in links.similar_names(df, df).collect()}


def test_lines_are_dealt_by_event_once(spark):
    from sparkfacts.plans import rated

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = rated.event_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # orders and customers by customer, what they make and the lines by event
    assert text.count("Exchange hashpartitioning") == 4


@pytest.mark.parametrize("shuffled", [False, True])
def test_divisions_without_a_value_are_fitted(spark, monkeypatch, shuffled):
    from sparkfacts.operators import ratings

    orders = [(None, 1, "ABC"), (None, 2, "BAC"), ("x", 3, "CAB"), ("x", 4, "ABCD"), ("x", 5, "DA")]
    rows = [(d, e, c, p + 1, len(o)) for d, e, o in orders for p, c in enumerate(o)]
    fields = spark.createDataFrame(rows, "kind string, event long, club string, pos int, n int")
    fitted = ratings.fit_large(fields, ["kind"], "event", "club", most_steps=2) if shuffled else ratings.fit(fields, ["kind"], "event", "club")
    got = {(r.kind, r.club): (r.s, r.steps) for r in fitted.collect()}
    if shuffled:
        monkeypatch.setattr(ratings, "MOST_STEPS", 2)
    want, pdf = {}, fields.toPandas()
    for d in (None, "x"):
        own = pdf[pdf.kind.isna() if d is None else pdf.kind == d]
        want |= {(d, r.club): (r.s, r.steps) for r in ratings.fit_group(own, "event", "club").itertuples()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_links_are_carried_where_their_page_is_read(spark):
    from sparkfacts.sources import pages

    date, kind, link = '<tr bgcolor="#FFCC00"><td>{}</td></tr>', '<span class="newscat2">{}</span>', '<a href="{}">{}</a>'
    one = link.format("/0", "no date") + date.format("May") + kind.format("A") + link.format("/0", "x") + kind.format("B") + link.format("/0", "again") + link.format("/1", "y &amp; z") + date.format("June") + link.format("/0", "w")
    df = spark.createDataFrame([(1, one), (2, link.format("/0", "other")), (3, None), (4, "no links")], "page long, html string")
    found = pages.directory_links(df, "page", "html")
    rows = sorted((r.page, r.pos, r.date, r.category, r.href, r.label) for r in found.collect())
    assert rows == [(1, 0, None, None, "/0", "no date"), (1, 3, "May", "A", "/0", "x"), (1, 6, "May", "B", "/1", "y & z"), (1, 8, "June", "B", "/0", "w"), (2, 0, None, None, "/0", "other")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
