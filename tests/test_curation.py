"""Filing precedence, decisions, names: case by case."""

import random
import unicodedata

import pytest


def chain(spark, staged, stored):
    from sparkfacts.operators import derive

    cols = "ein string, period_end string, form string, object_id string, amended boolean"
    rows, tasks = derive.filing_chain(spark.createDataFrame(staged, cols), spark.createDataFrame(stored, cols + ", authoritative boolean"), ["ein", "period_end", "form"])
    return {r.object_id: r.authoritative for r in rows.collect()}, [(r.object_id, r.outranks) for r in tasks.collect()]


def test_filing_precedence(spark):
    key = ("1", "2020-06-30", "990")
    # nothing stored: the amended one, then the greatest object_id as text
    assert chain(spark, [(*key, "100", False), (*key, "90", False)], []) == ({"100": False, "90": True}, [])
    assert chain(spark, [(*key, "100", True), (*key, "90", False)], []) == ({"100": True, "90": False}, [])
    # a stored authoritative original, an amendment arrives: both are, for review
    assert chain(spark, [(*key, "05", True)], [(*key, "09", False, True)]) == ({"05": True}, [("05", "09")])
    # a stored amendment of a greater id: the staged one loses, no review
    assert chain(spark, [(*key, "05", True)], [(*key, "09", True, True)]) == ({"05": False}, [])
    # a stored one that comes first but isn't authoritative still comes first
    assert chain(spark, [(*key, "05", False)], [(*key, "09", False, False)]) == ({"05": False}, [])
    # a later original outranks a stored original, without review; one not authoritative needs none either
    assert chain(spark, [(*key, "10", False)], [(*key, "09", False, True)]) == ({"10": True}, [])
    assert chain(spark, [(*key, "10", True)], [(*key, "09", False, False)]) == ({"10": True}, [])
    # the best stored one counts, not any authoritative one
    assert chain(spark, [(*key, "07", True)], [(*key, "01", False, True), (*key, "05", True, False)]) == ({"07": True}, [])
    # stored already: not again, and others of its key stay behind it
    assert chain(spark, [(*key, "09", True), (*key, "08", True)], [(*key, "09", True, True)]) == ({"08": False}, [])
    # other keys don't meet
    assert chain(spark, [("2", *key[1:], "1", False), ("1", key[1], "990EZ", "2", False)], [(*key, "9", True, True)]) == ({"1": True, "2": True}, [])
    assert chain(spark, [(None, *key[1:], "1", False)], [(None, *key[1:], "9", False, True)]) == ({"1": True}, [])


def test_replay(spark):
    from sparkfacts.operators import curation

    decisions = [("a", 1, "x", "reject"), ("b", 2, "x", "reject"), ("c", 3, "x", "link"), ("d", 4, "x", "link"), ("e", 5, "x", "link"), ("f", 6, "x", "link"), ("f", 7, "x", "link"), ("f", 8, "y", "link"), ("g", 9, "x", "reject"), ("g", 10, "y", "link"), ("h", 11, "z", "link")]
    owners = [("c", "x"), ("d", "x"), ("h", "x")]
    tasks = [("a", 1, "open"), ("a", 2, "open"), ("a", 3, "resolved"), ("c", 4, "open"), ("g", 5, "open"), ("h", 6, "open"), ("z", 7, "open")]
    audit, after = curation.replay(
        spark.createDataFrame(decisions, "club string, pos int, org string, action string"), spark.createDataFrame(owners, "club string, org string"), spark.createDataFrame(tasks, "club string, task int, status string")
    )
    got = {r.pos: r.outcome for r in audit.collect()}
    assert got == {1: "rejected", 2: "unchanged", 3: "promoted", 4: "unchanged", 5: "promoted", 6: "promoted", 7: "unchanged", 8: "conflict", 9: "rejected", 10: "promoted", 11: "conflict"}
    assert {r.task: (r.status, r.rejected_org) for r in after.collect()} == {
        1: ("dismissed", "x"), 2: ("dismissed", "x"), 3: ("resolved", None), 4: ("resolved", None), 5: ("dismissed", "x"), 6: ("open", None), 7: ("open", None),
    }


def test_registry_bound_is_inclusive(spark):
    from sparkfacts.operators import curation

    rows = spark.createDataFrame([("a", "1", 0.85), ("a", "2", 0.8499), ("a", "3", 0.9)], "club string, ein string, score double")
    assert sorted(r.ein for r in curation.proposed_registry(rows).collect()) == ["1", "3"]


def plain_words(x):
    folded = unicodedata.normalize("NFKC", x or "").casefold()
    return {w for w in "".join(c for c in folded if c.isalnum() or c == "_" or c.isspace()).split()}


@pytest.mark.parametrize("share", [None, (1, 1), (2, 3)])
def test_contained_names(spark, monkeypatch, share):
    from sparkfacts.operators import curation

    if share:
        monkeypatch.setattr(curation, "NAMES_A_SHARE", share[0])
        monkeypatch.setattr(curation, "VALUES_A_SHARE", share[1])
    rng = random.Random(1)
    word = lambda: rng.choice(["lee", "LEE", "josé", "josé", "núñez", "ß", "straße", "李", "雷", "ｏｎｅ", "one", "x-1", "o'neil", "a", "b", "c", "٣"])
    people = [(i, rng.choice([" ", ", ", "　"]).join(word() for _ in range(rng.randint(1, 3)))) for i in range(60)] + [(60, None), (61, ""), (62, "!?"), (63, "Núñez, José"), (64, "李 雷"), (65, "absent lee")]
    values = [(i, " ".join(word() for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(60, "stroke jos n ez x"), (61, "JOSÉ NŨÑEZ (bow)".replace("̃", "̃")), (62, None), (63, "雷、李"), (64, "雷 (李)"), (65, "")]
    got = {(r.value_id, r.person_id) for r in curation.contained_names(spark.createDataFrame(people, "person_id int, name string"), spark.createDataFrame(values, "value_id int, value string")).collect()}
    want = {(v, p) for p, n in people for v, t in values if (w := plain_words(n)) and w <= plain_words(t)}
    assert got == want and (64, 64) in got and not any(v == 60 for v, _ in got)


@pytest.mark.parametrize("sent", [True, False])
def test_contained_names_of_ids_that_repeat(spark, monkeypatch, sent):
    """Values and names are told apart though their ids repeat; names that meet values by broadcast or by shuffles give the same pairs, each once."""
    from sparkfacts.operators import curation

    if not sent:
        for bound in ("SENT_NAMES", "SENT_WORDS", "SENT_PEOPLE"):
            monkeypatch.setattr(curation, bound, 0)
    people = [(1, "Ann Lee"), (1, "lee"), (1, "LEE, Ann"), (2, "Ann Ray"), (3, "Lee Ann")]
    values = [(7, "lee"), (7, "ann"), (7, "Lee lee ann"), (8, "ann lee ray"), (9, "ray"), (None, "lee")]
    rows = curation.contained_names(spark.createDataFrame(people, "person_id int, name string"), spark.createDataFrame(values, "value_id int, value string"))
    assert sorted(tuple(r) for r in rows.filter("value_id is not null").collect()) == [(7, 1), (7, 3), (8, 1), (8, 2), (8, 3)]


def test_contained_names_sends_numbers_of_names_alone(spark):
    """What is kept of a value are numbers of words that names hold, so that a pair is tested on few of them."""
    from sparkfacts import staging
    from sparkfacts.operators import curation

    since = len(staging.paths(spark))
    values = [(i, " ".join(f"w{j}" for j in range(500)) + " ann") for i in range(20)]
    found = curation.contained_names(spark.createDataFrame([(1, "Ann W3"), (2, "Zed")], "person_id int, name string"), spark.createDataFrame(values, "value_id int, value string"))
    assert found.count() == 20
    kept = next(p for p in staging.paths(spark)[since:] if "/value_words-" in p)
    assert {len(r._all) for r in spark.read.parquet(kept).collect()} == {2}


def test_pairs_of_values_and_names_are_not_shuffled(spark, monkeypatch):
    """However many names there are: values and names go to where they meet, and what meets there stays."""
    from sparkfacts.operators import curation

    for bound in ("SENT_NAMES", "SENT_WORDS", "SENT_PEOPLE"):
        monkeypatch.setattr(curation, bound, 0)
    monkeypatch.setattr(curation, "NAMES_A_SHARE", 2)
    monkeypatch.setattr(curation, "PEOPLE_A_ROW", 3)
    rng = random.Random(4)
    people = [(i, " ".join(rng.choices("abcd", k=rng.randint(1, 3)))) for i in range(40)]
    values = [(i, " ".join(rng.choices("abcde", k=rng.randint(1, 6)))) for i in range(5000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = curation.contained_names(spark.createDataFrame(people, "person_id int, name string"), spark.createDataFrame(values, "value_id int, value string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.value_id, r.person_id) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert got == sorted((v, p) for p, n in people for v, t in values if plain_words(n) <= plain_words(t))


def test_suppressions_in_scope(spark):
    from sparkfacts.operators import publish

    people = [(1, "Ann Lee", "s", "c"), (2, "LEE, Ann", "t", "c"), (3, "Ann Lee", "s", "d"), (4, "Bob", "s", "c"), (5, "Bob", None, None), (6, "José", "s", "c"), (7, "", "s", "c"), (8, None, "s", "c")]
    rules = [("lee ann", "s", "c"), ("bob", None, "c"), ("JOSÉ", "s", None), ("Zed", None, None), ("", None, None)]
    df, told = spark.createDataFrame(people, "id int, name string, source string, club string"), spark.createDataFrame(rules, "name string, source string, club string")
    assert sorted(r.id for r in publish.unsuppressed(df, told).collect()) == [2, 3, 5, 7, 8]
    everywhere = spark.createDataFrame([("bob", None, None)], "name string, source string, club string")
    assert sorted(r.id for r in publish.unsuppressed(df, everywhere).collect()) == [1, 2, 3, 6, 7, 8]
    assert publish.unsuppressed(df, told.limit(0)).count() == len(people)
