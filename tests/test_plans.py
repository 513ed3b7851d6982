"""The queries of forms, derivation, profiles and landed documents give what DuckDB gives; operators where SQL says little."""

import os
import threading

import pytest

from sparkfacts.plans import catalog, derive, filed, forms, gates, ingested, landed, profile, rated, released, sourced

from .test_catalog import DATA, TABLES, plain

NAMES = sorted(n for n, f in catalog.QUERIES.items() if f.__module__ in {m.__name__ for m in (derive, filed, forms, gates, ingested, landed, profile, rated, released, sourced)})


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df, want = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = plain(df.collect(), df.columns)
    assert got and got == plain(want.fetchall(), want.columns)


def test_pointer_is_always_there(spark, tmp_path):
    from sparkfacts.operators.publish import Snapshots

    s, seen, stop = Snapshots(spark, f"file://{tmp_path}"), set(), threading.Event()
    s.activate("a0")

    def read():
        while not stop.is_set():
            names = [n for n in os.listdir(tmp_path / "_active") if n.isdigit()]
            seen.add((tmp_path / "_active" / max(names)).read_text() if names else None)

    t = threading.Thread(target=read)
    t.start()
    for i in range(40):
        s.activate(f"a{i}")
    stop.set()
    t.join()
    assert None not in seen and "" not in seen and s.active() == "a39"


def test_ranks_over_all_rows(spark):
    from pyspark.sql import functions as F

    from sparkfacts.operators import latest

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r["rank"] == r.x + 1 for r in latest.ranked(df, [F.asc("x")]).collect())


@pytest.mark.parametrize("partitions", [8, 200])
def test_ranks_lose_no_row_of_wide_frames(spark, partitions):
    from pyspark.sql import functions as F

    from sparkfacts.operators import latest

    n, before = 600_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(n).select(((F.col("id") * 7919) % n).alias("x"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("payload"))
        one = latest.ranked(df, [F.desc("x")]).agg(F.count("*"), F.countDistinct("rank"), F.sum((F.col("rank") != n - F.col("x")).cast("int")), F.countDistinct("payload")).first()
        assert tuple(one) == (n, n, 0, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_within_groups_and_ties(spark):
    from pyspark.sql import functions as F

    from sparkfacts.operators import latest

    rows = [(None, 5), ("a", 2), ("a", None), ("b", 1), ("a", 2), (None, 4), ("a", 1)]
    got = latest.ranked(spark.createDataFrame(rows, "g string, x int"), [F.asc_nulls_last("x")], ("g",)).collect()
    assert sorted((str(r.g), r["rank"], r.x) for r in got) == [("None", 1, 4), ("None", 2, 5), ("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("a", 4, None), ("b", 1, 1)]
    assert latest.ranked(spark.createDataFrame([], "g string, x int"), [F.asc("x")]).count() == 0


def test_date_ranges_over_new_year(spark):
    from pyspark.sql import functions as F

    from sparkfacts.functions import forms as f

    rows = ["Dec 30 - Jan 2, 2025", "may 3, 2024", "September 9 - September 11, 2023", "Foo 1, 2020", "May 3", None]
    got = [tuple(r.r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", f.date_range(F.col("x")).alias("r")).orderBy("i").collect()]
    assert [tuple(map(str, g)) for g in got[:3]] == [("2024-12-30", "2025-01-02"), ("2024-05-03", "2024-05-03"), ("2023-09-09", "2023-09-11")]
    assert got[3:] == [(None, None)] * 3
