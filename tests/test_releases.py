"""Releases with two writers, a crash between tables, a lost file; coverage and directories case by case."""

import datetime
import os
import shutil

import pytest
from pyspark.sql import functions as F


def frames(spark, n):
    return {"a": spark.range(n).withColumn("m", F.create_map(F.lit("k"), F.col("id"))), "b": spark.range(n * 2), "empty": spark.range(0)}


def test_two_writers(spark, tmp_path):
    from sparkfacts.operators.releases import Conflict, Releases

    one, two = Releases(spark, f"file://{tmp_path}"), Releases(spark, f"file://{tmp_path}")
    assert one.manifest() is None
    assert one.release(frames(spark, 3)) == 1
    x, y = one.draft(frames(spark, 5)), two.draft(frames(spark, 7))
    assert one.read("a").count() == 3  # drafts aren't read
    assert two.commit(y) == 2
    with pytest.raises(Conflict):
        one.commit(x)
    assert one.manifest() == two.manifest() and one.read("b").count() == 14 and one.read("a", 1).count() == 3
    assert not [n for n in os.listdir(tmp_path / "_manifests") if n.startswith("_")]
    assert one.release(frames(spark, 5)) == 3 and two.read("a").count() == 5
    assert {k: t["rows"] for k, t in two.manifest()["tables"].items()} == {"a": 5, "b": 10, "empty": 0}


def test_a_crash_between_tables_releases_nothing(spark, tmp_path):
    from sparkfacts.operators.releases import Releases

    r = Releases(spark, f"file://{tmp_path}")
    r.release(frames(spark, 3))
    bad = frames(spark, 4) | {"c": spark.range(3).select(F.raise_error(F.lit("crash")).alias("x"))}
    with pytest.raises(Exception, match="crash"):
        r.release(bad)
    assert r.numbers() == [1] and r.read("a").count() == 3
    assert r.sweep() == [] and len(r.sweep(older_than=0)) == 1 and len(os.listdir(tmp_path / "data")) == 1
    assert r.read("b").count() == 6


def test_validation(spark, tmp_path):
    from sparkfacts.operators.releases import Releases

    r = Releases(spark, f"file://{tmp_path}")
    d = r.draft(frames(spark, 100))
    r.validate(d, lambda t: {"negative": t["a"].filter("id < 0")})
    with pytest.raises(ValueError, match="large"):
        r.validate(d, lambda t: {"large": t["a"].filter("id > 97"), "negative": t["a"].filter("id < 0")})
    folder = d["tables"]["a"]["path"].removeprefix("file://").removeprefix("file:")
    part = sorted(f for f in os.listdir(folder) if f.startswith("part-"))[-1]
    shutil.move(f"{folder}/{part}", f"{tmp_path}/lost")
    with pytest.raises(ValueError, match="a was not written whole"):
        r.validate(d)
    assert r.manifest() is None


def test_coverage(spark):
    from sparkfacts.operators import assembly

    day = datetime.date
    filings = spark.createDataFrame([
        ("1", "x", 2015, day(2015, 6, 30), "990EZ", False), ("2", "x", 2015, day(2015, 6, 30), "990", False), ("10", "x", 2015, day(2015, 6, 30), "990", False), ("3", "x", 2017, day(2017, 6, 30), "990", True), ("4", "x", 2017, day(2017, 12, 31), "990", False), ("5", "y", 2018, day(2018, 5, 31), "990EZ", None),
    ], "filing_id string, org string, tax_year int, period_end date, form string, amended boolean")
    notices = spark.createDataFrame([("n1", "x", 2018, None), ("n2", "x", 2015, day(2015, 1, 1)), ("n3", "z", 2010, day(2010, 3, 31))], "observation_id string, org string, tax_year int, period_end date")
    got = {(r.org, r.tax_year): (r.status, str(r.fy_end)) for r in assembly.coverage_rows(filings, notices).collect()}
    assert got == {("x", 2015): ("990", "2015-06-30"), ("x", 2016): ("missing", "None"), ("x", 2017): ("amended", "2017-06-30"), ("x", 2018): ("990n", "2018-12-31"), ("y", 2018): ("990ez", "2018-05-31"), ("z", 2010): ("990n", "2010-03-31")}
    orgs = spark.createDataFrame([(o, f"s{o}", o.upper()) for o in "xyzw"], "org string, slug string, display_name string")
    aliases = spark.createDataFrame([("x", "B"), ("x", "A"), ("x", "A")], "org string, alias string")
    rows = {r.org: (r.coverage_state, r.fye_month, r.aliases, r.search_document) for r in assembly.directories(orgs, filings, notices, aliases).collect()}
    assert rows == {"x": ("990", 6, ["A", "B"], "X sx A B"), "y": ("990ez", 5, [], "Y sy"), "z": ("990n_only", None, [], "Z sz"), "w": ("none", None, [], "W sw")}
    history = spark.createDataFrame([("sx", "x"), ("sx", "y"), ("old", "y")], "slug string, org string")
    assert [tuple(r) for r in assembly.slug_conflicts(orgs, history).collect()] == [("sx", "y", "x")]


def test_metric_series(spark):
    from sparkfacts.operators import assembly

    day = datetime.date
    rows = [
        (1, "x", "m", 2, "7", ["7", "7"], 0.5, "percent", "verified", "/p", "u7"), (2, "x", "m", 2, "7", ["7", "8"], 0.5, "count", "derived", "/p", "u7"), (3, "x", "m", 2, None, ["7"], 0.5, "USD", "derived", "/p", "u"), (4, "x", "m", 2, "7", ["7"], None, "USD", "derived", "", "u"),
    ]
    metrics = spark.createDataFrame(rows, "metric_id int, org string, metric_key string, version int, filing_id string, input_filing_ids array<string>, value double, unit string, quality_state string, source_path string, raw_url string")
    metrics = metrics.withColumns({"tax_year": F.lit(2020), "period_end": F.lit(day(2020, 2, 29)), "period_begin": F.lit(None).cast("date"), "form": F.lit("990"), "amended": F.lit(False), "retrieved_at": F.lit("t")})
    good, bad = assembly.metric_series(metrics, spark.createDataFrame([("8",)], "filing_id string"), "p")
    got = sorted((r.quality_state, r.source_ref.unit, r.source_ref.source.raw_url, r.source_ref.period.label) for r in good.collect())
    assert got == [("under_review", "count", None, "FY2020 (Mar 2019–Feb 2020)"), ("verified", "USD", "u7", "FY2020 (Mar 2019–Feb 2020)")]
    assert sorted(r.metric_id for r in bad.collect()) == [3, 4]


def test_a_table_is_made_of_written_ones(spark, tmp_path):
    from sparkfacts.operators.releases import Releases

    r = Releases(spark, f"file://{tmp_path}")
    r.release({"a": spark.range(5).withColumn("once", F.expr("uuid()")), "b": lambda made: made["a"].filter("id > 2")}, lambda t: {"other": t["b"].join(t["a"], ["id", "once"], "left_anti")})
    assert r.read("b").count() == 2 and {k: t["rows"] for k, t in r.manifest()["tables"].items()} == {"a": 5, "b": 2}
