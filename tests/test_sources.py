"""Sources, parsers and sinks on small inputs of our own."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkfacts.functions import rules, text
from sparkfacts.operators import latest, links, publish, runs, serve
from sparkfacts.sources import delimited, filings, pages

XML = """<?xml version="1.0"?><Return xmlns="http://www.irs.gov/efile" returnVersion="2022v5.0"><ReturnHeader><TaxPeriodEndDt>2023-06-30</TaxPeriodEndDt><TaxPeriodBeginDt>2022-07-01</TaxPeriodBeginDt>
<Filer><EIN>123456789</EIN><BusinessName><BusinessNameLine1Txt>Lake Club</BusinessNameLine1Txt></BusinessName></Filer><ReturnTypeCd>990EZ</ReturnTypeCd></ReturnHeader><ReturnData><IRS990EZ>
<TotalRevenueAmt>1000</TotalRevenueAmt><TotalExpensesAmt>x</TotalExpensesAmt><OfficerDirectorTrusteeEmplGrp><CompensationAmt>10</CompensationAmt></OfficerDirectorTrusteeEmplGrp>
<OfficerDirectorTrusteeEmplGrp><CompensationAmt>15.5</CompensationAmt></OfficerDirectorTrusteeEmplGrp><NetAssetsOrFundBalancesGrp><EOYAmt>7</EOYAmt></NetAssetsOrFundBalancesGrp></IRS990EZ></ReturnData></Return>"""


def test_filing(spark):
    parsed = filings.parse_filings(spark.createDataFrame([("1", XML), ("2", "<Return><ReturnData/></Return>")], "object_id string, xml string"))
    r = {x.object_id: x for x in parsed.collect()}
    assert (r["1"].form_type, r["1"].ein, r["1"].filer_name, r["1"].return_version, r["1"].amended) == ("990EZ", "123456789", "Lake Club", "2022v5.0", False)
    assert r["2"].form_type is None
    c = {x.concept: (x.status, x.value, x.path) for x in filings.concept_rows(parsed).collect()}
    assert len(c) == 24 and c["total_revenue"] == ("resolved", 1000, "TotalRevenueAmt") and c["total_expenses"][0] == "absent"
    assert c["employee_count"][0] == "not_on_form" and c["net_assets_eoy"] == ("resolved", 7, "NetAssetsOrFundBalancesGrp/EOYAmt")
    assert c["officer_compensation"] == ("resolved", 26, "sum(OfficerDirectorTrusteeEmplGrp/CompensationAmt) over 2 node(s)")


def test_delimited(spark, tmp_path):
    (tmp_path / "reg.csv").write_text("﻿EIN,NAME,STATE\n012345678,LAKE ROWING CLUB,MA\n12,SHORT CREW,MA\n987654321,GROWING PLACES,NY\n111111111,OTHER,NY\n", encoding="utf-8")
    assert [r.NAME for r in delimited.registry_csv(spark, str(tmp_path / "reg.csv")).collect()] == ["LAKE ROWING CLUB"]
    watched = spark.createDataFrame([("111111111",)], "ein string")
    assert {r.NAME for r in delimited.registry_csv(spark, str(tmp_path / "reg.csv"), watched).collect()} == {"LAKE ROWING CLUB", "OTHER"}
    (tmp_path / "index.csv").write_text("RETURN_ID,FILING_TYPE,EIN,TAX_PERIOD,SUB_DATE,TAXPAYER_NAME,RETURN_TYPE,DLN,OBJECT_ID\n1,EFILE,12345678,202306,2023,CLUB, THE, INC,990,9,77\n2,EFILE,1,202306,2023,X,990T,9,78\n")
    got = delimited.filing_index(spark, str(tmp_path / "index.csv")).collect()
    assert [(r.ein, r.name, r.object_id) for r in got] == [("012345678", "CLUB, THE, INC", "77")]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a.txt", "1|x|y|z\n\n2|w\n")
    got = sorted(map(tuple, delimited.zipped_rows(spark, str(tmp_path / "p.zip"), ["a", "b"]).collect()))
    assert got == [("1", "x", ["y", "z"]), ("2", "w", [])]
    (tmp_path / "c.csv").write_text("# note\nname,mix\nA,x | y\n")
    assert delimited.curated_csv(spark, str(tmp_path / "c.csv"), ["name"], ("mix",)).first().mix == ["x", "y"]
    with pytest.raises(ValueError):
        delimited.curated_csv(spark, str(tmp_path / "c.csv"), ["slug"])


def test_pages(spark):
    html = "<table><tr><th>Place</th><th>Lane</th><th>Entry</th><th>Penalty</th><th>Time</th><th>Margin</th></tr><tr><td></td><td>3</td><td>Lake <b>A</b></td><td></td><td>7:01.2</td><td></td></tr><tr><td>1</td></tr></table>"
    good, bad = pages.result_rows(spark.createDataFrame([(1, html)], "page int, html string"), "page", "html")
    assert [(r.entry, r.entry_key) for r in good.collect()] == [("Lake A", "3")] and bad.count() == 1
    listing = '<table><tr bgcolor="#FFCC00"><td>May 1</td></tr></table><span class="newscat2">Heads</span><a href="/a/2024">A</a><a href="/a/2024">A again</a><tr bgcolor="ffcc00"><td>May 2</td></tr><a href="/b/2023">B</a><select name="site"><option value="/archive?y=2022">2022</option></select>'
    df = spark.createDataFrame([(1, listing)], "page int, html string")
    assert [(r.date, r.category, r.label) for r in pages.directory_links(df, "page", "html").orderBy("pos").collect()] == [("May 1", "Heads", "A"), ("May 2", "Heads", "B")]
    row = df.select(pages.event_links(F.col("html")).alias("e"), pages.anchors(F.col("html")).alias("a"), pages.archive_years(F.col("html")).alias("y"), pages.page_state(F.col("html")).alias("s")).first()
    assert row.e == ["a/2024", "b/2023"] and len(row.a) == 3 and row.y == {"2022": "/archive?y=2022"} and row.s == "content"


def test_json(spark):
    doc = {"$id": "1", "crew": {"$id": "2", "name": "A", "boat": {"$ref": "3"}}, "boats": [{"$id": "3", "kind": "8+", "back": {"$ref": "1"}}], "again": {"$ref": "2", "name": "B"}}
    got = json.loads(spark.createDataFrame([(json.dumps(doc),)], "j string").select(pages.resolve_graph("j")).first()[0])
    assert got["crew"]["boat"]["kind"] == "8+" and got["again"]["name"] == "B" and got["again"]["boat"]["kind"] == "8+"
    assert got["boats"][0]["back"]["boats"][0]["back"] is None  # a cycle ends
    check = pages.checksum_of(("stamp",))
    a, b, c = (r[0] for r in spark.createDataFrame([('{"a":1,"b":{"stamp":1}}',), ('{"b":{"stamp":2},"a":1}',), ('{"a":2}',)], "j string").select(check("j")).collect())
    assert a == b != c
    df = spark.createDataFrame([('{"x": 1}',), ("{oops",), (None,)], "j string")
    good, bad = pages.strict_json(df, "j", "x int")
    assert [r.doc.x for r in good.collect()] == [1] and bad.count() == 2
    rows = spark.createDataFrame([('[{"id":1}]',), ('{"k":{"id":2}}',)], "j string").select(pages.keyed_rows(F.col("j"), "struct<id:int>").alias("r"))
    assert [r.r[0].id for r in rows.collect()] == [1, 2]


def test_times(spark):
    values = ["6:30.12", "1:02:03.5", "-0:05", "DNS", "90.4", "", "x", "7:61"]
    df = spark.createDataFrame([(v,) for v in values], "t string").select(text.result_time(F.col("t")).alias("a"), text.split_time(F.col("t")).alias("b"), text.strict_time(F.col("t")).alias("c"))
    rows = df.collect()
    assert [r.a for r in rows] == [390120, 3723500, -5000, None, 90400, None, None, 481000]
    assert [r.b for r in rows][:3] == [390120, 3723500, -5000] and rows[3].b is None
    assert rows[0].c.ms == 390120 and rows[7].c.bad and rows[6].c.bad and rows[4].c.ms == 90400


@pytest.mark.parametrize("name,want", [
    ("Men's Masters 4x (C)", ("masters_exact_letter", "4x", "masters_c", "men")), ("Womens Masters 8+ (A+)", ("masters_open_ended", "8+", "masters_unspecified", "women")),
    ("Mixed Masters 2x (A-C)", ("masters_letter_range", "2x", "masters_unspecified", "mixed")), ("W U17 4+", ("u17", "4+", "u17", "women")), ("MY8+", (None,) * 4),
    ("Boys Youth 8+ then 4x", ("youth", "4x", "u19_youth", "men")), ("Men and Women Open 2-", (None,) * 4), ("Open 1x", (None,) * 4), ("Men Novice 8+", (None,) * 4)])
def test_event_rules(spark, name, want):
    none = F.lit(None).cast("string")
    got = rules.classify(spark.createDataFrame([(name,)], "n string"), none, F.col("n"), none, none, none).select("mapping_key", "boat_class", "age_bracket", "gender").first()
    assert tuple(got) == want


def test_names(spark):
    df = spark.createDataFrame([("  Lake Rowing Club, Inc.",), ("River Boat Club B",), ("José  O’Neil",)], "n string")
    rows = df.select(text.match_name(F.col("n")).alias("m"), text.person_key("n").alias("p"), text.is_discovery_name(F.col("n")).alias("d"), text.slug(F.col("n")).alias("s")).collect()
    assert [r.m for r in rows[:2]] == ["Lake Rowing Club", "River Boat Club"] and rows[2].p == "josé oneil" and [r.d for r in rows] == [True, True, False] and rows[0].s == "lake-rowing-club-inc"


def test_club_tiers(spark):
    scored = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5), (2, 10, 0.9), (2, 11, 0.86), (3, 10, 0.7), (4, 10, 0.7), (5, 10, 0.95)], "club long, org long, score double")
    usage = spark.createDataFrame([(1, "time_team", 1), (2, "time_team", 1), (3, "herenow", 3), (4, "herenow", 2), (5, "time_team", 1)], "club long, source string, n_regattas int")
    rejected = spark.createDataFrame([(5, 10)], "club long, org long")
    got = {r.club: (r.tier, r.org) for r in links.club_tier(scored, rejected, usage).collect()}
    assert got == {1: ("auto", 10), 2: ("review", 10), 3: ("review", 10), 4: ("none", None)}


def test_snapshots(spark, tmp_path):
    s = publish.Snapshots(spark, f"file://{tmp_path}/pub")
    for k in ("a", "b"):
        s.write(k, {"directory": spark.createDataFrame([(k,)], "name string")})
        s.activate(k)
    assert s.active() == "b" and s.read("directory").first().name == "b"
    states = spark.createDataFrame([("a", "superseded", 1), ("b", "active", 2), ("c", "superseded", 3)], "snapshot_id string, status string, created_at int")
    assert s.rollback(states, "directory") == "a" and s.read("directory").first().name == "a"
    ranked = latest.retention(states, [F.desc("created_at")], 1)
    assert sorted(s.collect_garbage(ranked, ["directory"])) == ["b"]
    with pytest.raises(ValueError):
        publish.require(publish.invariant_counts({"r": states}))


def test_runs(spark, tmp_path):
    run = runs.Run("load", "x")
    df = run.counted(spark.range(10), even=F.col("id") % 2 == 0)
    df.write.parquet(f"{tmp_path}/o")
    assert run.row(spark, "ok").first().stats == {"even": 5}
    good, bad = runs.quarantine(spark.range(5), F.col("id") > 2, F.lit("large"), ["id"])
    assert good.count() == 3 and bad.first().payload == '{"id":3}'
    q = spark.createDataFrame([(1, True)], "at int, resolved boolean")
    assert runs.gate(q, F.lit(0), resolved_count=False) == 0
    with pytest.raises(ValueError):
        runs.gate(q, F.lit(0))
    assert runs.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_csv_export(spark, tmp_path):
    serve.export_csv(spark.createDataFrame([('a "b"', 1)], "n string, v int"), f"{tmp_path}/csv", [F.asc("n")])
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes().startswith(b'n,v\r\n"a ""b""",1')


def test_stream_windows(spark, tmp_path):
    from sparkfacts.streaming.windows import hourly, sessions

    rows = [(1, "2024-01-01 00:10:00", 5, "a", 1.5), (2, "2024-01-01 00:50:00", 5, "a", 2.0), (3, "2024-01-01 03:00:00", 5, "b", 1.0)]
    df = spark.createDataFrame(rows, "event_id int, t string, user_id int, event_type string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    assert sorted((r.n, r.total) for r in hourly(df).collect()) == [(1, 1.0), (2, 3.5)] and sessions(df).count() == 3
    df.write.parquet(f"{tmp_path}/in")
    q = hourly(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").count() == 2
