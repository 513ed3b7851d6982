"""Counters of one pass, in every state; catalogs that end early, in gaps and in broken pages."""

import json
import os

from pyspark.sql import functions as F


def test_ingest_counts_in_one_pass(spark, tmp_path):
    from sparkfacts.operators import runs

    seen = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", "1", "x"), ("a", "1", "x"), ("b", "2", "x"), ("c", "3", "x"), ("d", "4", None), ("e", "5", "drop"), ("f", None, "x"), ("g", "9", "bad"), (None, "1", "x")]
    incoming = spark.createDataFrame(rows, "k string, checksum string, kind string").mapInArrow(once, "k string, checksum string, kind string")
    stored = spark.createDataFrame([("b", "2"), ("c", "other")], "k string, checksum string")
    run = runs.Run("j", "s")
    out = runs.ingest(run, incoming, stored, ["k"], "checksum", F.col("kind") == "drop", F.col("kind") == "bad", F.lit("is bad"), f"file://{tmp_path}/out")
    assert seen.value == len(rows)  # read once
    stats = run.row(spark, "succeeded").first().stats
    assert stats == {"inserted": 3, "unchanged": 1, "repeated": 1, "dropped": 1, "quarantined": 2, "conflict": 1}
    got = sorted((str(r.k), r.state, str(r.reason)) for r in out.collect())
    assert got == [("None", "inserted", "None"), ("a", "inserted", "None"), ("c", "quarantined", "conflict"), ("d", "quarantined", "is bad"), ("f", "inserted", "None"), ("g", "quarantined", "is bad")]


def pages_of(path, pages):
    for n, body in pages.items():
        os.makedirs(f"{path}/page={n}")
        with open(f"{path}/page={n}/0.json", "w") as f:
            f.write(body if isinstance(body, str) else json.dumps(body))


def test_paged_catalog(spark, tmp_path):
    from sparkfacts.sources import pages

    rows = lambda *ids: [{"id": i} for i in ids]
    cases = {
        "short": ({0: rows(1, 2), 1: {"value": rows(3, 4)}, 2: rows(5), 3: rows(6, 7)}, [1, 2, 3, 4, 5]),
        "full": ({0: rows(1, 2), 1: rows(3, 4)}, [1, 2, 3, 4]),
        "gap": ({0: rows(1, 2), 2: rows(5, 6)}, [1, 2]),
        "broken": ({0: rows(1, 2), 1: "<html>", 2: rows(5, 6)}, [1, 2]),
        "empty": ({0: {"value": []}, 1: rows(1, 2)}, []),
        "many": ({i: rows(2 * i, 2 * i + 1) for i in range(12)}, list(range(24))),
    }
    for name, (landed, want) in cases.items():
        pages_of(tmp_path / name, landed)
        got = pages.paged_catalog(spark, f"file://{tmp_path}/{name}", "struct<id:bigint>", 2).collect()
        assert sorted(r.id for r in got) == want, name
