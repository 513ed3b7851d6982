from pyspark.sql import functions as F


def test_mixed_documents_without_a_shuffle_of_texts(spark):
    """Rows meet the last taken row of their source and size where they are read, whatever Spark would broadcast by itself."""
    from sparkfacts.llm import mixing

    rows = [(i % 700 if i % 9 else None, "ab"[i % 2] if i % 5 else None, "w " * (i % 13)) for i in range(1500)] + [(5, "a", "same words here")] * 2500
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixing.mixed_documents(docs)
        assert "hashpartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()
        want = mixing.mix(docs).filter("copies > 0").groupBy("source", "size").agg(F.sum("copies").alias("n"))
        got = mixed.withColumn("size", mixing.word_count()).groupBy("source", "size").agg(F.count("*").alias("n"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_looked_for_are_told_from_most_others(spark):
    from sparkfacts.llm import simhash

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("k"))
    among = simhash._among(rows.filter("doc_id % 10 = 0"))
    found = [r.doc_id for r in rows.filter(among).collect()]
    assert set(range(0, 20_000, 10)) <= set(found) and len(found) < 2_000 + 18_000 * 0.03
    none = simhash._among(rows.limit(0))
    assert not rows.filter(none).count()


def test_sets_take_one_python_worker_a_task(spark):
    """A second Python step in the stage would leave executors with twice the workers for all later stages."""
    from sparkfacts.llm import simhash

    docs = spark.createDataFrame([(i, f"some words of the text {i % 150} and no more") for i in range(300)] + [(-5, None), (-6, "")], "doc_id long, text string")
    keyed = simhash._keyed(docs)
    sets = simhash._sets(docs, keyed.filter("doc_id % 3 = 0 or doc_id < 0").select("doc_id", "k"), simhash.SIMILAR)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan
    got = {frozenset(r.set) for r in sets.collect()}
    every = {i: frozenset(simhash.shingles((t or "").encode(), 5, True).view("int64").tolist()) for i, t in docs.collect()}
    assert {every[i] for i in every if i % 3 == 0 or i < 0} <= got <= set(every.values())
    assert not simhash._sets(docs, keyed.limit(0).select("doc_id", "k"), simhash.SIMILAR).count()
