"""Nested walks and contracts against plain ones."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F


def test_scrub_and_harvest(spark):
    from sparkfacts.functions import nested

    df = spark.sql("""SELECT 1 AS id, named_struct('Name', 'a', 'E-Mail', 'x', 'in', named_struct('phoneNo', 1, 'Waiver', 'y')) AS s,
      array(named_struct('k', map('ok', array('v', null), 'Registrant id', array('w'), 'cell Phone', array('z')), 'n', 7), null) AS a, map(1, 'one') AS m, 'mail' AS plain, 'gone' AS home_address, cast(null AS struct<b: string>) AS nul""")
    out = nested.scrub(df)
    assert out.columns == ["id", "s", "a", "m", "plain", "nul"] and [f.name for f in out.schema["s"].dataType] == ["Name"]
    r = out.first()
    assert r.s.Name == "a" and r.a[0].k == {"ok": ["v", None]} and r.a[0].n == 7 and r.a[1] is None and r.m == {1: "one"} and r.nul is None
    got = {(x.place, x.value) for x in nested.harvest(out, "id", "s", "a", "m", "plain", "nul").collect()}
    assert got == {("s.Name", "a"), ("a[0].k.ok[0]", "v"), ("m.1", "one"), ("plain", "mail")}
    assert nested.harvest(df.select("id"), "id").collect() == []
    assert nested.scrub(df, "m").columns == df.columns and nested.scrub(df.limit(0)).collect() == []


def plain(schema, v, at):
    """The same keywords, value by value."""
    out = []
    kinds = {"object": dict, "array": list, "string": str, "null": type(None)}
    number = isinstance(v, (int, float)) and not isinstance(v, bool)

    def is_(t):
        return number and (t == "number" or v == int(v)) if t in ("number", "integer") else isinstance(v, bool) if t == "boolean" else isinstance(v, kinds[t])

    types = schema.get("type", [])
    if types and not any(is_(t) for t in ([types] if isinstance(types, str) else types)):
        out.append(f"{at}: type")
    if "enum" in schema and not any(type(v) is type(x) and v == x for x in schema["enum"]):
        out.append(f"{at}: enum")
    if isinstance(v, str):
        out += [f"{at}: pattern"] * ("pattern" in schema and not re.search(schema["pattern"], v))
        out += [f"{at}: minLength"] * (len(v) < schema.get("minLength", 0))
    if number:
        out += [f"{at}: minimum"] * (v < schema.get("minimum", v)) + [f"{at}: maximum"] * (v > schema.get("maximum", v))
    if "anyOf" in schema and all(plain(s, v, at) for s in schema["anyOf"]):
        out.append(f"{at}: anyOf")
    if isinstance(v, dict):
        out += [f"{at}.{k}: required" for k in schema.get("required", ()) if k not in v]
        for k, s in schema.get("properties", {}).items():
            out += plain(s, v[k], f"{at}.{k}") if k in v else []
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: additionalProperties" for k in sorted(v) if k not in schema["properties"]]
    if isinstance(v, list):
        out += [f"{at}: minItems"] * (len(v) < schema.get("minItems", 0)) + [f"{at}: maxItems"] * (len(v) > schema.get("maxItems", len(v)))
        out += [m for i, x in enumerate(v) for m in plain(schema["items"], x, f"{at}[{i}]")] if "items" in schema else []
    return out


SCHEMA = {
    "type": "object", "required": ["a", "it's b"], "additionalProperties": False,
    "properties": {
        "a": {"anyOf": [{"type": "integer", "minimum": 0}, {"type": "null"}]}, "it's b": {"type": ["string", "boolean"], "enum": ["x", "é", True]},
        "c": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "array", "items": {"type": "object", "required": ["d"], "properties": {"d": {"type": "string", "pattern": "^[0-9]+$", "minLength": 2}, "n": {"type": "number", "maximum": 1.5}}}}},
    },
}


def test_contracts(spark):
    from sparkfacts.operators import contracts

    rng = random.Random(5)
    leaf = lambda: rng.choice([None, True, False, 0, 1, -1, 2.0, 1.5, 1e20, "x", "é", "12", "1", "", [], {}, [1], {"d": "12"}])

    def value(keys):
        return {k: rng.choice([leaf, lambda: [[{kk: leaf() for kk in rng.sample(["d", "n", "o"], rng.randint(0, 3))} for _ in range(rng.randint(0, 2))] for _ in range(rng.randint(0, 3))]])() for k in keys}

    docs = [value(rng.sample(["a", "it's b", "c", "z"], rng.randint(0, 4))) for _ in range(300)] + [leaf() for _ in range(20)]
    rows = [(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(docs)] + [(1000, "{"), (1001, ""), (1002, None)]
    got = {r.id: r.problems for r in contracts.checked(spark.createDataFrame(rows, "id int, p string"), "p", SCHEMA).collect()}
    for i, x in enumerate(docs):
        assert sorted(got[i]) == sorted(plain(SCHEMA, x, "$")), x
    assert got[1000] == got[1001] == got[1002] == ["$: malformed"]
    told = contracts.violations(spark.createDataFrame(rows, "id int, p string"), "id", "p", SCHEMA).groupBy("id").agg(F.count("*").alias("n")).collect()
    assert {r.id: r.n for r in told} == {i: len(x) for i, x in got.items() if x}
    with pytest.raises(ValueError, match="oneOf"):
        contracts.problems({"oneOf": []}, F.lit(None), F.lit("$"))


def test_a_payload_is_parsed_once(spark):
    from sparkfacts.operators import contracts

    df = contracts.violations(spark.createDataFrame([(1, "{}")], "id int, p string"), "id", "p", SCHEMA)
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
