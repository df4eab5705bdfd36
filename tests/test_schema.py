import json

import pytest
from pyspark.sql import functions as F

from quern.operators import schema as s

CASES = [
    ({"type": "string"}, '"a"', []), ({"type": "string"}, "1", [("$", "type")]), ({"type": ["integer", "null"]}, "null", []), ({"type": "integer"}, "1.0", []), ({"type": "integer"}, "1.5", [("$", "type")]),
    ({"type": "integer"}, "99999999999999999999", []), ({"type": "number"}, "1e3", []), ({"type": "number"}, '"1"', [("$", "type")]), ({"type": "boolean"}, "true", []), ({"type": "object"}, "[]", [("$", "type")]), ({"type": "array"}, "[]", []),
    ({"required": ["a", "b"]}, '{"a": null}', [("$.b", "required")]), ({"required": ["a"]}, "3", []), ({"properties": {"a": {"type": "string"}}}, '{"b": 1}', []), ({"properties": {"a": {"type": "string"}}}, '{"a": null}', [("$.a", "type")]),
    ({"properties": {"a b": {"properties": {"c": {"maxLength": 2}}}}}, '{"a b": {"c": "日本語"}}', [("$.a b.c", "maxLength")]), ({"maxLength": 3}, '"日本語"', []), ({"minLength": 1}, '""', [("$", "minLength")]), ({"minLength": 1}, "7", []),
    ({"enum": ["a", 1, None, [1, 2]]}, "1.0", []), ({"enum": ["a", 1, None, [1, 2]]}, "[1,2]", []), ({"enum": ["a", 1]}, "null", [("$", "enum")]), ({"enum": ["a"]}, '"A"', [("$", "enum")]), ({"const": True}, "true", []), ({"const": {"x": 1}}, '{"x": 2}', [("$", "const")]),
    ({"items": {"type": "string"}}, '["a", 1, "b", null]', [("$[1]", "type"), ("$[3]", "type")]), ({"items": {"required": ["k"], "properties": {"k": {"enum": ["A"]}}}}, '[{"k": "A"}, {}, {"k": "B"}]', [("$[1].k", "required"), ("$[2].k", "enum")]),
    ({"items": {"items": {"type": "integer"}}}, '[[1], ["x"]]', [("$[1][0]", "type")]), ({"minItems": 1}, "[]", [("$", "minItems")]), ({"maxItems": 1}, "[1, 2]", [("$", "maxItems")]), ({"uniqueItems": True}, "[1, 2, 1]", [("$", "uniqueItems")]), ({"contains": {"const": "x"}}, '["y"]', [("$", "contains")]), ({"contains": {"const": "x"}}, '["y", "x"]', []),
    ({"minimum": 2, "maximum": 4}, "1", [("$", "minimum")]), ({"minimum": 2, "maximum": 4}, "4.5", [("$", "maximum")]), ({"minimum": 2}, '"1"', []), ({"pattern": "^https?://"}, '"ftp://x"', [("$", "pattern")]),
    ({"properties": {"a": {}}, "additionalProperties": False}, '{"a": 1, "c": 2, "b": 3}', [("$", "additionalProperties")]), ({"additionalProperties": False}, "{}", []),
    ({"if": {"properties": {"t": {"const": "ai"}}, "required": ["t"]}, "then": {"required": ["m"]}, "else": {"required": ["n"]}}, '{"t": "ai"}', [("$.m", "required")]),
    ({"if": {"properties": {"t": {"const": "ai"}}, "required": ["t"]}, "then": {"required": ["m"]}, "else": {"required": ["n"]}}, '{"t": "x"}', [("$.n", "required")]),
    ({"not": {"type": "string"}}, '"x"', [("$", "not")]), ({"allOf": [{"type": "string"}, {"minLength": 2}]}, '"x"', [("$", "minLength")]), ({}, "1", []), ({"properties": {"a": False}}, '{"a": 1}', [("$.a", "never")]), ({"title": "t"}, "{bad", [("$", "json")]),
]


def test_every_keyword(spark):
    for number, (schema, text, want) in enumerate(CASES):
        got = s.schema_violations(spark.createDataFrame([(str(number), text)], "id string, json string"), schema).collect()
        assert sorted((r["path"], r["rule"]) for r in got) == sorted(want), (schema, text)


def test_nulls_and_many_rows(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"$schema": "x", "type": "object", "required": ["id"], "properties": {"quote": {"type": ["string", "null"], "maxLength": 25}}}))
    rows = [("a", None), ("b", ""), ("c", '{"id": 1, "quote": null}'), ("d", json.dumps({"quote": "x" * 26})), ("d", "[]"), (None, "3")]
    got = s.schema_violations(spark.createDataFrame(rows, "id string, json string").withColumn("path", F.lit(1)), s.load(str(tmp_path / "s.json"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([("a", "$", "json", ""), ("b", "$", "json", ""), ("d", "$.id", "required", ""), ("d", "$.quote", "maxLength", "26"), ("d", "$", "type", "object"), (None, "$", "type", "object")], "id string, path string, rule string, detail string").collect()))


@pytest.mark.parametrize("schema", [{"oneOf": []}, {"type": "text"}, {"additionalProperties": {}}, {"properties": {"a'b": {}}}])
def test_what_is_not_read_is_refused(spark, schema):
    with pytest.raises(ValueError):
        s.compiled(schema, F.parse_json(F.lit("1")), F.lit("$"))


def test_pool_items(spark):
    good = {"id": "a", "stem": "s", "options": [{"key": "A", "text": "t"}], "answer": "A", "year": 2024, "sources": ["https://a"], "quality_flags": ["time_sensitive"], "provenance": {"source_type": "ai_generated", "verify_verdict": "CONFIRMED", "source_origin": "o", "verified_date": "d", "verifier": "v", "original_id": "i", "ai_metadata": {"model_family": "m", "generation_date": "d", "verifier_round": 1}}}
    change = lambda **k: {**good, **k}
    within = lambda **k: change(provenance={**good["provenance"], **k})
    cases = {
        "good": (good, []), "no_stem": (change(stem=""), ["$.stem minLength"]), "options": (change(options=[{"key": "A"}]), ["$.options[0].text required"]), "none": (change(options=[]), ["$.options minItems"]), "answer": (change(answer=1), ["$.answer type"]),
        "year": (change(year="2024"), ["$.year type"]), "flag": (change(quality_flags=["odd"]), ["$.quality_flags[0] enum"]), "verifier": (within(verifier=""), ["$.provenance.verifier minLength"]), "no_ai": (within(ai_metadata=None), ["$.provenance.ai_metadata type"]),
        "round": (within(ai_metadata={"model_family": "m", "generation_date": "d", "verifier_round": "1"}), ["$.provenance.ai_metadata.verifier_round type"]), "human": (within(source_type="mock", ai_metadata=None), []), "quote": (within(quote="x" * 30), ["$.provenance.quote maxLength"]),
        "undecided": (within(verify_verdict="AMBIGUOUS"), ["$.quality_flags contains", "$.answer enum"]), "undecided_right": ({**within(verify_verdict="AMBIGUOUS"), "quality_flags": ["ambiguous"], "answer": None}, []), "prior": (within(prior_verify_verdict="x"), ["$.provenance.prior_verify_verdict enum"]), "list": ([], ["$ type"]),
    }
    schema = s.item_schema(("ambiguous", "time_sensitive"), ("mock", "ai_generated"), ("CONFIRMED", "AMBIGUOUS"))
    got = s.schema_violations(spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in cases.items()], "id string, json string"), schema).collect()
    found = {k: sorted(f"{r['path']} {r['rule']}" for r in got if r["id"] == k) for k in cases}
    assert found == {k: sorted(v) for k, (_, v) in cases.items()}


def test_totals(spark):
    declared = spark.createDataFrame([("a", 2), ("b", 3), ("c", None), ("d", 1)], "name string, total long")
    counted = spark.createDataFrame([("a", 2), ("b", 4), ("e", 1)], "name string, n long")
    assert sorted(map(tuple, s.total_violations(declared, counted).collect())) == [("b", 3, 4), ("d", 1, 0)]


def test_a_value_is_read_once_for_all_strings_and_rows_go_to_all_tasks(spark):
    texts = lambda n: str(s._equal(F.col("v"), [f"x{i}" for i in range(n)])._jc.toString()).count("try_variant_get")
    assert texts(50) == texts(2)
    rows = spark.range(40, numPartitions=1).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('{"n": '), "id", F.lit("}")).alias("json"))
    got = s.schema_violations(rows, {"properties": {"n": {"enum": [1, 2.0, None, "7"]}}})
    assert {r["id"] for r in got.collect()} == {str(i) for i in range(40)} - {"1", "2"} and got.rdd.getNumPartitions() > 1
