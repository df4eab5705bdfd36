"""Gates compiled from JSON Schema: a schema becomes one column expression over VARIANT, and every row that breaks it has a row a fault.

Read are type (one or several), required, properties, additionalProperties (false), items, enum, const, minLength, maxLength, pattern, minimum, maximum,
minItems, maxItems, uniqueItems, contains, allOf, if/then/else and not. Other keywords that limit a document are refused, not passed over.
"""

from __future__ import annotations

import json as _json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_FAULT = "array<struct<path: string, rule: string, detail: string>>"
_READ = {"type", "required", "properties", "additionalProperties", "items", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "minItems", "maxItems", "uniqueItems", "contains", "allOf", "if", "then", "else", "not"}
#: Say nothing about whether a document is right.
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}


def load(path: str) -> dict:
    """A schema from a local file."""
    with open(path, encoding="utf-8") as f:
        return _json.load(f)


def _none() -> Column:
    return F.array().cast(_FAULT)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, kind: str) -> Column:
    """Whether a value is of a JSON type; a number without a fraction is an integer however it is written."""
    found = _kind(v)
    number = (found == "BIGINT") | (found == "DOUBLE") | (found == "FLOAT") | F.startswith(found, F.lit("DECIMAL"))
    tests = {
        "null": F.is_variant_null(v),
        "boolean": found == "BOOLEAN",
        "string": found == "STRING",
        "array": F.startswith(found, F.lit("ARRAY")),
        "object": F.startswith(found, F.lit("OBJECT")),
        "number": number,
        "integer": (found == "BIGINT") | (number & (F.try_variant_get(v, "$", "double") % 1 == 0)),
    }
    if kind not in tests:
        raise ValueError(f"unknown type {kind}")
    return F.coalesce(tests[kind], F.lit(False))


def _member(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"a property can't be named {name}")
    return f"$['{name}']"


def _text(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def _bound(v: Column, use) -> Column:
    """use(v) with v worked out once, however often it stands in ``use``."""
    return F.element_at(F.transform(F.array(v), use), 1)


def _fault(when: Column, path: Column, rule: str, detail: Column | str) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule"), F.coalesce(detail, F.lit("")).alias("detail")))).otherwise(_none())


def _equal(v: Column, values: list) -> Column:
    """Whether a value is one of JSON values; they are compared as JSON with sorted keys, numbers by value."""
    numbers = [float(x) for x in values if isinstance(x, (int, float)) and not isinstance(x, bool)]
    strings = [x for x in values if isinstance(x, str)]
    others = [x for x in values if isinstance(x, bool) or x is None or isinstance(x, (list, dict))]
    tests = []
    # A value is read once for all the strings; a condition each would read it as often as there are strings.
    if strings:
        tests.append(_is(v, "string") & F.try_variant_get(v, "$", "string").isin(strings))
    if numbers:
        number = F.try_variant_get(v, "$", "double")
        tests.append(_is(v, "number") & reduce(lambda a, b: a | b, [number == x for x in numbers]))
    if others:
        tests.append(_text(v).isin([F.to_json(F.parse_json(F.lit(_json.dumps(x, ensure_ascii=False)))) for x in others]))
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def compiled(schema: dict | bool, v: Column, path: Column) -> Column:
    """The faults (array of path, rule, detail) of a VARIANT under a schema; path: of the value in its document, ``$`` for the whole."""
    if isinstance(schema, bool):
        return _none() if schema else _fault(F.lit(True), path, "never", "")
    unknown = set(schema) - _READ - _NOTES
    if unknown:
        raise ValueError(f"keywords that aren't read: {sorted(unknown)}")
    out = []
    string, number, items = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "array<variant>")
    is_text, is_number, is_list, is_object = (_is(v, k) for k in ("string", "number", "array", "object"))
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        out.append(_fault(~reduce(lambda a, b: a | b, [_is(v, k) for k in kinds]), path, "type", "|".join(kinds)))
    if "enum" in schema:
        out.append(_fault(~_equal(v, schema["enum"]), path, "enum", _text(v)))
    if "const" in schema:
        out.append(_fault(~_equal(v, [schema["const"]]), path, "const", _text(v)))
    sizes = (("minLength", is_text, F.length(string), "<"), ("maxLength", is_text, F.length(string), ">"), ("minItems", is_list, F.size(items), "<"), ("maxItems", is_list, F.size(items), ">"))
    for rule, applies, size, way in sizes:
        if rule in schema:
            out.append(_fault(applies & (size < schema[rule] if way == "<" else size > schema[rule]), path, rule, size.cast("string")))
    if "minimum" in schema:
        out.append(_fault(is_number & (number < float(schema["minimum"])), path, "minimum", _text(v)))
    if "maximum" in schema:
        out.append(_fault(is_number & (number > float(schema["maximum"])), path, "maximum", _text(v)))
    if "pattern" in schema:
        out.append(_fault(is_text & ~F.regexp_like(string, F.lit(schema["pattern"])), path, "pattern", schema["pattern"]))
    if schema.get("uniqueItems"):
        texts = F.transform(items, _text)
        out.append(_fault(is_list & (F.size(F.array_distinct(texts)) < F.size(texts)), path, "uniqueItems", ""))
    if "contains" in schema:
        fits = F.exists(items, lambda x: F.size(compiled(schema["contains"], x, path)) == 0)
        out.append(_fault(is_list & ~F.coalesce(fits, F.lit(False)), path, "contains", ""))
    below = lambda name: F.concat(path, F.lit(f".{name}"))
    for name in schema.get("required", []):
        out.append(_fault(is_object & F.try_variant_get(v, _member(name), "variant").isNull(), below(name), "required", ""))
    for name, own in schema.get("properties", {}).items():
        inner = F.try_variant_get(v, _member(name), "variant")
        out.append(F.when(is_object, _bound(inner, lambda x: F.when(x.isNotNull(), compiled(own, x, below(name))).otherwise(_none()))).otherwise(_none()))
    if schema.get("additionalProperties") is False:
        more = F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))
        out.append(_fault(is_object & (F.size(more) > 0), path, "additionalProperties", F.array_join(F.array_sort(more), ",")))
    elif not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError("additionalProperties is read as true or false only")
    if "items" in schema:
        each = F.flatten(F.transform(items, lambda x, i: compiled(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        out.append(F.when(is_list, each).otherwise(_none()))
    for part in schema.get("allOf", []):
        out.append(compiled(part, v, path))
    if "if" in schema:
        holds = F.size(compiled(schema["if"], v, path)) == 0
        out.append(F.when(holds, compiled(schema.get("then", True), v, path)).otherwise(compiled(schema.get("else", True), v, path)))
    if "not" in schema:
        out.append(_fault(F.size(compiled(schema["not"], v, path)) == 0, path, "not", ""))
    return F.concat(*out) if out else _none()


def _tasks(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def schema_violations(rows: DataFrame, schema: dict, json: str = "json", ident: str = "id") -> DataFrame:
    """rows (ident, json text) -> id, path, rule, detail: a row a fault. A text that is null or no JSON has one fault, ``json``, and no other. One pass; rows
    without a fault leave nothing."""
    # Texts are dealt to all tasks, as a small file has many of them. A document is parsed once: by a projection of its own, and the faults are
    # an expression over its column.
    dealt = rows.select(F.col(ident).cast("string").alias("id"), F.col(json).alias("json")).repartition(_tasks(rows))
    parsed = dealt.select("id", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    faults = F.when(v.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"), F.lit("").alias("detail")))).otherwise(compiled(schema, v, F.lit("$")))
    return parsed.select("id", F.explode(faults).alias("f")).select("id", "f.path", "f.rule", "f.detail")


def total_violations(declared: DataFrame, counted: DataFrame) -> DataFrame:
    """declared (name, total) against counted (name, n; a name without a row: none) -> name, declared, actual where they differ. An undeclared (null)
    total is no fault; nor is what is counted without being declared."""
    met = declared.where(F.col("total").isNotNull()).join(counted, "name", "left").select("name", F.col("total").cast("long").alias("declared"), F.coalesce("n", F.lit(0)).cast("long").alias("actual"))
    return met.where(F.col("declared") != F.col("actual"))


def _of(kind, **more) -> dict:
    return {"type": kind, **more}


_TEXT, _MAYBE, _FILLED, _TEXTS = _of("string"), _of(["string", "null"]), _of("string", minLength=1), _of("array", items=_of("string"))


def item_schema(flags: tuple[str, ...] = (), kinds: tuple[str, ...] = (), verdicts: tuple[str, ...] = (), quote: int = 25) -> dict:
    """A pool item: its own fields, and its provenance, which an item made by a model must give more of. flags, kinds, verdicts: the allowed values."""
    among = lambda values: {"enum": list(values)} if values else {}
    made = _of("object", required=["model_family", "generation_date", "verifier_round"], properties={"model_family": _TEXT, "generation_date": _TEXT, "verifier_round": _of("number")})
    named = {k: _FILLED for k in ("source_origin", "verified_date", "verifier", "original_id")}
    by_model = {"if": {"properties": {"source_type": {"const": "ai_generated"}}, "required": ["source_type"]}, "then": {"required": ["ai_metadata"], "properties": {"ai_metadata": made}}}
    provenance = _of("object", required=["source_type", "verify_verdict", *named], properties={"source_type": among(kinds), "verify_verdict": among(verdicts), "prior_verify_verdict": among(verdicts), "quote": _of(["string", "null"], maxLength=quote), **named}, **by_model)
    option = _of("object", required=["key", "text"], properties={"key": _TEXT, "text": _TEXT})
    ambiguous = {"contains": {"const": "ambiguous"}}
    undecided = {"if": {"properties": {"provenance": {"properties": {"verify_verdict": {"const": "AMBIGUOUS"}}, "required": ["verify_verdict"]}}, "required": ["provenance"]}, "then": {"required": ["quality_flags"], "properties": {"quality_flags": ambiguous, "answer": {"enum": [None, ""]}}}}
    fields = {"id": _FILLED, "stem": _FILLED, "options": _of("array", minItems=1, items=option), "answer": _MAYBE, "year": _of(["integer", "null"]), "sources": _TEXTS, "quality_flags": _of("array", items=among(flags)), "provenance": provenance}
    return _of("object", required=["id", "stem", "options", "sources", "quality_flags", "provenance"], properties=fields, allOf=[undecided])
