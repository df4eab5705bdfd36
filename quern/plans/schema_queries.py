"""Catalogue: gates compiled from schemas, over parts as JSON documents with faults of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import schema

from .catalog import query
from .text_queries import _read

_PART = {
    "type": "object", "required": ["id", "brand", "size"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 1}, "brand": {"type": ["string", "null"], "enum": [f"Brand#{n}" for n in range(1, 60)] + [None]}, "size": {"type": "integer", "maximum": 45}, "name": {"type": "string", "maxLength": 30},
                   "options": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "object", "required": ["key"], "properties": {"key": {"pattern": "^[A-D]$"}}}}, "extra": False},
    "if": {"properties": {"size": {"maximum": 5}}}, "then": {"required": ["name"]},
}


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, p_size, p_name, p_brand FROM part)
SELECT id, '$.id' AS path, 'minimum' AS rule, id AS detail FROM p WHERE k < 1
UNION ALL SELECT id, '$.brand' AS path, 'required' AS rule, '' AS detail FROM p WHERE k % 7 = 0
UNION ALL SELECT id, '$.brand', 'enum', '"' || p_brand || 'x"' FROM p WHERE k % 7 = 1
UNION ALL SELECT id, '$.size', 'type', 'integer' FROM p WHERE k % 7 = 2
UNION ALL SELECT id, '$.size', 'maximum', CAST(p_size AS VARCHAR) FROM p WHERE k % 7 <> 2 AND p_size > 45
UNION ALL SELECT id, '$.name', 'maxLength', CAST(length(p_name) AS VARCHAR) FROM p WHERE k % 7 <> 3 AND length(p_name) > 30
UNION ALL SELECT id, '$.name', 'required', '' FROM p WHERE k % 7 = 3 AND p_size <= 5
UNION ALL SELECT id, '$.options', 'minItems', '0' FROM p WHERE k % 7 = 4
UNION ALL SELECT id, '$.options', 'uniqueItems', '' FROM p WHERE k % 7 = 5
UNION ALL SELECT id, '$.options[1].key', 'pattern', '^[A-D]$' FROM p WHERE k % 7 = 6
UNION ALL SELECT id, '$', 'additionalProperties', 'other' FROM p WHERE k % 5 = 0""")
def schema_gate(spark, d):
    p, k = _read(spark, d, "part"), F.col("p_partkey")
    key = lambda v: F.struct(v.alias("key"))
    second = F.when(k % 7 == 5, "A").when(k % 7 == 6, "E").otherwise("B")
    options = F.when(k % 7 == 4, F.array().cast("array<struct<key: string>>")).otherwise(F.array(key(F.lit("A")), key(second)))
    size = F.when(k % 7 == 2, F.lit('"big"')).otherwise(F.col("p_size").cast("string"))
    field = lambda name, value, keep: F.when(keep, F.concat(F.lit(f'"{name}":'), value))
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.substring(quoted(c), F.lit(2), F.length(quoted(c)) - 2)
    brand = inner(F.when(k % 7 == 1, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")))
    fields = F.concat_ws(",", field("id", k.cast("string"), F.lit(True)), field("brand", brand, k % 7 != 0), field("size", size, F.lit(True)), field("name", inner(F.col("p_name")), k % 7 != 3), field("options", F.to_json(options), F.lit(True)), field("other", F.lit("1"), k % 5 == 0))
    docs = p.select(k.cast("string").alias("id"), F.concat(F.lit("{"), fields, F.lit("}")).alias("json"))
    return schema.schema_violations(docs, _PART)


@query("""SELECT event_type AS name, 2000 AS declared, count(*) AS actual FROM events WHERE event_type <> 'view' GROUP BY 1 HAVING count(*) <> 2000 UNION ALL SELECT 'refund', 2000, 0""")
def declared_totals(spark, d):
    counted = _read(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    declared = counted.select("name", F.when(F.col("name") != "view", 2000).alias("total")).unionByName(counted.limit(1).select(F.lit("refund").alias("name"), F.lit(2000).alias("total")))
    return schema.total_violations(declared, counted)
