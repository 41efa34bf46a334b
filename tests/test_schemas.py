"""Checks against JSON Schema: cases of the draft, what is unevaluated, hard values, and pointers into VARIANT."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions import pointers as P
from inkwell.operators import evidence, schemas

CASES = [
    # schema, values that meet it, values that don't
    ({"maxLength": 1}, ["a", "é", "\U0001f600", 12, None], ["abc"]),
    ({"pattern": "^x"}, ["xyz", 3], ["abc"]),
    ({"minimum": 5}, [5, 5.0, "1", True], [1, 4.999]),
    ({"const": 3}, [3, 3.0], [4, "3", True]),
    ({"const": {"a": [1, False]}}, [{"a": [1.0, False]}], [{"a": [1, 0]}, {"a": [1]}]),
    ({"allOf": [{"type": "string"}, {"minLength": 2}]}, ["ab"], [7, "a"]),
    ({"oneOf": [{"type": "string"}, {"type": "string"}]}, [], ["x", 1]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 9], [6, 5]),
    ({"not": {"type": "string"}}, [1, None], ["x"]),
    ({"maxItems": 1}, [["a"], "ab"], [["a", "b"]]),
    ({"prefixItems": [{"type": "integer"}]}, [[1, "x"], [], [1.0]], [["x"]]),
    ({"prefixItems": [{"type": "integer"}], "items": False}, [[1]], [[1, 2]]),
    ({"enum": [1]}, [1, 1.0], [True, "1"]),
    ({"enum": [None, [0], {"k": False}]}, [None, [0], {"k": False}], [0, [False], {"k": 0}, []]),
    ({"type": "integer"}, [1, 1.0, -3, 10**30], [1.5, True, "1"]),
    ({"type": ["number", "null"]}, [None, 0.5], [False, []]),
    ({"multipleOf": 0.1}, [0.3, 1, -0.7], [0.35]),
    ({"exclusiveMaximum": 3, "exclusiveMinimum": 1}, [2], [1, 3]),
    ({"uniqueItems": True}, [[1, True], [[0], [False]], [{"a": 1}, {"a": "1"}]], [[1, 1.0], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
    ({"contains": {"type": "null"}, "minContains": 2, "maxContains": 3}, [[None, None], [None, 1, None, None]], [[None], [None] * 4, []]),
    ({"contains": {"const": 1}, "minContains": 0}, [[]], []),
    ({"required": ["a"], "minProperties": 2, "maxProperties": 2}, [{"a": 1, "b": 2}], [{"b": 1, "c": 1}, {"a": 1}, {"a": 1, "b": 2, "c": 3}]),
    ({"properties": {"a": {"type": "string"}}, "patternProperties": {"^n": {"type": "number"}}, "additionalProperties": False}, [{"a": "x", "n1": 2}, {}], [{"a": 1}, {"n1": "x"}, {"z": 1}]),
    ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}], [{"abc": 1}]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 2}}, ["ab", 3], ["a", 1]),
    ({"dependentRequired": {"a": ["b"]}, "dependentSchemas": {"c": {"required": ["d"]}}}, [{"a": 1, "b": 1}, {"c": 1, "d": 1}, {}], [{"a": 1}, {"c": 1}]),
    ({"anyOf": [{"properties": {"a": {"const": 1}}, "required": ["a"]}, {"properties": {"b": True}, "required": ["b"]}], "unevaluatedProperties": False}, [{"a": 1}, {"b": 2}, {"a": 1, "b": 2}], [{"a": 1, "z": 1}, {"a": 2}, {"a": 2, "b": 1}]),
    ({"prefixItems": [True], "contains": {"type": "string"}, "unevaluatedItems": {"type": "null"}}, [[1, "x", None], ["x"]], [[1, "x", 2], [1]]),
    (True, [1, None], []),
    (False, [], [1, None]),
    ({"format": "date", "contentEncoding": "base64", "title": 3}, ["no date"], []),
]


@pytest.mark.parametrize(("schema", "good", "bad"), CASES, ids=[json.dumps(c[0])[:40] for c in CASES])
def test_draft(schema, good, bad):
    compiled = schemas.compile_schema(schema)
    for value in good:
        assert schemas.problems_of(value, compiled) == [], value
    for value in bad:
        assert schemas.problems_of(value, compiled), value
    if isinstance(schema, dict):
        assert all(evidence.conforms(v, schema) for v in good)


def test_where_and_why():
    schema = {"type": "object", "properties": {"a~/b": {"type": "array", "items": {"maximum": 3}}}, "additionalProperties": False, "required": ["c"]}
    compiled = schemas.compile_schema(schema)
    assert schemas.problems_of({"a~/b": [1, 5, 9], "z": 1}, compiled) == [("", "required"), ("/a~0~1b/1", "maximum"), ("/a~0~1b/2", "maximum"), ("", "additionalProperties")]


def test_schemas_that_cannot_be_read():
    deep = {"type": "string"}
    for _ in range(schemas.DEEPEST + 5):
        deep = {"not": deep}
    for bad in (deep, {"$ref": "#"}, {"items": {"$dynamicRef": "#x"}}, {"not": 3}):
        with pytest.raises(ValueError):
            schemas.compile_schema(bad)
    closed = {"type": "object", "additionalProperties": False, "required": ["a"]}
    for part in (deep, {"pattern": "("}, {"patternProperties": {"[": True}}, {"uniqueItems": 1}, {"dependentRequired": {"a": "b"}}):
        assert evidence.schema_problems({**closed, "properties": {"a": part}})


def test_check_json(spark):
    texts = ['{"a": 1}', '{"a": "x"}', "{", None, "NaN", "[" * 100_000, '{"a": ' + "[" * 900 + "]" * 900 + "}", '{"a": ' + "9" * 6000 + "}"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "i int, text string, problems string")
    schema = {"type": "object", "properties": {"a": {"type": "integer"}}}
    got = {r.i: [tuple(p) for p in r.problems] for r in schemas.check_json(docs, schema, json_column="text", keep=["i"]).collect()}
    assert got[0] == [] and got[1] == [("/a", "type")] and all(got[i] == [("", "json")] for i in (2, 3, 4, 5)) and got[6] == [("/a", "type")] and got[7] == [("", "json")]
    assert schemas.check_json(docs.limit(0), schema, json_column="text", keep=["i"]).count() == 0
    deep = {"items": {}}
    for _ in range(300):
        deep = {"items": deep}
    nested = spark.createDataFrame([(1, "[" * 900 + "]" * 900)], "i int, text string")
    assert schemas.check_json(nested, deep, json_column="text", keep=["i"]).first().problems in ([], [("", "depth")])


BODIES = ['{"a":{"b/c":[1,{"x~y":"q","n":null}],"0":"zero"},"e":{},"f":[],"t":true,"d":1.5,"it\'s \\"":"odd","":"blank"}', "[[],[2]]", '"text"', "null", "no json", None]


@pytest.mark.parametrize("depth", [None, 5])
def test_leaf_pointers_of_variants(spark, depth):
    docs = spark.createDataFrame(list(enumerate(BODIES)), "i int, body string").select("i", F.try_parse_json("body").alias("v"))
    got = sorted((r.i, r.path, r.value) for r in P.leaf_pointers(docs, "v", depth).collect())
    want = []
    for i, body in enumerate(BODIES[:4]):
        want += [(i, p, v if isinstance(v, str) else json.dumps(v)) for p, v in P.leaves(json.loads(body))]
    assert got == sorted(want) and len(got) == 9


def test_resolved_pointers(spark):
    value = json.loads(BODIES[0])
    paths = [p for p, _ in P.leaves(value)] + ["/data/a/0", "/data/a/b~1c/1", "/data/a/b~1c/2", "/data/a/b~1c/x", "/data/a/b~1c/1/n", "/data/e", "/data/nothing", "/data", "/other", "/data/d/0", "/data/a/b~1c/00"]
    docs = spark.createDataFrame([(BODIES[0], p) for p in paths], "body string, path string").select("path", F.parse_json("body").alias("v"))
    got = {r.path: r.j for r in docs.select("path", F.to_json(P.resolved(F.col("v"), F.col("path"))).alias("j")).collect()}
    for path in paths:
        try:
            want = json.loads(json.dumps(P.resolve(value, path)))
        except LookupError:
            assert got[path] is None, path
        else:
            assert got[path] is not None and json.loads(got[path]) == want, path
