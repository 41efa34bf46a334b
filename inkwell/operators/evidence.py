"""Grounding of extracted values: every leaf needs evidence, every evidence must quote lines that exist."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from inkwell.functions import pointers as P
from inkwell.functions import text as X
from inkwell.operators import schemas as S
from inkwell.operators.grouping import pieces

SCHEMA_BYTES = 100 * 1024
CODES = ("unreadable", "ambiguous", "missing", "unsupported", "conflict")
STATUSES = ("complete", "partial", "failed")


#: JSON Schema (2020-12): names of types; keywords whose value is a schema, an array or an object of schemas; and keywords
#: with a value of one kind.
TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
ONE = ("additionalProperties", "contains", "contentSchema", "else", "if", "items", "not", "propertyNames", "then", "unevaluatedItems", "unevaluatedProperties")
MANY = ("allOf", "anyOf", "oneOf", "prefixItems")
NAMED = ("$defs", "definitions", "dependentSchemas", "patternProperties", "properties")
COUNTS = ("maxContains", "maxItems", "maxLength", "maxProperties", "minContains", "minItems", "minLength", "minProperties")
NUMBERS = ("exclusiveMaximum", "exclusiveMinimum", "maximum", "minimum", "multipleOf")
STRINGS = ("$anchor", "$comment", "$id", "$schema", "contentEncoding", "contentMediaType", "description", "format", "pattern", "title")


def _keyword_problem(name: str, value: object) -> str | None:
    """What is wrong with the value of one keyword, by itself."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if name == "type":
        kinds = value if isinstance(value, list) else [value]
        fine = bool(kinds) and all(isinstance(k, str) and k in TYPES for k in kinds) and len(set(map(str, kinds))) == len(kinds)
        return None if fine else "type must name known types"
    if name == "required":
        fine = isinstance(value, list) and all(isinstance(x, str) for x in value) and len(set(value)) == len(value)
        return None if fine else "required must list distinct names"
    if name == "pattern" and isinstance(value, str) or name == "patternProperties" and isinstance(value, dict):
        try:
            [re.compile(x) for x in ([value] if isinstance(value, str) else value)]
        except re.error:
            return f"{name} is no regular expression"
    lists = isinstance(value, dict) and all(isinstance(x, list) and all(isinstance(k, str) for k in x) for x in value.values())
    tests = {
        "enum": isinstance(value, list),
        "dependentRequired": lists,
        "uniqueItems": isinstance(value, bool),
        **dict.fromkeys(ONE, isinstance(value, (dict, bool))),
        **dict.fromkeys(MANY, isinstance(value, list) and bool(value)),
        **dict.fromkeys(NAMED, isinstance(value, dict)),
        **dict.fromkeys(COUNTS, number and value >= 0 and value == int(value)),
        **dict.fromkeys(NUMBERS, number and (name != "multipleOf" or value > 0)),
        **dict.fromkeys(STRINGS, isinstance(value, str)),
    }
    return None if tests.get(name, True) else f"{name} has a value of the wrong kind"


def _subschemas(schema: dict) -> Iterator[tuple[str, object]]:
    for name in ONE:
        yield from [(name, schema[name])] if name in schema else []
    for name in MANY:
        yield from ((f"{name}/{i}", x) for i, x in enumerate(schema.get(name) if isinstance(schema.get(name), list) else []))
    for name in NAMED:
        yield from ((f"{name}/{k}", x) for k, x in (schema.get(name) if isinstance(schema.get(name), dict) else {}).items())


def _closed(schema: dict) -> list[str]:
    """What keeps an object's schema from being closed."""
    own = schema.get("properties", {})
    own = set(own) if isinstance(own, dict) else set()
    required = schema.get("required", [])
    missing = own != {x for x in required if isinstance(x, str)} if isinstance(required, list) else True
    return ["additionalProperties must be false"] * (schema.get("additionalProperties") is not False) + ["every property must be required"] * missing


def schema_problems(schema: object) -> list[str]:
    """What keeps a user's JSON Schema from being the strict subset: a valid schema of an object, of at most 100 KiB, whose
    objects are closed and require all their properties, without references anywhere."""
    if not isinstance(schema, dict):
        return ["the schema must be an object"]
    problems = ["the schema is larger than 100 KiB"] * (len(json.dumps(schema).encode()) > SCHEMA_BYTES) + ["the root must be of type object"] * (schema.get("type") != "object")
    level: list[tuple[str, object]] = [("#", schema)]
    depth = 0
    while level:  # all schemas of one depth
        if depth > S.DEEPEST:
            return [*problems, "the schema is nested too deeply"]
        depth += 1
        below: list[tuple[str, object]] = []
        for at, one in level:
            if isinstance(one, bool):
                continue
            if not isinstance(one, dict):
                problems.append(f"{at}: not a schema")
                continue
            kinds = one.get("type")
            found = ["references are not supported"] * any(k in one for k in ("$ref", "$dynamicRef"))
            found += [x for x in (_keyword_problem(k, v) for k, v in one.items()) if x]
            found += _closed(one) if "properties" in one or "object" in (kinds if isinstance(kinds, list) else [kinds]) else []
            problems += [f"{at}: {x}" for x in found]
            below += [(f"{at}/{name}", x) for name, x in _subschemas(one)]
        level = below
    return problems


def generic_schema() -> dict:
    """The schema for documents without one of their own: a type and a list of named values."""
    kinds = ["text", "number", "date", "currency", "boolean", "other"]
    field = {"type": "object", "additionalProperties": False, "required": ["name", "value", "value_type"], "properties": {"name": {"type": "string"}, "value": {"type": ["string", "null"]}, "value_type": {"type": "string", "enum": kinds}}}
    return {"type": "object", "additionalProperties": False, "required": ["document_type", "fields"], "properties": {"document_type": {"type": ["string", "null"]}, "fields": {"type": "array", "items": field}}}


def conforms(value: object, schema: dict) -> bool:
    """Whether a value meets a schema (``read_envelopes`` compiles one once in each task instead)."""
    return not S.problems_of(value, S.compile_schema(schema))


def read_envelope(text: str | None, compiled: S.Schema) -> tuple[str | None, list[dict], list[str], int, list[str], bool]:
    """Status, evidence, leaves, number of issues, errors of shape and whether there is data, of one result (JSON text)."""
    try:
        x = S.read_json(text)
        errors = []
    except ValueError:
        return None, [], [], 0, ["the result is not JSON"], False
    if not isinstance(x, dict) or set(x) != {"status", "data", "evidence", "issues"}:
        return None, [], [], 0, ["the result must hold status, data, evidence and issues"], False
    if x["status"] not in STATUSES:
        errors.append("unknown status")
    evidence = []
    for e in x["evidence"] if isinstance(x["evidence"], list) else [None]:
        if isinstance(e, dict) and set(e) == {"path", "line_ids", "quote"} and isinstance(e["path"], str) and isinstance(e["quote"], str) and isinstance(e["line_ids"], list) and all(isinstance(i, str) for i in e["line_ids"]):
            evidence.append(e)
        else:
            errors.append("malformed evidence")
    issues = x["issues"] if isinstance(x["issues"], list) else [None]
    if any(not isinstance(i, dict) or i.get("code") not in CODES or not isinstance(i.get("message"), str) for i in issues):
        errors.append("malformed issue")
    if x["data"] is not None:
        errors += [f"data{path or ' as a whole'} does not meet the schema: {keyword}" for path, keyword in S.problems_of(x["data"], compiled)]
    if x["status"] == "complete" and (x["data"] is None or issues):
        errors.append("a complete result needs data and has no issues")
    if x["status"] == "partial" and not issues:
        errors.append("a partial result needs issues")
    if x["status"] == "failed" and x["data"] is not None:
        errors.append("a failed result has no data")
    return x["status"], evidence, [p for p, _ in P.leaves(x["data"])], len(issues), errors, x["data"] is not None


def read_envelopes(extractions: DataFrame, schema: dict | None = None) -> DataFrame:
    """doc_id, status, evidence, leaves, issue count and errors of shape, from doc_id and result (JSON text)."""
    wanted = schema or generic_schema()
    kind = "status string, evidence array<struct<path:string,line_ids:array<string>,quote:string>>, leaves array<string>, n_issues int, errors array<string>, has_data boolean"

    def run(batches):
        names, compiled = ["status", "evidence", "leaves", "n_issues", "errors", "has_data"], S.compile_schema(wanted)
        for batch in batches:
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame([read_envelope(t, compiled) for t in batch.result], columns=names)], axis=1)

    return extractions.select("doc_id", "result").mapInPandas(run, "doc_id string, " + kind)


def check_evidence(read: DataFrame, lines: DataFrame, generic: bool = True, fold: bool = True) -> DataFrame:
    """Check each evidence: doc_id, ev_no, path, line_ids, quote, known_ids, path_ok, quote_ok, trusted.

    Lines are joined by one blank in the order cited; the quote must occur in them, white space and case aside
    (``fold=False``: lower case stays in the JVM, for ASCII).  No evidence refers to what its document does not hold.
    """
    # Looked up before the evidence is a row each, so a document's leaves are not copied to all of its rows.
    known = F.transform("evidence", lambda e: F.struct(e["path"].alias("path"), e["quote"].alias("quote"), e["line_ids"].alias("line_ids"), F.array_contains("leaves", e["path"]).alias("path_ok")))
    each = read.select("doc_id", F.posexplode(known).alias("ev_no", "e")).select("doc_id", "ev_no", "e.path", "e.quote", "e.line_ids", "e.path_ok")
    cited = each.select("doc_id", "ev_no", F.posexplode_outer("line_ids").alias("pos", "id"))
    joined = cited.join(lines.select("doc_id", "id", "text"), ["doc_id", "id"], "left").groupBy("doc_id", "ev_no").agg(
        (F.bool_and(F.col("text").isNotNull()) & (F.count("id") > 0)).alias("known_ids"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))), lambda s: s["text"]), " ").alias("cited"),
    )
    lower = X.casefold if fold else F.lower
    plain = lambda c: lower(X.normalize_inline(c, compose=fold))
    checked = each.join(joined, ["doc_id", "ev_no"]).select("doc_id", "ev_no", "path", "line_ids", "quote", "known_ids", "path_ok", (plain(F.col("cited")).contains(plain(F.col("quote"))) & (plain(F.col("quote")) != "")).alias("quote_ok"))
    return checked.withColumn("trusted", F.col("known_ids") & F.col("path_ok") & F.col("quote_ok"))


def uncovered_leaves(read: DataFrame, checked: DataFrame, generic: bool = True) -> DataFrame:
    """Leaves that need evidence and have none that is trusted; names and kinds of generic fields need none."""
    need = read.select("doc_id", F.explode("leaves").alias("path"))
    need = need.where(~P.is_generic_metadata(F.col("path"))) if generic else need
    return need.join(checked.where("trusted").select("doc_id", "path"), ["doc_id", "path"], "left_anti")


#: What ``check_envelopes`` adds to a row.
FOUND = "status string, has_data boolean, n_issues int, errors array<string>, trusted array<struct<ev_no:int,path:string,line_ids:array<string>,quote:string>>, cited array<struct<id:string,text:string>>"


def check_envelope(text: str | None, lines: Callable[[], list[dict] | None], compiled: S.Schema, generic: bool) -> tuple:
    """FOUND for one result and the lines that it may cite (only asked for if there is evidence); the rules are those of
    ``check_evidence`` and ``uncovered_leaves``."""
    status, evidence, leaves, n_issues, errors, has_data = read_envelope(text, compiled)
    fold = lambda s: " ".join(unicodedata.normalize("NFC", s).split()).casefold()
    known: dict[str, list[str]] = defaultdict(list)
    for x in (lines() or []) if evidence else []:
        if x["text"] is not None:
            known[x["id"]].append(x["text"])
    there, trusted, more = set(leaves), [], []
    for no, e in enumerate(evidence):
        ids, quote = e["line_ids"], fold(e["quote"])
        if not ids or any(i not in known for i in ids):
            more.append(f"unknown lines: {e['path']}")
        elif e["path"] not in there:
            more.append(f"no such leaf: {e['path']}")
        elif not quote or quote not in fold(" ".join(t for i in ids for t in sorted(known[i]))):
            more.append(f"quote not found: {e['path']}")
        else:
            trusted.append({"ev_no": no, **e})
    proved = {e["path"] for e in trusted}
    more += [f"no evidence: {p}" for p in leaves if p not in proved and not (generic and P.GENERIC_METADATA.fullmatch(p))]
    cited = sorted({(i, t) for e in trusted for i in e["line_ids"] for t in known[i]})
    return status, has_data, n_issues, errors + sorted(more), trusted or None, [{"id": i, "text": t} for i, t in cited]


def check_envelopes(rows: DataFrame, schema: dict | None = None) -> DataFrame:
    """The rows with FOUND: each result (JSON text) is checked against the lines (array of id, text) in its own row, so
    nothing is shuffled.  ``cited`` are the lines of the trusted evidence, each once, in order."""
    wanted, found = schema or generic_schema(), StructType.fromDDL(FOUND)
    made = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), *found])
    kinds = to_arrow_schema(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = S.compile_schema(wanted)
        for batch in batches:
            for piece in pieces(batch):
                own = piece.column("lines")
                out = [check_envelope(t, lambda i=i: own[i].as_py(), compiled, schema is None) for i, t in enumerate(piece.column("result").to_pylist())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True))], names=made.names)

    return rows.mapInArrow(run, made)


def validate_extractions(extractions: DataFrame, lines: DataFrame, schema: dict | None = None) -> DataFrame:
    """doc_id, status, errors (array), trusted evidence: all checks together."""
    own = lines.groupBy("doc_id").agg(F.collect_list(F.struct("id", "text")).alias("lines"))
    rows = extractions.select("doc_id", "result").join(own, "doc_id", "left")
    return check_envelopes(rows, schema).select("doc_id", "status", "has_data", "n_issues", "errors", "trusted")
