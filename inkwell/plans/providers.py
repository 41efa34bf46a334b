"""Calls to outside models (OCR, extraction, merging) behind one interface, with a deterministic stand-in.

A provider is any picklable callable from a request (dict) to a response (dict); it is called inside tasks, once for each
distinct request, and its errors come back as values.  A log keeps answers across runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkwell.operators.grouping import pieces
from inkwell.sources.answers import AnswerLog
from inkwell.sources.store import stored

Provider = Callable[[dict], dict]


def call_provider(requests: DataFrame, provider: Provider, key: str = "request_id", log: AnswerLog | None = None) -> DataFrame:
    """key, response (JSON) and error for each distinct request (column ``request``: JSON; a column ``image``, a data URL, goes
    along with it).

    With a log only requests that it lacks are made, each once whatever its key is, and their answers are added to it before
    they are used.  An error is an answer to nobody: it is told, and the request is made again in the next run.
    """
    once = requests.dropDuplicates([key])
    if log is None:
        return _made(once, provider, [key])
    keyed = log.keyed(once)
    fresh = stored(_made(log.missing(keyed), provider, ["digest"]), "asked")
    log.add(fresh)
    answers = log.known(requests.sparkSession).withColumn("error", F.lit(None).cast("string")).unionByName(fresh.where("error IS NOT NULL"))
    return keyed.select(key, "digest").join(answers, "digest").select(key, "response", "error")


def answered(requests: DataFrame, provider: Provider, key: str, log: AnswerLog | None = None) -> DataFrame:
    """The rows of ``requests``, whose keys are distinct, with response and error.  Without a log a row stays where it is,
    and nothing is shuffled."""
    if log is None:
        return _made(requests, provider, requests.columns)
    requests = stored(requests, "requests")
    return requests.join(call_provider(requests.select(key, "request"), provider, key, log), key)


def _made(requests: DataFrame, provider: Provider, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with response and error, about a megabyte of requests at a time."""
    made = StructType([*(StructField(c, requests.schema[c].dataType) for c in keep), StructField("response", StringType()), StructField("error", StringType())])

    def ask(text: str, image: str | None) -> tuple[str | None, str | None]:
        try:
            request = json.loads(text) | ({"image": image} if image is not None else {})
            return json.dumps(provider(request), ensure_ascii=False), None
        except ValueError as e:  # said on purpose, so its text may be told
            return None, str(e)[:500] or "invalid value"
        except Exception:  # an outside service may fail in any way; what it says may hold secrets
            return None, "the service failed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                images = piece.column("image").to_pylist() if "image" in piece.schema.names else [None] * piece.num_rows
                said = [ask(text, image) for text, image in zip(piece.column("request").to_pylist(), images, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *(pa.array([x[i] for x in said], pa.string()) for i in (0, 1))], names=made.names)

    return requests.select(*dict.fromkeys([*keep, "request", *[c for c in ("image",) if c in requests.columns]])).mapInArrow(run, made)


def echo_lines(request: dict) -> dict:
    """Stand-in for extraction: each ``name: value`` line becomes a field with that line as its evidence."""
    fields, evidence = [], []
    for line in request["lines"]:
        name, colon, value = line["text"].partition(":")
        if colon and value.strip():
            evidence.append({"path": f"/data/fields/{len(fields)}/value", "line_ids": [line["id"]], "quote": value.strip()})
            fields.append({"name": name.strip(), "value": value.strip(), "value_type": "text"})
    return {"status": "complete", "data": {"document_type": None, "fields": fields}, "evidence": evidence, "issues": []}


def join_results(request: dict) -> dict:
    """Stand-in for merging: the fields of all results, one after another."""
    fields, evidence, issues = [], [], []
    for result in request["results"]:
        shift = len(fields)
        data = result["data"] or {"fields": []}
        fields += data["fields"]
        issues += result["issues"]
        for e in result["evidence"]:
            parts = e["path"].split("/")
            if len(parts) > 3:
                parts[3] = str(int(parts[3]) + shift)
            evidence.append({**e, "path": "/".join(parts)})
    status = "complete" if all(r["status"] == "complete" for r in request["results"]) else "partial"
    return {"status": status, "data": {"document_type": None, "fields": fields}, "evidence": evidence, "issues": issues}
