"""Extraction brings each line to its chunk once, and checks an answer in the row of its request."""

import json

from pyspark.sql import functions as F

from inkwell.operators import evidence
from inkwell.plans import extract, providers
from inkwell.sources.answers import AnswerLog


def told(n, doc="d"):
    return [(doc, f"l{i}", f"name{i}: value{i}") for i in range(n)]


def chunks_of(spark, lines):
    number = {}
    rows = [(d, number.setdefault(d, []).append(i) or len(number[d]) - 1, [i]) for d, i, _ in lines]
    return spark.createDataFrame(rows, "doc_id string, chunk_no int, line_ids array<string>")


def test_lines_are_read_once(spark):
    """Every further reading is a shuffle of all text."""
    rows = told(12) + told(3, "e")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lines = spark.createDataFrame(rows, "doc_id string, id string, text string").mapInArrow(seen, "doc_id string, id string, text string")
    done = extract.extract_chunks(chunks_of(spark, rows), lines, providers.echo_lines)
    merged = {r.doc_id: json.loads(r.result) for r in extract.merge_tree(done, providers.join_results, lines).collect()}
    assert {d: [f["value"] for f in x["data"]["fields"]] for d, x in merged.items()} == {"d": [f"value{i}" for i in range(12)], "e": ["value0", "value1", "value2"]}
    assert read.value == len(rows)


def test_rows_are_checked_as_tables_are(spark):
    """The check in a row finds what the joins of evidence, lines and leaves find."""
    cite = lambda path, ids, quote: {"path": path, "line_ids": ids, "quote": quote}
    field = lambda value: {"name": "n", "value": value, "value_type": "text"}
    at = "/data/fields/{}/value".format
    cases = [
        ([field("a")], [cite(at(0), ["l1"], "STRASSE  é")]),
        ([field("a"), field("b")], [cite(at(0), ["l2", "l1"], "three X  stra"), cite(at(1), ["l1", "l2"], "three X  stra")]),
        ([field("a"), field(None)], [cite(at(0), ["l1", "l9"], "stra"), cite(at(1), ["l1"], "stra")]),
        ([field("a")], [cite(at(0), [], "stra"), cite(at(7), ["l1"], "stra"), cite(at(0), ["l1"], "  ")]),
        ([field("a")], [cite(at(0), ["l3"], "x"), cite(at(0), ["twin"], "one other")]),
        ([field("a"), field("b")], []),
    ]
    rows = [(f"d{i}", json.dumps({"status": "complete", "data": {"document_type": None, "fields": f}, "evidence": e, "issues": []})) for i, (f, e) in enumerate(cases)] + [("gone", None), ("text", "[1")]
    given = spark.createDataFrame(rows, "doc_id string, result string")
    own = [("l1", "x Straße　é y"), ("l2", "one\x1ftwo three"), ("l3", None), ("twin", "other"), ("twin", "one")]
    lines = spark.createDataFrame([(d, i, t) for d, _ in rows[:-1] for i, t in own], "doc_id string, id string, text string")
    read = evidence.read_envelopes(given)
    checked = evidence.check_evidence(read, lines)
    good = {(r.doc_id, r.ev_no) for r in checked.where("trusted").collect()}
    bare = {(r.doc_id, r.path) for r in evidence.uncovered_leaves(read, checked).collect()}
    shape = {r.doc_id: r.errors for r in read.collect()}
    bad = {d: sum(r.doc_id == d for r in checked.where("not trusted").select("doc_id").collect()) for d, _ in rows}
    got = {r.doc_id: r for r in evidence.validate_extractions(given, lines).collect()}
    assert {(d, t.ev_no) for d, r in got.items() for t in r.trusted or []} == good and {d for d, _ in good} == {"d0", "d1", "d4"}
    assert {(d, e.removeprefix("no evidence: ")) for d, r in got.items() for e in r.errors if e.startswith("no evidence: ")} == bare
    assert {d: len(r.errors) for d, r in got.items()} == {d: len(shape[d]) + bad[d] + sum(b[0] == d for b in bare) for d, _ in rows}


def test_results_carry_the_lines_they_cite(spark):
    """Up three levels with groups of one; results that come without their lines get them looked up."""
    rows = told(5) + [("d", "l5", "nothing")]
    lines = spark.createDataFrame(rows, "doc_id string, id string, text string")
    done = extract.extract_chunks(chunks_of(spark, rows), lines, providers.echo_lines)
    assert {r.chunk_no: [tuple(x) for x in r.cited] for r in done.collect()} == {i: [r[1:]] if i < 5 else [] for i, r in enumerate(rows)}

    def merge(request):
        """Fails unless it is told each line that its parts cite, once."""
        assert [x["id"] for x in request["lines"]] == sorted({i for r in request["results"] for e in r["evidence"] for i in e["line_ids"]})
        return providers.join_results(request)

    for given in (done, done.drop("cited")):
        out = extract.merge_tree(given, merge, lines, fan_in=2).first()
        assert out.status == "complete" and len(json.loads(out.result)["evidence"]) == 5
    first = lambda request: 1 / 0 if len(request["results"]) > 1 and request["results"][0]["evidence"][0]["line_ids"] == ["l2"] else providers.join_results(request)
    out = extract.merge_tree(done, first, lines, fan_in=2).first()
    assert out.status == "partial" and [e["line_ids"] for e in json.loads(out.result)["evidence"]] == [["l0"], ["l1"], ["l2"], ["l4"]]


def test_units_keep_their_columns_with_a_log(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i}", json.dumps({"lines": told_lines}), told_lines, i) for i, told_lines in enumerate([[{"id": "l", "text": "a: b"}]] * 2)], "unit string, request string, lines array<struct<id:string,text:string>>, n int")
    log = AnswerLog(f"file://{tmp_path}/log", "echo")
    for one in (None, log, log):
        got = extract.call_checked(units, providers.echo_lines, log=one).orderBy("n").select("unit", "n", "status", F.size("cited").alias("k")).collect()
        assert [tuple(r) for r in got] == [("u0", 0, "complete", 1), ("u1", 1, "complete", 1)]
