"""Small helpers that no larger test reaches."""

import json

from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import history, lines, metrics
from inkwell.plans import process
from inkwell.sources import files


def test_composed_and_folded_texts(spark):
    texts = ["Plain ASCII", "e\u0301 Stra\u00dfe", "", None, "\u0130I", "A\u030a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.f) for r in df.select("i", X.nfc(F.col("t")).alias("n"), X.casefold(F.col("t")).alias("f")).collect()}
    import unicodedata

    assert got == {i: (t if t is None else unicodedata.normalize("NFC", t), t if t is None else t.casefold()) for i, t in enumerate(texts)}


def test_error_rates_of_short_and_long_texts(spark):
    long = "ab\u00e9\U0001f600" * 200
    rows = [("kitten", "sitting"), ("\U0001f600a", "a"), ("", ""), (long, long[3:] + "zz"), ("x", long), (None, "a")]
    got = [r.c for r in spark.createDataFrame(rows, "a string, b string").select(X.cer(F.col("a"), F.col("b")).alias("c")).collect()]
    assert [c.edits for c in got] == [3, 1, 0, X.edit_distance(*rows[3]), 800, None]
    assert got[1].rate == 1.0 and got[1].score == 0.0 and got[2].score == 1.0


def test_range_text_of_a_choice(spark):
    df = spark.createDataFrame([("all", 1, 2), ("single", 3, 9), ("range", 2, 5)], "scope string, first int, last int")
    text = files.range_text(F.col("scope"), F.col("first"), F.col("last"))
    assert [r.t for r in df.select(text.alias("t")).collect()] == ["", "3", "2-5"]
    assert [r.p.pages for r in df.select(files.page_range(text).alias("p")).collect()] == [None, [3], [2, 3, 4, 5]]


def test_what_a_caller_gets_of_lines(spark):
    kind = "array<struct<text:string,bbox:array<double>,confidence:double,polygon:array<array<double>>,source_kind:string>>"
    df = spark.createDataFrame([([("a", [0.0, 1.0, 2.0, 3.0], 0.5, None, "printed")],)], f"lines {kind}")
    assert json.loads(df.select(process.response_json(F.col("lines"))).first()[0]) == {"results": [{"text": "a", "bbox": [0.0, 1.0, 2.0, 3.0], "confidence": 0.5}]}


def test_lines_of_pages(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")
    own = spark.createDataFrame([("d", 1, "p1-l0002"), ("d", 1, "p1-l0001"), ("d", 3, "p3-l0001")], "doc_id string, page int, id string")
    assert [tuple(r) for r in lines.page_lines(pages, own).collect()] == [("d", 1, ["p1-l0001", "p1-l0002"])]


def test_missing_pages_and_runs(spark):
    selected = spark.createDataFrame([("d", 1), ("d", 2)], "document string, page int")
    assert [r.page for r in metrics.missing_pages(selected, selected.where("page = 1")).collect()] == [2]
    runs = metrics.corpus_runs(selected.select("document").distinct(), ["legacy", "accuracy"])
    assert sorted(r.policy for r in runs.collect()) == ["accuracy", "legacy"]


def test_total_of_stored_bytes(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 7)], "artifact_id string, retained_bytes bigint")
    assert history.total_bytes(rows).first()[0] == 12 and history.total_bytes(rows.limit(0)).first()[0] == 0


def test_options_are_typed_again(spark):
    texts = ["{}", '{"extract_data": true, "schema": {"type": "object"}, "target_pages": "1-2", "accuracy_policy": "legacy", "instructions": null}', '{"extract_data": "yes"}', '{"unknown": 1}', '{"accuracy_policy": "other"}', "[]", "no json", None, '{"language": 3}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", history.typed_options(F.col("t")).alias("o"))
    got = {r.i: r.o for r in df.select("i", F.when(F.col("o").isNotNull(), F.struct("o.extract_data", "o.target_pages", "o.accuracy_policy", "o.language", "o.instructions", F.to_json("o.schema").alias("schema"))).alias("o")).collect()}
    assert tuple(got[0]) == (False, None, "accuracy", "auto", "", None) and tuple(got[1]) == (True, "1-2", "legacy", "auto", "", '{"type":"object"}')
    assert all(got[i] is None for i in range(2, 9))


def test_candidates_hold_repairs_and_issues(spark):
    from inkwell.sources import sinks

    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "doc_id string, page int, markdown string")
    own = spark.createDataFrame([("d", 1, "l1", "t", 0.0, 1.0, 2.0, 3.0, "native", None)], "doc_id string, page int, id string, text string, x1 double, y1 double, x2 double, y2 double, source string, confidence double")
    repairs = spark.createDataFrame([("d", 1, "p1-r001", [0.0, 0.0, 1.0, 1.0], "low confidence", 1, 2, "majority", 3)], "doc_id string, page int, region_id string, bbox array<double>, reason string, replaced_lines int, added_lines int, status string, ocr_calls int")
    issues = spark.createDataFrame([("d", "page_error", "m", "parsing")], "doc_id string, code string, message string, stage string")
    body = json.loads(sinks.candidates("accuracy", pages, own, repairs, issues).first().json)
    assert body["repairs"][0]["added_lines"] == 2 and body["issues"] == [{"code": "page_error", "message": "m", "stage": "parsing"}]
    assert body["processed_pages"] == [1, 2] and body["markdown"] == "a\n\nb"
    bare = json.loads(sinks.candidates("accuracy", pages, own).first().json)
    assert bare["repairs"] == bare["issues"] == []


def test_edit_distances_are_spread_over_tasks(spark):
    from inkwell.plans import queries

    assert queries.cer_pairs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
