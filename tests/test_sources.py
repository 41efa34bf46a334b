import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from inkwell.sources import files, sinks
from inkwell.streaming import ingest


def test_files(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1.7\nbody"), ("b.pdf", b"nope"), ("c.txt", b"x"), ("d.png", b"x")):
        (tmp_path / name).write_bytes(body)
    found = files.read_files(spark, str(tmp_path)).withColumn("size", F.when(F.col("name") == "d.png", 0).otherwise(F.col("size")))  # Spark's scan passes over files without bytes
    got = {r.name: r.problem for r in files.validate_files(found).collect()}
    assert got == {"a.pdf": None, "b.pdf": "not a PDF", "c.txt": "unsupported kind of file", "d.png": "empty file"}
    assert files.batch_problems(files.read_files(spark, str(tmp_path))).first().problem is None


def test_truth(spark, tmp_path):
    child = {"grounding": {"page": 1, "range": {"start": 0, "end": 3}}, "atomic_grounding": [{"range": {"start": 0, "end": 2}, "box": {"xmin": 0, "ymin": 0, "xmax": 1, "ymax": 1}}]}
    (tmp_path / "one.parse.json").write_text(json.dumps({"markdown": "abc def", "structure": {"children": [child]}}))
    truth = files.read_truth(spark, str(tmp_path), ["one"])
    assert truth.first().structure[0].end == 3
    with pytest.raises(FileNotFoundError, match="three, two"):
        files.read_truth(spark, str(tmp_path), ["one", "two", "three"])


def test_zip(spark):
    rows = [(1, "x.pdf", "md1", "{}", "b"), (2, "x.png", "md2", "{}", "b"), (3, "y.pdf", "", "{}", "b")]
    out = sinks.result_zips(spark.createDataFrame(rows, "seq int, source_name string, markdown string, output_json string, batch string")).first()
    assert sorted(zipfile.ZipFile(io.BytesIO(out.content)).namelist()) == ["x-2.json", "x-2.md", "x.json", "x.md"]


def test_prompt(tmp_path):
    (tmp_path / "p.md").write_text("Hello {{NAME}}")
    text, digest = files.load_prompt(str(tmp_path), "p", NAME="{{NAME}}")
    assert text == "Hello {{NAME}}" and len(digest) == 64


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "artifact_id string, created_at long, status string").write.parquet(source)
    stream = spark.readStream.schema("artifact_id string, created_at long, status string").parquet(source)
    ingest.keep_latest(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"), 4).awaitTermination()
    assert {r.artifact_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": "y", "b": "z"}
    spark.createDataFrame([("a", 3, "new"), ("c", 1, "w")], "artifact_id string, created_at long, status string").write.mode("append").parquet(source)
    ingest.keep_latest(spark, stream, str(tmp_path / "out"), str(tmp_path / "cp"), 4).awaitTermination()
    assert {r.artifact_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": "new", "b": "z", "c": "w"}


def test_evaluation_files(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("e", 1, "x")], "doc_id string, page int, markdown string")
    lines = spark.createDataFrame([("d", "p1-l0001", 1, "one", 0.0, 0.0, 1.0, 1.0, "native", None)], "doc_id string, id string, page int, text string, x1 double, y1 double, x2 double, y2 double, source string, confidence double")
    parsed = sinks.candidates("legacy", pages, lines)
    got = {r.document: r for r in parsed.collect()}
    assert got["d"].markdown == "one\n\ntwo" and json.loads(got["d"].json)["lines"][0]["id"] == "p1-l0001" and json.loads(got["e"].json)["lines"] == []
    results = spark.createDataFrame([("legacy", "d", 0.5), ("legacy", "e", 0.25)], "policy string, document string, cer double")
    sinks.write_evaluation(str(tmp_path / "run"), parsed, results, spark.createDataFrame([("# report",)], "markdown string"))
    assert spark.read.json(str(tmp_path / "run/results")).count() == 2 and spark.read.text(str(tmp_path / "run/report")).first()[0] == "# report"
    zipped = sinks.run_zips(parsed, results).first()
    with zipfile.ZipFile(io.BytesIO(zipped.content)) as z:
        assert zipped.files == 6 and json.loads(z.read("legacy/d/metrics.json")) == {"cer": 0.5}


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", "########"), ("2024-01-01 00:02:00", "fine")], "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    row = ingest.anomaly_counts(df).first()
    assert (row.lines, row.anomalies) == (2, 1)


def test_queries_have_known_sql():
    from inkwell import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
