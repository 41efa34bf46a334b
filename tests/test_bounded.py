"""Python holds about a megabyte of a batch as objects, however large batches are."""

import pyarrow as pa

from inkwell.functions import text as X
from inkwell.operators import grouping


def test_texts_go_by_pieces(monkeypatch):
    texts = ["é" * 300, None, "", "x" * 5000, *["abc"] * 40]
    seen, whole = [], X.pa.array

    def array(values, *a, **k):
        seen.append(sum(len((x or "").encode()) for x in values))
        return whole(values, *a, **k)

    monkeypatch.setattr(X, "PIECE", 600)
    column = pa.array(["left out", *texts]).slice(1)
    monkeypatch.setattr(X.pa, "array", array)
    got = X._in_pieces(str.upper, column, pa.string())
    assert got.to_pylist() == [x and x.upper() for x in texts]
    assert len(seen) == 3 and sorted(seen) == [120, 600, 5000]
    assert X._in_pieces(str.upper, column.slice(0, 0), pa.string()).to_pylist() == []


def test_groups_are_cut_from_pieces(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000)), "t": ["x" * 100] * 1000})
    monkeypatch.setattr(grouping, "PIECE", 5000)
    sizes = [p.num_rows for p in grouping.pieces(batch)]
    assert sum(sizes) == 1000 and max(sizes) < 60
    rows = [(k, i, [(str(i), "é")], None if i % 3 else 0.5) for k in ("a", "b", None) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i int, own array<struct<id:string,t:string>>, d double")
    seen = lambda key, held: [(*key, len(held), [x["id"] for x in held[-1][1]], [r[0] for r in held] == list(range(700)), held[1][2] if held[1][2] == held[1][2] else float("nan"))]
    got = grouping.map_groups(df, ["k"], ["i"], seen, "k string, n int, ids array<string>, fine boolean, d double", ["i", "own", "d"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, 700, ["699"], True, None) for k in ("a", "b", None)], key=str)


def test_documents_are_normalised_once_for_their_error_rate(spark):
    from inkwell.operators import metrics

    read = spark.createDataFrame([(1, 1, "é  \nb"), (1, 2, "x" * 300), (2, 1, "same")], "document long, page int, markdown string")
    truth = spark.createDataFrame([(1, 1, "é\nb"), (1, 2, "y" + "x" * 300), (2, 1, "same"), (2, 2, "gone")], "document long, page int, markdown string")
    found = metrics.evaluate_documents(metrics.evaluate_pages(read, truth)).select("document", "cer").where("cer.edits IS NOT NULL")
    assert {r.document: (r.cer.edits, r.cer.rate) for r in found.collect()} == {1: (1, 1 / 306), 2: (6, 0.6)}
    plan = metrics.evaluate_documents(metrics.evaluate_pages(read, truth)).select("cer")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(regexp_replace(") <= 4
