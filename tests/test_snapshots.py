"""Commits of the history, and lines of readings that are put aside."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import history, regions
from inkwell.sources import snapshots
from inkwell.sources.snapshots import Conflict, History


def row(key, at, size=10, expires=1000):
    return (key, f"{key}.pdf", "h", "complete", "{}", "# m", "{}", None, at, expires, size)


def rows(spark, *given):
    return spark.createDataFrame(list(given), history.SCHEMA)


def names(df):
    return sorted((r.artifact_id, r.created_at) for r in df.collect())


def test_commits_and_conflicts(spark, tmp_path):
    table = History(spark, f"file://{tmp_path}/h")
    assert table.read().count() == 0 and table.manifest()["version"] == 0
    assert table.upsert(rows(spark, *[row(f"a{i}", i) for i in range(40)])) == 1
    first = table.read()
    before = table.manifest()["buckets"]
    assert table.upsert(rows(spark, row("a1", 50), row("b", 51, 5, 60))) == 2
    after = table.manifest()["buckets"]
    # Only buckets of new rows have new folders; a reader of the version before is not disturbed.
    touched = table.buckets_of(rows(spark, row("a1", 50), row("b", 51)))
    assert {int(b) for b in after if after[b] != before.get(b)} == touched
    assert names(first) == sorted((f"a{i}", i) for i in range(40)) == names(table.read(1))
    assert ("a1", 50) in names(table.read()) and ("a1", 1) not in names(table.read()) and table.read().count() == 41
    with pytest.raises(Conflict):
        table.upsert(rows(spark, row("c", 1)), base=1)
    assert table.read().count() == 41 and table.versions() == [1, 2]
    assert table.purge(60) == 3 and ("b", 51) not in names(table.read()) and ("b", 51) in names(table.read(2))
    assert table.purge(60) == 3
    kept = names(history.prune(table.read(), 75, "a0"))
    assert table.prune(75, "a0") == 4 and names(table.read()) == kept and ("a0", 0) in kept and len(kept) == 7
    assert table.vacuum() > 0 and table.versions() == [4] and names(table.read()) == kept
    with pytest.raises(ValueError, match="unknown status"):
        table.upsert(rows(spark, (*row("z", 1)[:3], "odd", *row("z", 1)[4:])))
    assert table.manifest()["made_by"] == "prune"


def test_empty_buckets_go(spark, tmp_path):
    table = History(spark, f"file://{tmp_path}/h")
    table.upsert(rows(spark, row("a", 1, 10, 5)))
    assert table.purge(9) == 2 and table.read().count() == 0 and table.manifest()["buckets"] == {}
    assert table.upsert(rows(spark, row("a", 3))) == 3 and names(table.read()) == [("a", 3)] and snapshots.BUCKETS >= 1


def test_quarantine(spark):
    good = {"text": "x", "bbox": [0, 0.5, 1, 2], "confidence": 1}
    cases = [
        (good, None), ({**good, "polygon": None, "source_kind": "printed"}, None), ({**good, "polygon": [[1, 2], [3.5, 4]], "confidence": 0.25}, None), ({**good, "text": " "}, None),
        ([1], "not an object"), ("x", "not an object"), ({**good, "b": 1, "a": 2}, "unknown key: a"), ({**good, "text": ""}, "no text"), ({**good, "text": 7}, "no text"), ({"bbox": [0, 0, 1, 1], "confidence": 1}, "no text"),
        ({**good, "bbox": [0, 0, 1]}, "no box of four numbers"), ({**good, "bbox": [0, 0, 1, "2"]}, "no box of four numbers"), ({**good, "bbox": None}, "no box of four numbers"), ({**good, "bbox": [0, 0, 1, True]}, "no box of four numbers"),
        ({**good, "bbox": [-1, 0, 1, 2]}, "the box is not an ordered rectangle"), ({**good, "bbox": [1, 0, 1, 2]}, "the box is not an ordered rectangle"),
        ({**good, "confidence": 1.01}, "confidence is not from 0 to 1"), ({**good, "confidence": "1"}, "confidence is not from 0 to 1"), ({k: v for k, v in good.items() if k != "confidence"}, "confidence is not from 0 to 1"),
        ({**good, "polygon": [1]}, "polygon is not a list of points"), ({**good, "polygon": [["1"]]}, "polygon is not a list of points"), ({**good, "polygon": "p"}, "polygon is not a list of points"),
        ({**good, "source_kind": "painted"}, "unknown kind of source"), ({**good, "source_kind": 3}, "unknown kind of source"),
    ]
    raw = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(98, "{"), (99, None)], "i int, line string")
    kept, aside = regions.quarantine_lines(raw)
    assert {r.i: r.reason for r in aside.collect()} == {i: w for i, (_, w) in enumerate(cases) if w} | {98: "not an object", 99: "not an object"}
    got = {r.i: r for r in kept.collect()}
    assert set(got) == {0, 1, 2, 3} and got[0].source_kind == "uncertain" and got[1].source_kind == "printed" and got[2].polygon == [[1.0, 2.0], [3.5, 4.0]] and (got[2].confidence, got[0].y1) == (0.25, 0.5)
    assert kept.select(F.count("*")).first()[0] == 4
