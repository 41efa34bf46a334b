import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.operators import chunking, consensus, evidence, history, metrics, peers, regions
from inkwell.operators import lines as L
from inkwell.plans import extract, providers

BOX = "x1 double, y1 double, x2 double, y2 double"


def test_merge_example():
    assert regions.merge_page([(10, 10, 30, 30, "a"), (31, 10, 50, 30, "b")], 1.0) == [(10, 10, 50, 30, "a; b")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 12), st.integers(1, 12)), max_size=10), st.randoms())
def test_merge_does_not_depend_on_order(boxes, random):
    rows = [(x, y, x + w, y + h, "r") for x, y, w, h in boxes]
    mixed = list(rows)
    random.shuffle(mixed)
    assert sorted(b[:4] for b in regions.merge_page(rows, 1)) == sorted(b[:4] for b in regions.merge_page(mixed, 1))


def test_merge_and_budget(spark):
    rows = [("d", 1, 10.0, 20.0 * i, 30.0, 20.0 * i + 5, "r", 1, 100, 400) for i in range(10)] + [("d", 2, 0.0, 0.0, 5.0, 5.0, "r", 1, 100, 400)]
    df = spark.createDataFrame(rows, f"doc_id string, page int, {BOX}, reason string, src_order int, shot_w int, shot_h int")
    ranked = regions.budget(regions.merge_regions(df)).toPandas()
    assert sorted(ranked.verdict) == ["kept"] * 9 + ["page_budget"] * 2
    assert ranked[(ranked.page == 2)].region_id.tolist() == ["p2-r009"]
    issues = regions.budget_issues(regions.budget(regions.merge_regions(df))).collect()
    assert [(i.code, i.message) for i in issues] == [("repair_page_budget_exceeded", "2 regions were not repaired")]


def test_repair(spark):
    base = spark.createDataFrame([("d", 1, 0.0, 0.0, 10.0, 10.0, "old", 1), ("d", 1, 0.0, 50.0, 10.0, 60.0, "keep", 2), ("e", 1, 0.0, 0.0, 10.0, 10.0, "same", 1)], f"doc_id string, page int, {BOX}, text string, line_no int")
    area = spark.createDataFrame([("d", 1, "r", 0.0, 0.0, 20.0, 20.0), ("e", 1, "r", 0.0, 0.0, 20.0, 20.0)], f"doc_id string, page int, region_id string, {BOX}")
    reads = spark.createDataFrame([("d", 1, "r", 1.0, 1.0, 9.0, 9.0, "new", 1), ("d", 1, "r", 100.0, 1.0, 109.0, 9.0, "outside", 2), ("e", 1, "r", 90.0, 90.0, 99.0, 99.0, "far", 1)], f"doc_id string, page int, region_id string, {BOX}, text string, line_no int")
    assert sorted((r.doc_id, r.text, r.repaired) for r in regions.replace_lines(base, area, reads).collect()) == [("d", "keep", False), ("d", "new", True), ("e", "same", False)]
    more = reads.join(area.selectExpr("doc_id", "page", "x1 rx1", "y1 ry1", "x2 rx2", "y2 ry2", "1 region_no"), ["doc_id", "page"])
    assert sorted((r.doc_id, r.text, r.repaired) for r in regions.repair_pages(base, more).collect()) == [("d", "keep", False), ("d", "new", True), ("e", "same", False)]


def test_candidate_regions(spark):
    hard = spark.createDataFrame([("d", 1, 0.0, 0.0, 1.0, 1.0, "hard")], f"doc_id string, page int, {BOX}, reason string")
    lines = spark.createDataFrame([("d", 1, 0.0, 0.0, 1.0, 1.0, "ok", 0.95), ("d", 1, 0.0, 5.0, 1.0, 6.0, "bad", 0.5), ("d", 1, 0.0, 7.0, 1.0, 8.0, "########", 0.99)], f"doc_id string, page int, {BOX}, text string, confidence double")
    blocks = spark.createDataFrame([("d", 1, "grid_fallback", 36.0, 36.0, 10.0, 10.0, 72.0, 72.0, 144, 144), ("d", 1, "text", 0.0, 0.0, 1.0, 1.0, 72.0, 72.0, 144, 144)], "doc_id string, page int, kind string, x double, y double, block_w double, block_h double, width double, height double, shot_w int, shot_h int")
    assert sorted(r.reason for r in regions.candidate_regions(hard, lines, blocks).collect()) == ["grid fallback", "hard", "low confidence", "ocr anomaly"]
    legacy = regions.candidate_regions(hard, lines, blocks, "legacy").collect()
    assert sorted(r.reason for r in legacy) == ["grid fallback", "hard"] and [r.x2 for r in legacy if r.src_order == 2] == [92.0]


def reads(spark, *sets):
    rows = [("r", n, i, t, 0.0, 10.0 * i, 50.0, 10.0 * i + 8) for n, s in enumerate(sets, 1) for i, t in enumerate(s)]
    return spark.createDataFrame(rows, f"region_id string, read_no int, line_no int, text string, {BOX}")


def test_consensus(spark):
    one = consensus.resolve_reads(reads(spark, ["Café x"], ["Café  x"])).first()
    assert (one.status, one.calls, one.lines[0].text) == ("consensus", 2, "Café x")
    two = consensus.resolve_reads(reads(spark, ["a", "b"], ["a", "c"], ["z", "c"])).first()
    assert (two.status, two.calls, [x.text for x in two.lines]) == ("majority", 3, ["a", "c"])
    assert consensus.resolve_reads(reads(spark, ["a"], ["b"], ["c"])).first().status == "disagreement"
    assert consensus.resolve_reads(reads(spark, ["a"], ["a", "b"], ["a"])).first().status == "disagreement"
    assert consensus.needs_third_read(reads(spark, ["a"], ["b"])).count() == 1


def test_consensus_counts_reads_without_lines(spark):
    """A read that found nothing was made all the same, so it disagrees with one that found lines."""
    made = lambda n: spark.createDataFrame([("r", i) for i in range(1, n + 1)], "region_id string, read_no int")
    for texts in (["a"], [], ["a"]), ([], ["a"], ["a"]), (["a"], []), ([], []):
        got = consensus.resolve_reads(reads(spark, *texts), made=made(len(texts))).first()
        assert (got.status, got.accepted, got.calls, got.lines) == ("disagreement", False, len(texts), None)
    assert consensus.resolve_reads(reads(spark, ["a"], ["a"]), made=made(2)).first().status == "consensus"


def test_catalog(spark):
    items = spark.createDataFrame([("d", 1, i, t, 0.0, 10.0 * i, 50.0, 8.0) for i, t in enumerate([" A ", "B", "C"])], "doc_id string, page int, idx int, text string, x double, y double, width double, height double")
    ocr = spark.createDataFrame([("d", 1, 1, "A", 0.0, 0.0, 50.0, 8.0, 0.9, False), ("d", 1, 2, "B", 0.0, 10.0, 50.0, 18.0, 0.8, True), ("d", 1, 3, "C", 500.0, 500.0, 550.0, 508.0, 0.7, False)], f"doc_id string, page int, line_no int, text string, {BOX}, confidence double, repaired boolean")
    out = L.line_catalog(items, ocr).orderBy("id").collect()
    assert [(r.id, r.source, r.confidence) for r in out] == [("p1-l0001", "ocr_300", 0.9), ("p1-l0002", "repair_400", 0.8), ("p1-l0003", "native", None)]


def test_chunks():
    page = lambda n, text, lines=(): (n, text, "", list(lines))
    assert [len(c[0]) for c in chunking.split_document([page(1, "x" * 45)], 8, 20)] == [20, 20, 5]
    two = chunking.split_document([page(1, "x" * 30, [("a", "y" * 15), ("b", "z" * 15)])], 8, 20)
    assert [c[1] for c in two] == [["a"], ["b"]]
    nine = chunking.split_document([page(i, "t", [(f"l{i}", "t")]) for i in range(9)], 8, 60_000)
    assert [len(c[2]) for c in nine] == [8, 1] and sum((c[1] for c in nine), []) == [f"l{i}" for i in range(9)]


def test_merge_levels(spark):
    got = chunking.merge_levels(spark.createDataFrame([("a", 1), ("b", 11), ("c", 101)], "doc_id string, n int")).orderBy("doc_id", "level").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 11, 2, 1), (2, 2, 1, 1), (1, 101, 11, 10), (2, 11, 2, 1), (3, 2, 1, 1)]


def test_schema_rules():
    good = {"type": "object", "additionalProperties": False, "required": ["a"], "properties": {"a": {"type": ["string", "null"]}}}
    assert evidence.schema_problems(good) == [] and evidence.schema_problems(evidence.generic_schema()) == []
    for bad in ([], {"type": "array"}, {**good, "required": []}, {**good, "additionalProperties": True}, {**good, "properties": {"a": {"$ref": "#"}}}, {**good, "properties": []}):
        assert evidence.schema_problems(bad)
    more = [{"not": {"$ref": "#"}}, {"type": "nonsense"}, {"type": []}, {"items": 3}, {"minLength": -1}, {"anyOf": []}, {"enum": 1}, {"patternProperties": []}, {"additionalProperties": {"type": "object"}}, {"$defs": {"x": {"type": ["object", "null"]}}}]
    for part in more:
        assert evidence.schema_problems({**good, "properties": {**good["properties"], "z": part}, "required": [*good["required"], "z"]}), part
    deep = {"type": "string"}
    for _ in range(200):
        deep = {"anyOf": [deep]}
    assert evidence.schema_problems({**good, "properties": {**good["properties"], "z": deep}, "required": [*good["required"], "z"]}) == []


SCHEMA = {"type": "object", "additionalProperties": False, "required": ["a"], "properties": {"a": {"type": ["string", "null"]}}}


def result(data, ev, status="complete", issues=()):
    return json.dumps({"status": status, "data": data, "evidence": ev, "issues": list(issues)})


def test_grounding(spark):
    cite = lambda path, ids, quote: {"path": path, "line_ids": ids, "quote": quote}
    issue = {"code": "missing", "message": "m"}
    cases = {
        "ok": result({"a": "Foo"}, [cite("/data/a", ["l1"], "foo BAR")]),
        "bare": result({"a": "Foo"}, []),
        "path": result({"a": None}, [cite("/status", ["l1"], "Foo")]),
        "line": result({"a": "Foo"}, [cite("/data/a", ["l9"], "Foo")]),
        "quote": result({"a": "Foo"}, [cite("/data/a", ["l1"], "nope")]),
        "none": result({"a": "Foo"}, [cite("/data/a", [], "Foo")]),
        "json": "{",
        "keys": json.dumps({"status": "complete"}),
        "state": result({"a": None}, [], "partial"),
        "fail": result({"a": None}, [], "failed", [issue]),
        "done": result(None, [], "complete"),
        "shape": result({"b": 1}, []),
        "empty": result(None, [], "failed", [issue]),
    }
    lines = spark.createDataFrame([(c, "l1", "Foo  bar") for c in cases], "doc_id string, id string, text string")
    out = {r.doc_id: r for r in evidence.validate_extractions(spark.createDataFrame(list(cases.items()), "doc_id string, result string"), lines, SCHEMA).collect()}
    assert {c for c, r in out.items() if not r.errors} == {"ok", "empty"}
    assert [t.path for t in out["ok"].trusted] == ["/data/a"]


def test_extract_and_merge(spark):
    lines = spark.createDataFrame([("d", f"l{i}", f"name{i}: value{i}") for i in range(12)] + [("e", "l0", "nothing")], "doc_id string, id string, text string")
    chunks = spark.createDataFrame([("d", i, [f"l{i}"]) for i in range(12)] + [("e", 0, ["l0"])], "doc_id string, chunk_no int, line_ids array<string>")
    done = extract.extract_chunks(chunks, lines, providers.echo_lines)
    merged = {r.doc_id: r for r in extract.merge_tree(done, providers.join_results, lines).collect()}
    assert merged["d"].status == "complete" and [f["value"] for f in json.loads(merged["d"].result)["data"]["fields"]] == [f"value{i}" for i in range(12)]

    def broken(request):
        raise ValueError("no service")

    failed = extract.extract_chunks(chunks, lines, broken)
    assert {(r.status, r.code) for r in failed.collect()} == {("failed", "unsupported")}
    assert {r.status for r in extract.merge_tree(failed, providers.join_results, lines).collect()} == {"failed"}
    torn = {r.doc_id: r for r in extract.merge_tree(done, broken, lines).collect()}
    assert {d: r.status for d, r in torn.items()} == {"d": "partial", "e": "complete"} and [i.code for i in torn["d"].issues] == ["extraction_merge_failed"]


def test_merges_are_told_lines_and_checked(spark):
    """A merge sees the lines its parts cite; an answer with bad evidence is asked for once more, then counts as partial."""
    lines = spark.createDataFrame([("d", f"l{i}", f"name{i}: value{i}") for i in range(3)], "doc_id string, id string, text string")
    chunks = spark.createDataFrame([("d", i, [f"l{i}"]) for i in range(3)], "doc_id string, chunk_no int, line_ids array<string>")
    done = extract.extract_chunks(chunks, lines, providers.echo_lines)

    def wrong_once(request):
        assert [x["id"] for x in request["lines"]] == ["l0", "l1", "l2"]
        out = providers.join_results(request)
        if "feedback" not in request:
            out["evidence"][0]["quote"] = "not there"
        return out

    def wrong(request):
        out = providers.join_results(request)
        out["evidence"][0]["line_ids"] = ["l9"]
        return out

    assert extract.merge_tree(done, wrong_once, lines).first().status == "complete"
    bad = extract.merge_tree(done, wrong, lines).first()
    assert bad.status == "partial" and [i.code for i in bad.issues] == ["unsupported"] and json.loads(bad.result)["data"]

    def secret(request):
        raise RuntimeError("password")

    rows = spark.createDataFrame([("a", "{}")], "request_id string, request string")
    assert providers.call_provider(rows, secret).first().error == "the service failed"


def test_metrics(spark):
    md = "document string, page int, markdown string"
    truth = spark.createDataFrame([("d", 1, "# H\nabc"), ("d", 2, "| A | B |\n|---|---|\n| 1 | 2 |")], md)
    pages = metrics.evaluate_pages(truth.where("page = 1"), truth)
    got = {r.page: r for r in pages.collect()}
    assert got[2].status == "failed" and got[1].cer.edits == got[1].raw_cer.edits == 0 and got[1].headings.matched == 1
    doc = metrics.evaluate_documents(pages).first()
    assert doc.success_rate == 0.5 and doc.cells_score.f1 == 1.0 and doc.cer.edits > 0 and doc.lines_score.f1 == 1.0
    twice = spark.createDataFrame([("d", 1, "a\na\na\nb")], md), spark.createDataFrame([("d", 1, "a\nb\na\nb")], md)
    assert tuple(metrics.evaluate_pages(*twice).first().lines) == (3, 4, 4)
    full = metrics.evaluate_documents(metrics.evaluate_pages(truth, truth)).first()
    assert full.cells_score.f1 == 1.0 and full.cer.edits == 0


def test_greedy(spark):
    kind = f"p int, text string, line_no int, {BOX}"
    ref = spark.createDataFrame([(1, "a", 1, 0.0, 0.0, 10.0, 10.0), (1, "a", 2, 0.0, 1.0, 10.0, 11.0)], kind)
    cand = spark.createDataFrame([(1, "a", 1, 0.0, 1.0, 10.0, 11.0), (1, "a", 2, 50.0, 50.0, 60.0, 60.0)], kind)
    got = metrics.greedy_matches(cand, ref, ["p"]).orderBy("ref_no").collect()
    # The first candidate takes the second line, which it overlaps wholly; the other is left with the first.
    assert [(r.ref_no, r.cand_no, r.iou) for r in got] == [(1, 2, 0.0), (2, 1, 1.0)]


def test_report(spark):
    rows = [("legacy", "complete", 0.9, 1, 0), ("accuracy", "complete", 0.8, 2, 1), ("accuracy", "failed", 0.0, 0, 0)]
    report = metrics.policy_report(spark.createDataFrame(rows, "policy string, status string, line_f1 double, repairs int, repair_disagreements int"), ["line_f1"])
    assert metrics.policy_delta(report, ["line_f1"]).first().delta == pytest.approx(-0.1)
    assert "| accuracy | 1 | 1 | 0.8000 |" in metrics.report_markdown(report, ["line_f1"]).first().markdown


def test_truth_slices(spark):
    kind = "document string, markdown string, structure array<struct<page:int,start:int,end:int>>"
    got = metrics.truth_pages(spark.createDataFrame([("d", "éab cd", [(2, 0, 3), (1, 4, 6)])], kind)).orderBy("seq").collect()
    assert [(r.page, r.markdown) for r in got] == [(2, "éab"), (1, "cd")]


HISTORY = "artifact_id string, source_name string, source_hash string, status string, processing_options string, markdown string, output_json string, error string"


def test_history(spark):
    name = "'; DROP TABLE document_history; --.pdf"
    new = spark.createDataFrame([("a", name, "h", "complete", "{}", "é", "{}", None), ("b", "n", "h", "complete", "{}", "x" * 500, "{bad", None)], HISTORY)
    rows, large = history.prepare(new, 1000, history.Limits(max_bytes=400))
    assert [r.artifact_id for r in large.collect()] == ["b"] and rows.first().retained_bytes == 1 + len(name) + 1 + 8 + 2 + 2 + 2
    rows, _ = history.prepare(new, 1000)
    again = history.upsert(rows, history.prepare(new.where("artifact_id = 'a'").withColumn("markdown", new.status), 2000)[0])
    assert {r.artifact_id: r.markdown for r in again.collect()}["a"] == "complete" and again.count() == 2
    assert history.restore(rows, "a").first().source_name == name and history.restore(rows, "b").first().corrupt and not history.restore(rows, "a").first().corrupt
    rest, found = history.delete(rows, "a")
    assert found and rest.count() == 1 and not history.delete(rows, "zz")[1]
    assert history.purge(rows, 1000 + 30 * history.DAY).count() == 0 and history.purge(rows, 1000 + 30 * history.DAY - 1).count() == 2
    with pytest.raises(ValueError):
        history.recent(rows, 0)
    with pytest.raises(ValueError):
        history.Limits(max_bytes=0)


def test_history_gates(spark, tmp_path):
    kind = history.SCHEMA
    good = ("a", "n", "h", "complete", "{}", "m", "{}", None, 1, 2, 3)
    path = f"{tmp_path}/history"
    assert history.open_history(spark, path).count() == 0
    history.save_history(spark.createDataFrame([good], kind), path)
    assert history.open_history(spark, path).first().artifact_id == "a"
    bad = [("b", *good[1:3], "odd", *good[4:]), ("c", None, *good[2:]), ("d", *good[1:10], -1), good, good]
    found = {(r.artifact_id, r.problem) for r in history.violations(spark.createDataFrame(bad, kind)).collect()}
    assert found == {("b", "unknown status"), ("c", "source_name is missing"), ("d", "retained_bytes is below 0"), ("a", "more than one row")}
    with pytest.raises(ValueError, match="unknown status"):
        history.save_history(spark.createDataFrame(bad, kind), f"{tmp_path}/other")
    spark.createDataFrame([(9,)], "version int").write.mode("overwrite").json(f"{path}/version")
    with pytest.raises(ValueError, match="version"):
        history.open_history(spark, path)


def test_prune_equals_eviction(spark):
    rng = np.random.default_rng(6)
    for _ in range(3):
        rows = [(f"a{i}", int(rng.integers(0, 5)) * 50_000, int(rng.integers(0, 30))) for i in range(40)]
        left, total = sorted(rows, key=lambda r: (r[0] == "a3", r[1], r[0])), sum(r[2] for r in rows)
        while total > 200:
            total -= left.pop(0)[2]
        df = spark.createDataFrame(rows, "artifact_id string, created_at long, retained_bytes long")
        assert {r.artifact_id for r in history.prune(df, 200, "a3").collect()} == {r[0] for r in left}


def test_peers(spark):
    block = "doc_id string, page int, block_no int, kind string, text string, x double, y double, width double, height double"
    blocks = spark.createDataFrame([("d", p, 1, "heading", t, 10.0, 10.0, 50.0, 20.0) for p, t in [(1, "Same Header"), (2, "Same  Header"), (3, "Same Header"), (4, "Header 12345")]], block)
    ocr = spark.createDataFrame([("d", p, 12.0, 12.0, 40.0, 25.0, "printed") for p in (1, 2, 3, 4)], f"doc_id string, page int, {BOX}, source_kind string")
    signed = peers.signatures(blocks, ocr)
    assert {r.page: r.peers for r in peers.peer_blocks(signed).collect()} == {1: 2, 2: 2, 3: 2}
    crops = spark.createDataFrame([("d", "heading", "s", p, 1, c) for p, c in [(1, 10.0), (2, 20.0), (3, 20.5)]], "doc_id string, kind string, signature string, page int, block_no int, clarity double")
    assert {r.page: (r.peer_page, r.peer_clarity) for r in peers.clearest_peer(crops).collect()} == {1: (3, 20.5)}


def test_clarity():
    flat = np.full((8, 8, 3), 120, np.uint8)
    sharp = flat.copy()
    sharp[:, 4:] = 255
    # Borders are copied, so a flat image still differs there.
    assert 0 < peers.edge_variance(flat) < peers.edge_variance(sharp)


def test_status_and_envelope(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" ", None, 0), ("x", None, 0), ("x", None, 1), ("x", "partial", 0)], "m string, e string, n int")
    assert [r[0] for r in df.select(L.overall_status(F.col("m"), F.col("e"), F.col("n"))).collect()] == ["failed", "complete", "partial", "partial"]
