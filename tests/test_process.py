import base64
import json
import os

import numpy as np
from pyspark.sql import functions as F

from inkwell.functions.png import read_png, write_png
from inkwell.plans import process, providers
from inkwell.sources.answers import AnswerLog

PAGE = "doc_id string, page int, markdown string, width double, height double"


def make_reader():
    # A function of its own, so that workers need not import this file.
    def reader(request):
        """Reads every page as two lines, the second uncertain; repairs read it well from the third read on, or fail."""
        if request["stage"] == "base":
            lines = [{"text": "Total: 42", "bbox": [0, 0, 50, 10], "confidence": 0.99, "source_kind": "printed"}, {"text": "Datc: x", "bbox": [0, 40, 50, 50], "confidence": 0.5, "source_kind": "printed"}]
            return {"width": 100, "height": 100, "lines": lines, "hard_regions": []}
        if request["digest"] == "broken":
            raise ValueError("unreadable")
        box = json.loads(request["region"])
        text = "Date: x" if request["read_no"] != 2 or request["digest"] == "good" else "Dote"
        if request["digest"] == "torn":
            text += str(request["read_no"])
        inner = [(0 - box[0]) / box[2] * 200, (40 - box[1]) / box[3] * 200, (50 - box[0]) / box[2] * 200, (50 - box[1]) / box[3] * 200]
        return {"width": 200, "height": 200, "lines": [{"text": text, "bbox": inner, "confidence": 0.97, "source_kind": "printed"}], "hard_regions": []}

    return reader


def inputs(spark):
    digests = {"a": "good", "b": "third", "c": "torn", "d": "broken", "e": "good"}
    pages = spark.createDataFrame([(d, 1, "Total: 42\nDate: x", 50.0, 50.0) for d in digests], PAGE)
    shots = spark.createDataFrame([(d, 1, x, 100, 100) for d, x in digests.items()], "doc_id string, page int, digest string, width int, height int")
    items = spark.createDataFrame([(d, 1, i, t, 0.0, 20.0 * i, 25.0, 5.0) for d in digests for i, t in enumerate(["Total: 42", "Date: x"])], "doc_id string, page int, idx int, text string, x double, y double, width double, height double")
    blocks = spark.createDataFrame([], "doc_id string, page int, block_no int, kind string, text string, x double, y double, width double, height double")
    return pages, shots, items, blocks


def test_parse_and_process(spark):
    pages, shots, items, blocks = inputs(spark)
    parsed = process.parse_documents(pages, shots, items, blocks, make_reader())
    got = {(r.doc_id, r.id): r.source for r in parsed["lines"].collect()}
    assert [got[d, "p1-l0001"] for d in "abcde"] == ["ocr_300"] * 5
    assert [got[d, "p1-l0002"] for d in "abcde"] == ["repair_400", "repair_400", "native", "native", "repair_400"]
    assert {r.doc_id: (r.status, r.ocr_calls) for r in parsed["repairs"].collect()} == {"a": ("consensus", 2), "b": ("majority", 3), "e": ("consensus", 2)}
    assert {r.doc_id: r.code for r in parsed["issues"].collect()} == {"c": "repair_disagreement", "d": "repair_failed"}
    sources = pages.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("source_name"), F.lit("h").alias("source_hash"))
    out = {r.doc_id: r for r in process.process_documents(sources, pages, parsed, providers.echo_lines, providers.join_results).collect()}
    assert {d: r.status for d, r in out.items()} == {"a": "complete", "b": "complete", "c": "partial", "d": "partial", "e": "complete"}
    body = json.loads(out["a"].output_json)
    assert body["schema_version"] == "2.2" and [f["value"] for f in body["data"]["fields"]] == ["42", "x"]
    assert body["stages"] == {"parsing": "complete", "repair": "complete", "annotation": "skipped", "extraction": "complete"}
    space = "viewport_points_top_left_72dpi"
    first = body["evidence"][0]
    assert (first["path"], first["line_ids"], first["quote"]) == ("/data/fields/0/value", ["p1-l0001"], "42")
    assert first["sources"] == [{"id": "p1-l0001", "page": 1, "text": "Total: 42", "bbox": [0.0, 0.0, 25.0, 5.0], "coordinate_space": space, "source": "ocr_300", "confidence": 0.99}]
    assert [e["sources"][0]["source"] for e in body["evidence"]] == ["ocr_300", "repair_400"]
    assert body["repairs"] == [{"page": 1, "region_id": "p1-r001", "bbox": [0.0, 20.0, 25.0, 25.0], "coordinate_space": space, "reason": body["repairs"][0]["reason"], "replaced_lines": 1, "added_lines": 1, "verification": "consensus", "ocr_calls": 2}]
    document = body["document"]
    assert (document["id"], document["source_name"], document["source_page_count"], document["processed_pages"]) == ("h", "a.pdf", 1, [1])
    assert (document["base_dpi"], document["repair_dpi"], document["accuracy_policy"], document["experimental_peer_evidence"]) == (300, 400, "accuracy", False)
    assert document["prompt_template_hashes"] == {"ocr": [], "extraction": []} and document["artifact_id"] is None
    torn = json.loads(out["c"].output_json)
    assert torn["stages"]["repair"] == "partial" and torn["repairs"] == [] and [i["code"] for i in torn["issues"]] == ["repair_disagreement"]
    bare = process.process_documents(sources, pages, parsed, annotated=sources.where("doc_id = 'a'"), settings=process.Settings(model="m", accuracy_policy="legacy"))
    bare = {r.doc_id: json.loads(r.output_json) for r in bare.collect()}
    assert bare["a"]["stages"] == {"parsing": "complete", "repair": "complete", "annotation": "complete", "extraction": "skipped"} and bare["a"]["data"] is None and bare["a"]["evidence"] == []
    assert bare["a"]["status"] == "complete" and (bare["a"]["document"]["model"], bare["a"]["document"]["accuracy_policy"]) == ("m", "legacy")
    assert bare["b"]["stages"]["annotation"] == "failed" and bare["b"]["status"] == "partial" and [i["code"] for i in bare["b"]["issues"]] == ["annotation_failed"]


def test_only_trusted_evidence_is_exported(spark):
    """Evidence that cites a line that isn't there is refused twice and is not in the result; what was proved stays."""
    pages, shots, items, blocks = inputs(spark)
    parsed = process.parse_documents(pages, shots, items, blocks, make_reader())
    sources = pages.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("source_name"), F.lit("h").alias("source_hash"))

    def invent(request):
        field = lambda v: {"name": "n", "value": v, "value_type": "text"}
        cite = lambda i, line, quote: {"path": f"/data/fields/{i}/value", "line_ids": [line], "quote": quote}
        return {"status": "complete", "data": {"document_type": None, "fields": [field("made up"), field("42")]}, "evidence": [cite(0, "p9-l9999", "made up"), cite(1, "p1-l0001", "42")], "issues": []}

    def lost(request):
        raise RuntimeError("gone")

    body = json.loads(process.process_documents(sources, pages, parsed, invent).where("doc_id = 'a'").first().output_json)
    assert [e["quote"] for e in body["evidence"]] == ["42"] and body["evidence"][0]["sources"][0]["id"] == "p1-l0001"
    assert body["status"] == body["stages"]["extraction"] == "partial" and {i["code"] for i in body["issues"]} == {"unsupported"} and len(body["data"]["fields"]) == 2
    body = json.loads(process.process_documents(sources, pages, parsed, lost).where("doc_id = 'a'").first().output_json)
    assert body["status"] == "partial" and body["stages"]["extraction"] == "failed" and body["data"] is None and body["evidence"] == [] and body["issues"]


def test_final_parse_and_failed_pages(spark):
    pages, shots, items, blocks = inputs(spark)
    shots = shots.unionByName(spark.createDataFrame([("f", 1, "lost", 100, 100)], shots.schema))
    pages = pages.unionByName(spark.createDataFrame([("f", 1, "first", 50.0, 50.0)], PAGE))
    base = make_reader()

    def reader(request):
        if request["digest"] == "lost":
            raise ValueError("cannot be read")
        return {**base(request), "prompt_hashes": ["p1" if request["stage"] == "base" else "p2"]}

    def finisher(request):
        if request["digest"] == "third":
            raise RuntimeError("broken")
        return {"markdown": "|".join(request["lines"])}

    parsed = process.parse_documents(pages, shots, items, blocks, reader, finisher=finisher)
    # b was repaired, but its final parse fails: first Markdown, first lines, no repairs.
    assert {r.doc_id: r.markdown for r in parsed["pages"].collect()} == {"a": "Total: 42|Date: x", "e": "Total: 42|Date: x", "b": "Total: 42\nDate: x", "c": "Total: 42\nDate: x", "d": "Total: 42\nDate: x", "f": "first"}
    assert {r.doc_id for r in parsed["repairs"].collect()} == {"a", "e"}
    assert {(r.doc_id, r.source) for r in parsed["lines"].where("id = 'p1-l0002'").collect()} == {("a", "repair_400"), ("e", "repair_400"), ("b", "native"), ("c", "native"), ("d", "native")}
    assert {(r.doc_id, r.code) for r in parsed["issues"].collect()} == {("b", "final_parse_failed"), ("c", "repair_disagreement"), ("d", "repair_failed"), ("f", "page_error")}
    assert {r.doc_id: r.prompt_hashes for r in parsed["prompts"].collect()} == {d: ["p1"] for d in "abcde"}


def test_peer_evidence(spark):
    """A region in a block that stands on other pages, too, is read with the clearest of them beside it."""
    flat, sharp = bytearray([120] * 3 * 100 * 100), bytearray([120] * 3 * 100 * 100)
    for row in range(30, 60):
        for column in range(0, 60):
            at = 3 * (100 * row + column)
            sharp[at : at + 3] = bytes([255 * ((column // 2) % 2)] * 3)
    shots = spark.createDataFrame([("a", p, f"x{p}", 100, 100, bytes(sharp if p == 3 else flat)) for p in (1, 2, 3)], "doc_id string, page int, digest string, width int, height int, image binary")
    pages = spark.createDataFrame([("a", p, "m", 50.0, 50.0) for p in (1, 2, 3)], PAGE)
    block = "doc_id string, page int, block_no int, kind string, text string, x double, y double, width double, height double"
    blocks = spark.createDataFrame([("a", p, 1, "text", "Same Header", 0.0, 15.0, 30.0, 15.0) for p in (1, 2, 3)], block)
    items = spark.createDataFrame([], "doc_id string, page int, idx int, text string, x double, y double, width double, height double")

    def reader(request):
        if request["stage"] == "base":
            confidence = 0.99 if request["digest"] == "x3" else 0.5
            return {"width": 100, "height": 100, "lines": [{"text": "Same Header", "bbox": [0, 40, 50, 50], "confidence": confidence, "source_kind": "printed"}], "hard_regions": []}
        seen = (request["peer"] or "")[:40]
        return {"width": 10, "height": 10, "lines": [{"text": f"peer {seen}", "bbox": [3, 3, 6, 6], "confidence": 0.97, "source_kind": "printed"}], "hard_regions": []}

    parsed = process.parse_documents(pages, shots, items, blocks, reader)
    assert {r.page: r.status for r in parsed["repairs"].collect()} == {1: "consensus", 2: "consensus"}
    px = blocks.selectExpr("doc_id", "page", "block_no", "kind", "text", "2 * x AS x", "2 * y AS y", "2 * width AS width", "2 * height AS height")
    regions = spark.createDataFrame([("a", 1, "p1-r001", 0.0, 40.0, 50.0, 50.0)], "doc_id string, page int, region_id string, x1 double, y1 double, x2 double, y2 double")
    ocr = spark.createDataFrame([("a", p, 0.0, 40.0, 50.0, 50.0, "printed") for p in (1, 2, 3)], "doc_id string, page int, x1 double, y1 double, x2 double, y2 double, source_kind string")
    got = process.peers.peer_evidence(regions, px, ocr, shots).collect()
    assert [(r.page, r.peer_page) for r in got] == [(1, 3)] and got[0].peer.startswith("data:image/png;base64,")
    shown = read_png(base64.b64decode(got[0].peer.partition(",")[2]))
    assert shown.shape == (30, 60, 3) and (shown[:, :, 0] == [255 * (x // 2 % 2) for x in range(60)]).all()


def test_preflight(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 3), ("c", 101), ("d", 101)], "doc_id string, total_pages int")
    wanted = spark.createDataFrame([("a", [1, 3]), ("b", [4]), ("c", None), ("d", [101])], "doc_id string, selected array<int>")
    got = {r.doc_id: r.problem for r in process.preflight(counts, wanted).collect()}
    assert got["a"] is None and got["d"] is None and "beyond" in got["b"] and "100" in got["c"]


def test_reads_align_once_lines_without_text_are_gone(spark):
    pages, shots, items, blocks = inputs(spark)
    base = make_reader()

    def reader(request):
        out = base(request)
        if request["stage"] == "repair" and request["read_no"] == 2:
            return {**out, "lines": [{"text": "  ", "bbox": [0, 0, 9, 9], "confidence": 0.1, "source_kind": "printed"}, *out["lines"]]}
        return out

    parsed = process.parse_documents(pages.where("doc_id = 'a'"), shots.where("doc_id = 'a'"), items.where("doc_id = 'a'"), blocks, reader)
    assert [(r.status, r.ocr_calls) for r in parsed["repairs"].collect()] == [("consensus", 2)]


def test_legacy_leaves_uncertain_lines(spark):
    pages, shots, items, blocks = inputs(spark)
    parsed = process.parse_documents(pages, shots, items, blocks, make_reader(), "legacy")
    assert parsed["repairs"].count() == 0 and {r.source for r in parsed["lines"].where("id = 'p1-l0002'").collect()} == {"native"}


def test_evaluation(spark):
    kind = "document string, markdown string, structure array<struct<page:int,start:int,end:int>>, children array<struct<page:int,atoms:array<struct<start:int,end:int,box:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>>"
    atoms = [(0, 3, (0.0, 0.0, 0.5, 0.1)), (4, 7, (0.0, 0.1, 0.5, 0.2))]
    truth = spark.createDataFrame([("d", "# H\nabcxy", [(2, 7, 9), (1, 0, 7)], [(1, atoms)])], kind)
    pages = spark.createDataFrame([("d", 1, "# H \nabc", 100.0, 100.0), ("d", 2, "xy", 100.0, 100.0)], "document string, page int, markdown string, width double, height double")
    lines = spark.createDataFrame([("d", 1, 1, "# H", 0.0, 0.0, 50.0, 10.0), ("d", 1, 2, "abc", 0.0, 10.0, 50.0, 15.0)], "document string, page int, line_no int, text string, x1 double, y1 double, x2 double, y2 double")
    repairs = spark.createDataFrame([("d", "r1"), ("d", "r2"), ("e", "r1")], "doc_id string, region_id string")
    issues = spark.createDataFrame([("d", "repair_disagreement"), ("d", "page_budget")], "doc_id string, code string")
    whole = {"pages": pages, "lines": lines, "repairs": repairs, "issues": issues}
    part = {"pages": pages.where("page = 1").withColumn("markdown", F.lit("# H\nabx"))}
    results, report = process.run_evaluation(truth, {"accuracy": whole, "legacy": part})
    got = {r.policy: r for r in results.collect()}
    # Reference pages stand in the order of the structure (2, 1), the candidate's by number.
    a = got["accuracy"]
    assert (a.status, a.repairs, a.repair_disagreements, a.line_f1) == ("complete", 2, 1, 1.0)
    assert a.grounding_iou == 0.75 and a.cer == 8 / 11 and a.raw_cer == 9 / 11
    assert got["legacy"].status == "failed" and got["legacy"].grounding_iou is None and got["legacy"].repairs == 0
    assert {r.policy: (r.successful, r.repair_disagreements) for r in report.collect()} == {"legacy": (0, 0), "accuracy": (1, 1)}


def test_png_keeps_pixels():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (7, 5), (20, 33)):
        for image in (rng.integers(0, 256, (*shape, 3)), np.full((*shape, 3), 200), np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]))[..., None] + np.zeros(3, int)):
            image = (image % 256).astype(np.uint8)
            assert (read_png(write_png(image)) == image).all()
    flat = write_png(np.full((100, 100, 3), 7, np.uint8))
    assert len(flat) < 300


def counted(reader, folder):
    """A provider that leaves a file for each call."""

    def call(request):
        with open(f"{folder}/{os.getpid()}-{os.urandom(8).hex()}", "w") as f:
            f.write(json.dumps({k: v for k, v in request.items() if k != "image"}) + "\n" + request.get("image", ""))
        return reader(request)

    return call


def test_answers_outlive_a_run(spark, tmp_path):
    """A second run makes no calls but those that failed; a new prompt or another provider asks anew."""
    pages, shots, items, blocks = inputs(spark)
    calls = tmp_path / "calls"
    calls.mkdir()
    base, folder = make_reader(), str(calls)
    log = AnswerLog(f"file://{tmp_path}/log", "reader-1")
    sources = pages.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("source_name"), F.lit("h").alias("source_hash"))

    def run(log, prompts=()):
        before = len(os.listdir(folder))
        parsed = process.parse_documents(pages, shots, items, blocks, counted(base, folder), finisher=counted(lambda r: {"markdown": "|".join(r["lines"])}, folder), prompts=prompts, log=log)
        out = process.process_documents(sources, parsed["pages"], parsed, counted(providers.echo_lines, folder), providers.join_results, log=log)
        return sorted((r.doc_id, r.status, r.output_json) for r in out.collect()), len(os.listdir(folder)) - before

    first, made = run(log)
    # Four images; two or three reads of three regions, of which documents a and e share one; "broken" fails in each of three reads.
    assert made > 4 + 2 + 3 + 3
    again, more = run(log)
    assert again == first and more == 3
    log.compact(spark)
    assert len(log._batches(spark)) == 1 and run(log) == (first, 3)
    asked, more = run(log, [("Read this page.", "hash-1")])
    assert more > 10 and all(json.loads(x[2])["document"]["prompt_template_hashes"]["ocr"] == ["hash-1"] for x in asked)
    assert run(AnswerLog(f"file://{tmp_path}/log", "reader-2"))[1] == made
    told = [json.loads(open(f"{folder}/{f}").readline()) for f in os.listdir(folder)]
    assert any(t.get("prompts") == ["Read this page."] and t["stage"] == "repair" for t in told)


def test_a_batch_counts_once_it_is_whole(spark, tmp_path):
    log = AnswerLog(f"file://{tmp_path}/log", "p")
    assert log.known(spark).count() == 0
    log.add(spark.createDataFrame([("a", "1"), ("b", None)], AnswerLog.SCHEMA))
    log.add(spark.createDataFrame([("a", "2"), ("c", "3")], AnswerLog.SCHEMA))
    torn = spark.createDataFrame([("d", "4")], AnswerLog.SCHEMA)
    torn.write.parquet(f"file://{tmp_path}/log/batch-torn")
    os.remove(f"{tmp_path}/log/batch-torn/_SUCCESS")
    got = {r.digest: r.response for r in log.known(spark).collect()}
    assert set(got) == {"a", "c"} and got["a"] in "12"


def test_requests_carry_images(spark, tmp_path):
    pages, shots, items, blocks = inputs(spark)
    image = bytes(range(250)) * 120
    shots = shots.where("doc_id = 'a'").withColumn("image", F.lit(image))
    folder = str(tmp_path)
    process.parse_documents(pages.where("doc_id = 'a'"), shots, items.where("doc_id = 'a'"), blocks, counted(make_reader(), folder), "accuracy")
    shown = {}
    for f in os.listdir(folder):
        with open(f"{folder}/{f}") as lines:
            request, url = json.loads(lines.readline()), lines.read()
        shown[request["stage"]] = read_png(base64.b64decode(url.partition(",")[2])), request.get("region")
    whole = np.frombuffer(image, np.uint8).reshape(100, 100, 3)[..., ::-1]
    assert (shown["base"][0] == whole).all()
    cut, region = shown["repair"]
    x, y, w, h = (round(v) for v in json.loads(region))
    assert (cut == whole[y : y + h, x : x + w]).all()
