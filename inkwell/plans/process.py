"""Whole documents: reading pages, finding and repairing hard regions, the line catalog, extraction, the exported result."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions import text as X
from inkwell.operators import consensus, metrics, peers, regions
from inkwell.operators import lines as L
from inkwell.operators.chunking import chunk_documents
from inkwell.sources.answers import AnswerLog
from inkwell.sources.files import MOST_PAGES
from inkwell.sources.store import stored

from .extract import ISSUE, extract_chunks, merge_tree
from .providers import Provider, call_provider

POLICIES = ["legacy", "accuracy"]
#: A rendered prompt and the digest of its template.
Prompt = tuple[str, str]
PADDING = 0.02
#: Means in the report of an evaluation.
METRICS = ["cer", "table_f1", "line_f1"]
_BOX = ["x1", "y1", "x2", "y2"]
_LINE = "struct<text:string,bbox:array<double>,confidence:double,polygon:array<array<double>>,source_kind:string>"
RESPONSE = f"width double, height double, lines array<{_LINE}>, hard_regions array<struct<bbox:array<double>,reason:string>>, prompt_hashes array<string>"


def response_json(lines: Column) -> Column:
    """What a caller gets of the lines that were read: text, box, confidence and polygon, without nulls."""
    return F.to_json(F.struct(F.transform(lines, lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"), x["confidence"].alias("confidence"), x["polygon"].alias("polygon"))).alias("results")))


def reading_request(digest: Column, stage: str, read_no: Column | int, box: Column | None = None, peer: Column | None = None, prompts: Iterable[Prompt] = ()) -> Column:
    """The JSON request for one reading; a peer image is context only, never a vote.  Prompts are rendered texts with the digests
    of their templates, as ``load_prompt`` gives them."""
    number = read_no if isinstance(read_no, Column) else F.lit(read_no)
    empty = F.lit(None).cast("string")
    return F.to_json(F.struct(digest.alias("digest"), F.lit(stage).alias("stage"), number.alias("read_no"), (box if box is not None else empty).alias("region"), (peer if peer is not None else empty).alias("peer"), *[F.array(*[F.lit(p[i]) for p in prompts]).cast("array<string>").alias(n) for i, n in enumerate(("prompts", "prompt_hashes"))]))


def _opened(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers of readings as columns.  An answer with a line that breaks the contract is refused as a whole."""
    lines = F.try_variant_get(F.try_parse_json("response"), "$.lines", "array<variant>")
    wrong = F.array_compact(F.transform(lines, regions.line_problem))
    refused = F.when(F.size(wrong) > 0, F.concat(F.lit("a line was refused: "), F.get(wrong, F.lit(0))))
    answers = answers.withColumn("error", F.coalesce("error", refused)).withColumn("response", F.when(F.col("error").isNull(), F.col("response")))
    return answers.withColumn("r", F.from_json("response", RESPONSE)).select(*keys, "error", "r.width", "r.height", "r.lines", "r.hard_regions", "r.prompt_hashes")


def _exploded(read: DataFrame, keys: list[str]) -> DataFrame:
    each = read.select(*keys, F.col("width").alias("shot_w"), F.col("height").alias("shot_h"), F.posexplode("lines").alias("line_no", "l"))
    out = each.select(*keys, "shot_w", "shot_h", "line_no", "l.text", *[F.col("l.bbox")[i].alias(c) for i, c in enumerate(_BOX)], "l.confidence", "l.polygon", "l.source_kind")
    # Numbered once lines without text or area are gone, so that reads align.
    order = Window.partitionBy(*keys).orderBy("line_no")
    return regions.bounded_lines(out).withColumn("line_no", F.row_number().over(order) - 1)


def read_pages(shots: DataFrame, provider: Provider, prompts: Iterable[Prompt] = (), log: AnswerLog | None = None) -> dict[str, DataFrame]:
    """lines, hard regions, errors and prompt hashes of page images (doc_id, page, digest, width, height): each distinct image
    is read once, and pages with the same pixels share what was read.  Images (rows of blue, green, red), where shots have
    them, go along as PNG."""
    once = shots.select(F.col("digest").alias("request_id"), reading_request(F.col("digest"), "base", 1, prompts=prompts).alias("request"), *([X.data_url(peers.png_pixels("image", "height", "width")).alias("image")] if "image" in shots.columns else []))
    answers = stored(_opened(call_provider(once, provider, log=log), ["request_id"]), "pages").withColumnRenamed("request_id", "digest")
    told = F.array(*[F.lit(p[1]) for p in prompts]).cast("array<string>")
    answers = answers.withColumn("prompt_hashes", F.array_union(F.coalesce("prompt_hashes", F.array().cast("array<string>")), told))
    own = shots.select("doc_id", "page", "digest")
    lines = own.join(_exploded(answers, ["digest"]), "digest")
    hard = own.join(answers.select("digest", F.explode("hard_regions").alias("h")), "digest")
    hard = hard.select("doc_id", "page", *[F.col("h.bbox")[i].alias(c) for i, c in enumerate(_BOX)], F.substring("h.reason", 1, regions.REASON_LENGTH).alias("reason"))
    errors = own.join(answers.where("error IS NOT NULL").select("digest", "error"), "digest").select("doc_id", "page", "error")
    prompts = own.join(answers.select("digest", F.explode("prompt_hashes").alias("hash")), "digest").groupBy("doc_id").agg(F.array_sort(F.collect_set("hash")).alias("prompt_hashes"))
    return {"lines": lines, "hard": hard, "errors": errors, "prompts": prompts}


def preflight(counts: DataFrame, wanted: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """doc_id, problem (null if there is none) before any page is read: a selection that goes beyond the document, or no
    selection of a document with more than ``most`` pages.

    counts: doc_id, total_pages, from a cheap look at the files; wanted: doc_id, selected (array or null).
    """
    beyond = F.array_max("selected") > F.col("total_pages")
    problem = F.when(beyond, "the selection goes beyond the document").when(F.col("selected").isNull() & (F.col("total_pages") > most), F.lit(f"the document has more than {most} pages; select some"))
    return counts.join(wanted, "doc_id", "left").select("doc_id", problem.alias("problem"))


def finish_pages(pages: DataFrame, lines: DataFrame, shots: DataFrame, repaired: DataFrame, provider: Provider, log: AnswerLog | None = None) -> tuple[DataFrame, DataFrame]:
    """(new Markdown of pages, failed documents): the pages of repaired documents are parsed once more from their repaired
    lines; a document of which one page fails keeps its first Markdown.

    repaired: doc_id; the provider gets digest, stage ``final`` and lines, and answers with markdown.
    """
    texts = lines.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("y1", "x1", "text"))), lambda s: s["text"]).alias("texts"))
    own = pages.select("doc_id", "page").join(repaired, "doc_id", "left_semi").join(shots.select("doc_id", "page", "digest"), ["doc_id", "page"]).join(texts, ["doc_id", "page"], "left")
    body = F.to_json(F.struct("digest", F.lit("final").alias("stage"), F.coalesce("texts", F.array().cast("array<string>")).alias("lines")))
    asked = own.select(F.concat_ws("/", "doc_id", "page").alias("request_id"), body.alias("request"))
    got = stored(call_provider(asked, provider, log=log), "final").withColumn("markdown", F.get_json_object("response", "$.markdown"))
    keyed = own.select("doc_id", "page", F.concat_ws("/", "doc_id", "page").alias("request_id")).join(got, "request_id")
    failed = keyed.where("error IS NOT NULL OR markdown IS NULL").select("doc_id").distinct()
    return keyed.select("doc_id", "page", "markdown").join(failed, "doc_id", "left_anti"), failed


def read_regions(kept: DataFrame, provider: Provider, policy: str, prompts: Iterable[Prompt] = (), log: AnswerLog | None = None) -> tuple[DataFrame, DataFrame]:
    """(new lines in base pixels, outcome of each region) for regions with digest and image size.

    The accuracy policy reads twice, and a third time only where the two don't agree; the legacy policy takes one read.
    A region that can't be read, or whose reads disagree, is an issue and changes nothing.  A column ``peer`` (an image of the
    same block on another page) goes along with the request, and so does the cut of the page where ``kept`` has an image.
    """
    size = F.col("shot_w"), F.col("shot_h")
    pad = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    crop = kept.withColumns({"crop_x": pad(F.col("x1") - PADDING * size[0], size[0]), "crop_y": pad(F.col("y1") - PADDING * size[1], size[1])})
    crop = crop.withColumns({"crop_w": pad(F.col("x2") + PADDING * size[0], size[0]) - F.col("crop_x"), "crop_h": pad(F.col("y2") + PADDING * size[1], size[1]) - F.col("crop_y")})
    crop = crop.withColumn("key", F.concat_ws("/", "doc_id", "region_id"))

    def ask(which: DataFrame, numbers: list[int]) -> DataFrame:
        each = which.withColumn("read_no", F.explode(F.array(*map(F.lit, numbers))))
        box = F.to_json(F.array("crop_x", "crop_y", "crop_w", "crop_h"))
        peer = F.col("peer") if "peer" in which.columns else None
        cut = [X.data_url(peers.crop_pixels("image", "shot_h", "shot_w", "crop_x", "crop_y", F.col("crop_x") + F.col("crop_w"), F.col("crop_y") + F.col("crop_h"))).alias("image")] if "image" in which.columns else []
        requests = each.select(F.concat_ws("@", "key", "read_no").alias("request_id"), reading_request(F.col("digest"), "repair", F.col("read_no"), box, peer, prompts).alias("request"), *cut)
        return stored(_opened(call_provider(requests, provider, log=log), ["request_id"]).withColumns({"key": F.split_part("request_id", F.lit("@"), F.lit(1)), "read_no": F.split_part("request_id", F.lit("@"), F.lit(-1)).cast("int")}), "reads")

    answers = ask(crop, [1, 2] if policy == "accuracy" else [1])
    lines = _exploded(answers, ["key", "read_no"])
    if policy == "accuracy":
        agreed = consensus.resolve_reads(lines, "key", made=answers).where("accepted").select("key")
        third = ask(crop.join(agreed, "key", "left_anti"), [3])
        answers, lines = answers.unionByName(third), lines.unionByName(_exploded(third, ["key", "read_no"]))
        verdict = consensus.resolve_reads(lines, "key", made=answers).select("key", "status", "accepted", "calls", F.transform("lines", lambda x: x["line_no"]).alias("numbers"))
        norm = lines.withColumn("norm", X.normalize_inline(F.col("text")))
        votes = norm.groupBy("key", "line_no", "norm").agg(F.count(F.lit(1)).alias("votes"), F.min("read_no").alias("first"))
        best = votes.withColumn("nth", F.row_number().over(Window.partitionBy("key", "line_no").orderBy(F.desc("votes"), "first"))).where("nth = 1").select("key", "line_no", F.col("first").alias("read_no"))
        chosen = lines.join(best, ["key", "line_no", "read_no"]).join(verdict.where("accepted").select("key"), "key", "left_semi")
    else:
        verdict = answers.select("key", F.when(F.col("error").isNull(), "single").otherwise("failed").alias("status"), F.col("error").isNull().alias("accepted"), F.lit(1).alias("calls"))
        chosen = lines
    broken = answers.where("error IS NOT NULL").select("key").distinct().withColumn("broken", F.lit(True))
    outcome = crop.join(verdict, "key", "left").join(broken, "key", "left")
    outcome = outcome.withColumn("status", F.when(F.col("broken"), "failed").otherwise(F.coalesce("status", F.lit("disagreement"))))
    placed = chosen.withColumnsRenamed({"shot_w": "read_w", "shot_h": "read_h"}).join(crop.select("key", "doc_id", "page", "region_no", "crop_x", "crop_y", "crop_w", "crop_h", *[F.col(c).alias(f"r{c}") for c in _BOX]), "key")
    placed = placed.join(broken.select("key"), "key", "left_anti")
    return regions.to_base_pixels(placed), outcome.select("doc_id", "page", "region_id", *_BOX, "reason", "status", F.coalesce("calls", F.lit(0)).alias("ocr_calls"))


def parse_documents(pages: DataFrame, shots: DataFrame, items: DataFrame, blocks: DataFrame, provider: Provider, policy: str = "accuracy", finisher: Provider | None = None, prompts: Iterable[Prompt] = (), log: AnswerLog | None = None) -> dict[str, DataFrame]:
    """lines (the catalog), pages (doc_id, page, markdown), repairs, issues and prompts (hashes by doc_id) of documents.

    With a ``finisher`` the pages of repaired documents are parsed once more; where that fails, the document keeps its first
    Markdown and lines, and none of its repairs count.  ``prompts`` go along with each reading; with a ``log`` answers outlive
    the run.

    pages: doc_id, page, markdown, width, height (points); shots: doc_id, page, digest, width, height (pixels) and, for the
    accuracy policy to show the same block where it is clearer, image (rows of blue, green, red); items:
    doc_id, page, idx, text, x, y, width, height (points); blocks: doc_id, page, block_no, kind, text, x, y, width, height.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    sized = pages.select("doc_id", "page", F.col("width").alias("page_w"), F.col("height").alias("page_h")).join(shots.select("doc_id", "page", "digest", F.col("width").alias("shot_w"), F.col("height").alias("shot_h")), ["doc_id", "page"])
    prompts = list(prompts)
    first = read_pages(shots, provider, prompts, log)
    read, hard = first["lines"], first["hard"]
    grid = blocks.withColumnsRenamed({"width": "block_w", "height": "block_h"}).join(sized.withColumnsRenamed({"page_w": "width", "page_h": "height"}), ["doc_id", "page"])
    found = regions.candidate_regions(hard, read, grid, policy).join(sized.select("doc_id", "page", "shot_w", "shot_h"), ["doc_id", "page"])
    ranked = stored(regions.budget(regions.merge_regions(found)), "regions")
    kept = ranked.where("verdict = 'kept'").join(sized.select("doc_id", "page", "digest", "shot_w", "shot_h"), ["doc_id", "page"])
    if policy == "accuracy" and "image" in shots.columns:
        scale_x, scale_y = F.col("shot_w") / F.col("page_w"), F.col("shot_h") / F.col("page_h")
        pixels = blocks.join(sized, ["doc_id", "page"]).select("doc_id", "page", "block_no", "kind", "text", (F.col("x") * scale_x).alias("x"), (F.col("y") * scale_y).alias("y"), (F.col("width") * scale_x).alias("width"), (F.col("height") * scale_y).alias("height"))
        evidence = peers.peer_evidence(kept.select("doc_id", "page", "region_id", *_BOX), pixels, read, shots.select("doc_id", "page", "image", "height", "width"))
        kept = kept.join(evidence.select("doc_id", "page", "region_id", "peer"), ["doc_id", "page", "region_id"], "left")
    if "image" in shots.columns:
        kept = kept.join(shots.select("doc_id", "page", "image"), ["doc_id", "page"])
    fresh, outcome = read_regions(kept, provider, policy, prompts, log)
    fresh, outcome = stored(fresh, "fresh"), stored(outcome, "outcome")
    whole = stored(regions.repair_pages(read, fresh), "repaired")
    accepted = outcome.where(~F.col("status").isin("failed", "disagreement"))
    counts = regions.repair_receipts(read, fresh).join(ranked.where("verdict = 'kept'").select(F.col("doc_id").cast("string").alias("doc_id"), "page", "region_no", "region_id"), ["doc_id", "page", "region_no"])
    accepted = accepted.withColumn("doc_id", F.col("doc_id").cast("string")).join(counts.select("doc_id", "page", "region_id", "replaced_lines", "added_lines"), ["doc_id", "page", "region_id"], "left").na.fill(0, ["replaced_lines", "added_lines"])
    to_points = G.rescale(G.box(*_BOX), F.col("shot_w"), F.col("shot_h"), F.col("page_w"), F.col("page_h"))
    accepted = accepted.join(sized.drop("digest"), ["doc_id", "page"]).withColumn("bbox", F.array(*[to_points[c] for c in _BOX])).drop("page_w", "page_h", "shot_w", "shot_h")
    texts, undone = pages.select("doc_id", "page", "markdown"), None
    if finisher is not None:
        fresh_text, undone = finish_pages(pages, whole, shots, accepted.select("doc_id").distinct(), finisher, log)
        undone = stored(undone, "undone")
        texts = texts.join(fresh_text.withColumnRenamed("markdown", "final"), ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("final", "markdown").alias("markdown"))
        accepted = accepted.join(undone, "doc_id", "left_anti")
        plain = regions.repair_pages(read, fresh.limit(0)).join(undone, "doc_id", "left_semi")
        whole = whole.join(undone, "doc_id", "left_anti").unionByName(plain)
    points = whole.join(sized, ["doc_id", "page"]).withColumn("b", G.rescale(G.box(*_BOX), F.col("shot_w"), F.col("shot_h"), F.col("page_w"), F.col("page_h")))
    numbered = points.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y1", "x1")))
    catalog = L.line_catalog(items, numbered.select("doc_id", "page", "line_no", "text", *[F.col("b")[c].alias(c) for c in _BOX], "confidence", "repaired"))
    failed = outcome.where(F.col("status").isin("failed", "disagreement")).select("doc_id", F.when(F.col("status") == "failed", "repair_failed").otherwise("repair_disagreement").alias("code"), F.concat(F.lit("region "), "region_id").alias("message"), F.lit("repair").alias("stage"))
    unread = first["errors"].select("doc_id", F.lit("page_error").alias("code"), F.substring("error", 1, L.MESSAGE_LENGTH).alias("message"), F.lit("parsing").alias("stage"))
    issues = regions.budget_issues(ranked).unionByName(failed).unionByName(unread)
    if undone is not None:
        issues = issues.unionByName(undone.select("doc_id", F.lit("final_parse_failed").alias("code"), F.lit("the repaired document could not be parsed; its first Markdown is kept").alias("message"), F.lit("repair").alias("stage")))
    return {"lines": catalog, "pages": texts, "repairs": accepted, "issues": issues, "prompts": first["prompts"]}


@dataclass(frozen=True)
class Settings:
    """What an exported result says of how it was made."""

    model: str = "none"
    reasoning_effort: str = "medium"
    parser_version: str = "none"
    base_dpi: int = 300
    repair_dpi: int = 400
    accuracy_policy: str = "accuracy"
    experimental_peer_evidence: bool = False


def process_documents(sources: DataFrame, pages: DataFrame, parsed: dict[str, DataFrame], extractor: Provider | None = None, merger: Provider | None = None, schema: dict | None = None, settings: Settings | None = None, annotated: DataFrame | None = None, log: AnswerLog | None = None) -> DataFrame:
    """The exported result of each document (doc_id, source_name, source_hash and, where known, artifact_id and
    source_page_count): doc_id, source_name, status, output_json.

    Without an extractor there is no data; a failed extraction never loses the Markdown, but is an issue.  ``annotated`` has
    the doc_id of each document with an annotated copy, if copies were asked for.
    """
    ordered = F.sort_array(F.collect_list(F.struct("page", "markdown")))
    markdown = pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["markdown"]), "\n\n").alias("markdown"), F.sort_array(F.collect_list("page")).alias("processed_pages"))
    told = F.transform(F.sort_array(F.collect_list(F.struct("code", "message", "stage"))), lambda i: L.issue(i["code"], i["message"], i["stage"]))
    issues = parsed["issues"].groupBy("doc_id").agg(told.alias("issues"))
    receipt = F.struct("page", "region_id", *L.box_of(F.col("bbox")), "reason", "replaced_lines", "added_lines", F.when(F.col("status") == "single", "legacy").otherwise(F.col("status")).alias("verification"), "ocr_calls")
    repairs = parsed["repairs"].groupBy("doc_id").agg(F.sort_array(F.collect_list(receipt)).alias("repairs"))
    docs = sources.join(markdown, "doc_id", "left").join(issues, "doc_id", "left").join(repairs, "doc_id", "left").join(parsed["prompts"].withColumnRenamed("prompt_hashes", "ocr_hashes"), "doc_id", "left")
    if extractor is not None:
        own = parsed["lines"].groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("lines"))
        catalog = L.catalog_text(parsed["lines"])
        chunks = chunk_documents(pages.select("doc_id", "page", "markdown").join(catalog, ["doc_id", "page"], "left").join(own, ["doc_id", "page"], "left"))
        merged = stored(merge_tree(extract_chunks(chunks, parsed["lines"], extractor, schema, log), merger or (lambda request: request["results"][0]), parsed["lines"], schema, log=log), "merged")
        whole = merged.withColumn("v", F.try_parse_json("result"))
        cited = F.try_variant_get("v", "$.evidence", "array<struct<path:string,line_ids:array<string>,quote:string>>")
        evidence = L.evidence_with_sources(whole.select("doc_id", F.posexplode(cited).alias("ev_no", "e")).select("doc_id", "ev_no", "e.path", "e.line_ids", "e.quote"), parsed["lines"])
        docs = docs.join(whole.select("doc_id", F.try_variant_get("v", "$.data", "variant").alias("data"), F.col("status").alias("extraction"), F.col("issues").alias("more")), "doc_id", "left").join(evidence, "doc_id", "left")
        # A document with text of which nothing came back.
        lost = F.when(F.col("extraction").isNull(), F.array(L.issue(F.lit("extraction_failed"), F.lit("the extraction failed; the Markdown is kept"), "extraction")))
        docs = docs.withColumns({"more": F.coalesce("more", lost), "extraction": F.coalesce("extraction", F.lit("failed"))})
    else:
        docs = docs.withColumns({"data": F.lit(None).cast("variant"), "extraction": F.lit(None).cast("string"), "more": F.lit(None).cast(f"array<{ISSUE}>"), "evidence": F.array().cast("array<string>")})
    none = F.array().cast(f"array<{ISSUE}>")
    has_copy = F.lit(False)
    if annotated is not None:
        docs = docs.join(annotated.select("doc_id", F.lit(True).alias("copied")).distinct(), "doc_id", "left")
        has_copy = F.coalesce("copied", F.lit(False))
        lost = F.when(~has_copy, F.array(L.issue(F.lit("annotation_failed"), F.lit("the annotated copy could not be made"), "annotation")))
        docs = docs.withColumn("more", F.concat(F.coalesce("more", none), F.coalesce(lost, none)))
    docs = docs.withColumn("issues", F.concat(F.coalesce("issues", none), F.coalesce("more", none))).drop("more")
    docs = docs.withColumn("status", L.overall_status(F.col("markdown"), F.col("extraction"), F.size("issues")))
    docs = docs.withColumn("stages", L.stage_statuses(F.col("markdown"), F.col("issues"), has_copy, F.lit(annotated is not None), F.col("extraction")))
    made = settings or Settings()
    known = lambda c, kind: (F.col(c) if c in sources.columns else F.lit(None)).cast(kind).alias(c)
    hashes = F.coalesce("ocr_hashes", F.array().cast("array<string>"))
    document = F.struct(
        F.col("source_hash").alias("id"), known("artifact_id", "string"), "source_name", F.coalesce(known("source_page_count", "int"), F.size("processed_pages")).alias("source_page_count"), "processed_pages",
        *[F.lit(getattr(made, f.name)).alias(f.name) for f in fields(Settings)], F.struct(hashes.alias("ocr"), F.array().cast("array<string>").alias("extraction")).alias("prompt_template_hashes"),
    )
    return L.envelope(docs.withColumn("document", document))


def run_evaluation(truth: DataFrame, parsed_by_policy: dict[str, dict[str, DataFrame]], names: list[str] = METRICS) -> tuple[DataFrame, DataFrame]:
    """(results by policy and document, report by policy) of parsed documents against the ground truth.

    truth: document, markdown, structure and (for lines and grounding) children, as ``truth_pages`` and ``truth_lines`` take
    them.  Parsed, by policy: ``pages`` (document, page, markdown and, for grounding, width and height in points); optionally
    ``lines`` (the catalog: document, page, line_no, text, box) and what ``parse_documents`` gives as ``repairs`` and ``issues``
    with doc_id.  A document of which a page is missing counts as failed.
    """
    reference = metrics.truth_pages(truth)
    out = None
    for policy, parsed in parsed_by_policy.items():
        grounded = metrics.grounding_pages(parsed["lines"], metrics.truth_lines(truth), parsed["pages"]) if "lines" in parsed and "children" in truth.columns else None
        scored = metrics.evaluate_documents(metrics.evaluate_pages(parsed["pages"], reference, grounded=grounded))
        for name, rows in (("repairs", parsed.get("repairs")), ("repair_disagreements", parsed["issues"].where("code = 'repair_disagreement'") if "issues" in parsed else None)):
            if rows is None:
                scored = scored.withColumn(name, F.lit(0).cast("long"))
            else:
                scored = scored.join(rows.groupBy(F.col("doc_id").alias("document")).agg(F.count(F.lit(1)).alias(name)), "document", "left").na.fill(0, [name])
        status = F.when(F.col("success_rate") == 1, "complete").otherwise("failed")
        flat = scored.select(F.lit(policy).alias("policy"), "document", status.alias("status"), F.col("raw_cer.rate").alias("raw_cer"), F.col("cer.rate").alias("cer"), F.col("cells_score.f1").alias("table_f1"), F.col("lines_score.f1").alias("line_f1"), "grounding_iou", "repairs", "repair_disagreements")
        out = flat if out is None else out.unionByName(flat)
    return out, metrics.policy_report(out, names)
