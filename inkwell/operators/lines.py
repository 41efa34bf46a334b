"""Line catalog with provenance, evidence text, issues, statuses and the exported envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions import text as X

LEAST_IOU, MESSAGE_LENGTH, SCHEMA_VERSION = 0.35, 500, "2.2"
#: What exported boxes count from.
SPACE = "viewport_points_top_left_72dpi"


def line_catalog(items: DataFrame, ocr: DataFrame) -> DataFrame:
    """Text items as catalog lines: id, box in points, source and confidence.

    An item takes the OCR line with its stripped text whose box (in points) overlaps it most, the first of equals, if the
    overlap reaches LEAST_IOU; its source is then ocr_300, or repair_400 if the line was repaired.  All others are native.
    items: doc_id, page, idx, text, x, y, width, height; ocr: doc_id, page, line_no, text, box in points, confidence,
    repaired.
    """
    left = items.withColumn("bare", X.strip(F.col("text"))).withColumn("own", G.box(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")))
    right = ocr.select(F.col("doc_id"), F.col("page"), X.strip(F.col("text")).alias("bare"), G.box("x1", "y1", "x2", "y2").alias("read"), "line_no", "confidence", "repaired")
    joined = left.join(right, ["doc_id", "page", "bare"], "left").withColumn("overlap", F.coalesce(G.iou(F.col("own"), F.col("read")), F.lit(-1.0)))
    first = Window.partitionBy("doc_id", "page", "idx").orderBy(F.desc("overlap"), "line_no")
    best = joined.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    hit = F.col("overlap") >= LEAST_IOU
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("idx"))
    return best.select(
        "doc_id",
        X.line_id(F.col("page"), number).alias("id"),
        "page",
        "text",
        *[F.col("own")[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.when(hit & F.col("repaired"), "repair_400").when(hit, "ocr_300").otherwise("native").alias("source"),
        F.when(hit, F.col("confidence")).alias("confidence"),
    )


def catalog_text(lines: DataFrame) -> DataFrame:
    """The catalog of each page as text, a line each: id, page, box, text."""
    row = F.format_string("%s | p%d | [%s] | %s", "id", "page", F.concat_ws(", ", *[X.two_places(F.col(c)) for c in ("x1", "y1", "x2", "y2")]), "text")
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", row.alias("row")))), lambda s: s["row"]), "\n").alias("catalog"))


def expand_sources(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """Each evidence with its cited lines in the given order; unknown ids are left out.

    evidence: doc_id, path, line_ids, quote.  Gives doc_id, path, quote, sources (array of id, page, text).
    """
    cited = evidence.select("doc_id", "path", "quote", F.posexplode_outer("line_ids").alias("pos", "id"))
    joined = cited.join(lines.select("doc_id", "id", "page", "text"), ["doc_id", "id"], "left")
    source = F.when(F.col("page").isNotNull(), F.struct("pos", "id", "page", "text"))
    return joined.groupBy("doc_id", "path", "quote").agg(F.transform(F.sort_array(F.collect_list(source)), lambda s: F.struct(s["id"].alias("id"), s["page"].alias("page"), s["text"].alias("text"))).alias("sources"))


def page_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page and its line ids in order, for pages that have a size."""
    grouped = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("id")).alias("line_ids"))
    return pages.join(grouped, ["doc_id", "page"])


def issue(code: Column, message: Column, stage: str | Column) -> Column:
    """An issue record; an unknown code counts as unsupported, messages are cut."""
    return F.struct(F.coalesce(code, F.lit("unsupported")).alias("code"), F.substring(F.coalesce(message, F.lit("")), 1, MESSAGE_LENGTH).alias("message"), (stage if isinstance(stage, Column) else F.lit(stage)).alias("stage"))


def distinct_issues(issues: DataFrame, fields: list[str], seq: str = "seq") -> DataFrame:
    """Repeated issues of a document once, at their first place."""
    return issues.groupBy("doc_id", *fields).agg(F.min(seq).alias(seq))


def stage_statuses(markdown: Column, issues: Column, annotated: Column, wanted: Column, extraction: Column | None) -> Column:
    """What became of each stage.  ``annotated``: whether there is an annotated document, ``wanted``: whether one was asked
    for; no extraction was asked for where ``extraction`` is null."""
    has = lambda s: F.exists(issues, lambda i: i["stage"] == s)
    return F.struct(
        F.when(markdown.isNull() | (markdown == ""), "failed").otherwise("complete").alias("parsing"),
        F.when(has("repair"), "partial").otherwise("complete").alias("repair"),
        F.when(annotated, "complete").when(wanted, "failed").otherwise("skipped").alias("annotation"),
        F.coalesce(extraction if extraction is not None else F.lit(None), F.lit("skipped")).alias("extraction"),
    )


def overall_status(markdown: Column, extraction: Column, issue_count: Column) -> Column:
    """failed without visible Markdown; partial with issues or an extraction that isn't complete; else complete."""
    blank = markdown.isNull() | (X.strip(markdown) == "")
    return F.when(blank, "failed").when((issue_count > 0) | F.coalesce(extraction.isin("partial", "failed"), F.lit(False)), "partial").otherwise("complete")


def box_of(box: Column) -> list[Column]:
    """A box as it is exported: its corners and what they count from."""
    return [box.alias("bbox"), F.lit(SPACE).alias("coordinate_space")]


def evidence_with_sources(evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id and evidence: all evidence of a document in its order, each with the catalog lines that it cites.

    evidence: doc_id, ev_no, path, line_ids, quote; lines: the catalog.  A line that the catalog lacks is left out.
    """
    cited = evidence.select("doc_id", "ev_no", F.posexplode("line_ids").alias("pos", "id"))
    line = F.struct("pos", "id", "page", "text", F.array("x1", "y1", "x2", "y2").alias("bbox"), "source", "confidence")
    found = cited.join(lines.select("doc_id", "id", "page", "text", "x1", "y1", "x2", "y2", "source", "confidence"), ["doc_id", "id"])
    one = lambda s: F.struct(s["id"].alias("id"), s["page"].alias("page"), s["text"].alias("text"), *box_of(s["bbox"]), s["source"].alias("source"), s["confidence"].alias("confidence"))
    sources = found.groupBy("doc_id", "ev_no").agg(F.transform(F.sort_array(F.collect_list(line)), one).alias("sources"))
    none = F.array().cast(sources.schema["sources"].dataType)
    whole = evidence.join(sources, ["doc_id", "ev_no"], "left").withColumn("sources", F.coalesce("sources", none))
    ordered = F.sort_array(F.collect_list(F.struct("ev_no", "path", "line_ids", "quote", "sources")))
    return whole.groupBy("doc_id").agg(F.transform(ordered, lambda e: F.struct(e["path"].alias("path"), e["line_ids"].alias("line_ids"), e["quote"].alias("quote"), e["sources"].alias("sources"))).alias("evidence"))


def envelope(docs: DataFrame) -> DataFrame:
    """The exported JSON of each document, from columns source_name, status, stages, document, data (VARIANT), evidence,
    repairs and issues (structs and arrays); null lists are empty ones.  Data stay JSON: nothing is a text within a text."""
    lists = {c: F.coalesce(c, F.array().cast(docs.schema[c].dataType)) for c in ("evidence", "repairs", "issues")}
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "status", "stages", "document", "data", *[v.alias(c) for c, v in lists.items()])
    return docs.select("doc_id", "source_name", "status", F.to_json(body, {"ignoreNullFields": "false"}).alias("output_json"))
