"""Hard regions: discovery, merging, budgets, and repair of the lines inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions import text as X
from inkwell.operators.grouping import map_groups

GAP_SHARE, REASON_LENGTH = 0.01, 200
PER_PAGE, PER_DOCUMENT = 8, 64
_BOX = ["x1", "y1", "x2", "y2"]


def bounded_lines(lines: DataFrame, width: str = "shot_w", height: str = "shot_h") -> DataFrame:
    """OCR lines cut to their image: blank texts and degenerate boxes go, texts are stripped, polygons are cut."""
    cut = lines.withColumn("_box", G.clamp(G.box(*_BOX), F.col(width), F.col(height))).withColumn("text", X.strip(F.col("text")))
    if "polygon" in lines.columns:
        cut = cut.withColumn("polygon", G.clamp_polygon(F.col("polygon"), F.col(width), F.col(height)))
    cut = cut.where(F.col("_box").isNotNull() & (F.col("text") != ""))
    return cut.withColumns({c: F.col("_box")[c] for c in _BOX}).drop("_box")


#: What a line of a reading may hold; fixed values.
LINE_KEYS = ("text", "bbox", "confidence", "polygon", "source_kind")
SOURCE_KINDS = ("printed", "handwritten", "uncertain")


def line_problem(line: Column) -> Column:
    """What is wrong with a line of a reading (VARIANT) as it came; null for a good one.  The first of: its kind, keys that
    are unknown, text, box, confidence, polygon, kind of source."""
    whole = F.try_variant_get(line, "$", "map<string,variant>")
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    part = lambda name: F.try_element_at(whole, F.lit(name))
    number = lambda v: kind(v).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    numbers = lambda v, n: (kind(v) == "ARRAY") & F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")) == n, F.lit(False)) & F.coalesce(F.forall(F.try_variant_get(v, "$", "array<variant>"), number), F.lit(False))
    given = lambda v: v.isNotNull() & (kind(v) != "VOID")
    unknown = F.array_except(F.map_keys(whole), F.array(*map(F.lit, LINE_KEYS)))
    at = lambda i: F.try_variant_get(part("bbox"), f"$[{i}]", "double")
    bad = lambda test: F.coalesce(~test, F.lit(True))
    points = F.try_variant_get(part("polygon"), "$", "array<variant>")
    return (
        F.when(whole.isNull(), "not an object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown key: "), F.array_min(unknown)))
        .when(bad((kind(part("text")) == "STRING") & (F.try_variant_get(part("text"), "$", "string") != "")), "no text")
        .when(bad(numbers(part("bbox"), 4)), "no box of four numbers")
        .when(bad((at(0) >= 0) & (at(1) >= 0) & (at(2) > at(0)) & (at(3) > at(1))), "the box is not an ordered rectangle")
        .when(bad(number(part("confidence")) & F.try_variant_get(part("confidence"), "$", "double").between(0, 1)), "confidence is not from 0 to 1")
        .when(given(part("polygon")) & bad(F.forall(points, lambda p: kind(p) == "ARRAY") & F.forall(points, lambda p: F.forall(F.try_variant_get(p, "$", "array<variant>"), number))), "polygon is not a list of points")
        .when(given(part("source_kind")) & bad(F.try_variant_get(part("source_kind"), "$", "string").isin(*SOURCE_KINDS)), "unknown kind of source")
    )


def quarantine_lines(raw: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(lines with text, box, confidence, polygon and source_kind, quarantined lines with reason) of JSON texts in ``column``; what
    is no JSON has the reason ``not an object``."""
    others = [c for c in raw.columns if c != column]
    read = raw.withColumn("_v", F.try_parse_json(column)).withColumn("reason", line_problem(F.col("_v")))
    part = lambda path, kind: F.try_variant_get("_v", path, kind)
    box = [part(f"$.bbox[{i}]", "double").alias(c) for i, c in enumerate(_BOX)]
    good = read.where("reason IS NULL").select(*others, part("$.text", "string").alias("text"), *box, part("$.confidence", "double").alias("confidence"), part("$.polygon", "array<array<double>>").alias("polygon"), F.coalesce(part("$.source_kind", "string"), F.lit("uncertain")).alias("source_kind"))
    return good, read.where("reason IS NOT NULL").select(*others, column, "reason")


def candidate_regions(hard: DataFrame, lines: DataFrame, blocks: DataFrame, policy: str = "accuracy") -> DataFrame:
    """Union of the regions that a page asks to be read again: those the reader flagged; under the accuracy policy lines of
    low confidence or with anomalies; grid fallbacks under either policy.

    hard (doc_id, page, box, reason), lines (with text and confidence), blocks (kind; bbox in points with page and image
    sizes) give doc_id, page, box in pixels, reason, src_order.
    """
    keys = ["doc_id", "page", *_BOX]
    parts = [hard.select(*keys, "reason", F.lit(0).alias("src_order"))]
    if policy == "accuracy":
        low, odd = X.is_low_confidence(F.col("confidence")), X.has_anomaly(F.col("text"))
        parts.append(lines.where(low | odd).select(*keys, F.when(odd, "ocr anomaly").otherwise("low confidence").alias("reason"), F.lit(1).alias("src_order")))
    grid = blocks.where((F.col("kind") == "grid_fallback") & F.col("x").isNotNull())
    grid = grid.withColumn("b", G.rescale(G.box(F.col("x"), F.col("y"), F.col("x") + F.col("block_w"), F.col("y") + F.col("block_h")), F.col("width"), F.col("height"), F.col("shot_w"), F.col("shot_h")))
    parts.append(grid.select("doc_id", "page", *[F.col("b")[c].alias(c) for c in _BOX], F.lit("grid fallback").alias("reason"), F.lit(2).alias("src_order")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merge_page(boxes: list[tuple[float, float, float, float, str]], gap: float) -> list[tuple[float, float, float, float, str]]:
    """Replace boxes that touch by their hull, until none do.  Reasons are joined in the order of input."""
    done: list[tuple[float, float, float, float, str]] = []
    for new in boxes:
        grown = True
        while grown:
            grown = False
            for i, old in enumerate(done):
                if old[0] <= new[2] + gap and new[0] <= old[2] + gap and old[1] <= new[3] + gap and new[1] <= old[3] + gap:
                    reasons = "; ".join(dict.fromkeys([*old[4].split("; "), *new[4].split("; ")]))[:REASON_LENGTH]
                    new = (min(old[0], new[0]), min(old[1], new[1]), max(old[2], new[2]), max(old[3], new[3]), reasons)
                    del done[i]
                    grown = True
                    break
        done.append(new)
    return sorted(done, key=lambda b: (b[1], b[0]))


def merge_regions(regions: DataFrame, width: str = "shot_w", height: str = "shot_h", order: tuple[str, ...] = ("src_order", "y1", "x1")) -> DataFrame:
    """Merge the regions of each page; a page's regions are one small group."""
    schema = "doc_id string, page int, x1 double, y1 double, x2 double, y2 double, reason string"

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        gap = GAP_SHARE * max(rows[0][5], rows[0][6])
        return [(*key, *b) for b in merge_page([r[:5] for r in rows], gap)]

    named = regions.withColumns({"doc_id": F.col("doc_id").cast("string"), "page": F.col("page").cast("int")})
    return map_groups(named, ["doc_id", "page"], list(order), one, schema, [*_BOX, "reason", width, height])


def budget(regions: DataFrame, per_page: int = PER_PAGE, per_document: int = PER_DOCUMENT) -> DataFrame:
    """Rank regions and mark the first ``per_page`` of each page, then the first ``per_document`` of what is left.

    Adds page_rank, doc_rank (null beyond the page's budget), region_no (document-wide) and verdict: kept, page_budget or
    document_budget.  A page's or a document's regions are ranked together.
    """
    order = [F.col("y1"), F.col("x1")]
    ranked = regions.withColumn("page_rank", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order)))
    inside = F.col("page_rank") <= per_page
    whole = Window.partitionBy("doc_id", inside).orderBy("page", *order)
    ranked = ranked.withColumn("doc_rank", F.when(inside, F.row_number().over(whole)))
    verdict = F.when(~inside, "page_budget").when(F.col("doc_rank") > per_document, "document_budget").otherwise("kept")
    return ranked.withColumn("verdict", verdict).withColumn("region_no", F.when(verdict == "kept", F.col("doc_rank"))).withColumn("region_id", F.when(verdict == "kept", X.region_id(F.col("page"), F.col("doc_rank"))))


def budget_issues(ranked: DataFrame) -> DataFrame:
    """An issue for each document and kind of budget that left regions out."""
    left_out = ranked.where("verdict <> 'kept'").groupBy("doc_id", "verdict").agg(F.count(F.lit(1)).alias("skipped"))
    code = F.when(F.col("verdict") == "page_budget", "repair_page_budget_exceeded").otherwise("repair_document_budget_exceeded")
    return left_out.select("doc_id", code.alias("code"), F.format_string("%d regions were not repaired", "skipped").alias("message"), F.lit("repair").alias("stage"))


def to_base_pixels(lines: DataFrame) -> DataFrame:
    """Lines read on a crop (pixels of the crop at its own scale), in pixels of the base image.

    Needs crop_x, crop_y (the crop's corner on the base image), crop_w, crop_h (its size there), read_w, read_h (its size
    as read).
    """
    across, down = F.col("crop_w") / F.col("read_w"), F.col("crop_h") / F.col("read_h")
    out = lines.withColumns({"x1": F.col("crop_x") + F.col("x1") * across, "x2": F.col("crop_x") + F.col("x2") * across, "y1": F.col("crop_y") + F.col("y1") * down, "y2": F.col("crop_y") + F.col("y2") * down})
    if "polygon" in lines.columns:
        out = out.withColumn("polygon", F.transform("polygon", lambda p: F.array(F.col("crop_x") + p[0] * across, F.col("crop_y") + p[1] * down)))
    return out


def replace_lines(base: DataFrame, regions: DataFrame, reads: DataFrame) -> DataFrame:
    """Replace base lines whose centre lies in a region by the region's new lines; a region without new lines inside it
    changes nothing.

    For regions that are disjoint on each page (as merging leaves them), all at once.  base and reads: doc_id, page, box,
    text and line_no; reads also region_id; regions: doc_id, page, region_id, box.  Gives base's lines with ``repaired``.
    """
    area = regions.select("doc_id", "page", "region_id", G.box(*_BOX).alias("area"))
    inside = reads.join(area, ["doc_id", "page", "region_id"]).where(G.center_inside(G.box(*_BOX), F.col("area")))
    fresh = inside.select("doc_id", "page", *_BOX, "text", "line_no", F.lit(True).alias("repaired"), "region_id")
    landed = fresh.select("doc_id", "page", "region_id").distinct()
    hit = area.join(landed, ["doc_id", "page", "region_id"], "left_semi").select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "area")
    kept = base.join(hit, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & G.center_inside(G.box(*_BOX), F.col("area")), "left_anti")
    kept = kept.select("doc_id", "page", *_BOX, "text", "line_no", F.lit(False).alias("repaired"), F.lit(None).cast("string").alias("region_id"))
    return kept.unionByName(fresh)


def _apply_regions(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """(lines, receipts) of one page: its regions applied one after another, each seeing what the earlier ones changed.  A
    receipt tells a region's number and how many lines it replaced and added; rows are those of ``_with_areas``."""
    held, receipts = [(*r[1:7], False) for r in rows if r[0] == 0], []
    for number in sorted({r[0] for r in rows if r[0] > 0}):
        part = [r for r in rows if r[0] == number]
        x1, y1, x2, y2 = part[0][7:11]
        within = lambda b: x1 <= (b[0] + b[2]) / 2 <= x2 and y1 <= (b[1] + b[3]) / 2 <= y2  # noqa: B023, E731
        new = [(*r[1:7], True) for r in part if within(r[1:6])]
        left = [b for b in held if not within(b)] if new else held
        receipts.append((number, len(held) - len(left), len(new)))
        held = sorted(left + new, key=lambda b: (b[1], b[0])) if new else held
    return held, receipts


_AREA = ["rx1", "ry1", "rx2", "ry2"]


def _with_areas(base: DataFrame, reads: DataFrame) -> DataFrame:
    keys = [F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page")]
    sure = lambda df: (F.col("confidence") if "confidence" in df.columns else F.lit(None)).cast("double").alias("confidence")
    old = base.select(*keys, F.lit(0).alias("region_no"), *_BOX, "text", sure(base), "line_no", *[F.lit(None).cast("double").alias(c) for c in _AREA])
    return old.unionByName(reads.select(*keys, F.col("region_no").cast("int").alias("region_no"), *_BOX, "text", sure(reads), "line_no", *_AREA))


def repair_receipts(base: DataFrame, reads: DataFrame) -> DataFrame:
    """doc_id, page, region_no, replaced_lines and added_lines of each region with reads, as ``repair_pages`` applies them."""
    one = lambda key, rows: [(*key, *r) for r in _apply_regions(rows)[1]]
    return map_groups(_with_areas(base, reads), ["doc_id", "page"], ["region_no", "line_no"], one, "doc_id string, page int, region_no int, replaced_lines int, added_lines int", ["region_no", *_BOX, "text", "confidence", *_AREA])


def repair_pages(base: DataFrame, reads: DataFrame) -> DataFrame:
    """As ``replace_lines``, but a page's regions are applied one after another, each seeing what the earlier ones changed.

    reads carry the region's box (rx1..ry2) and region_no (from 1).  A page's lines are one small group.
    """
    schema = "doc_id string, page int, x1 double, y1 double, x2 double, y2 double, text string, confidence double, repaired boolean"
    one = lambda key, rows: [(*key, *b) for b in _apply_regions(rows)[0]]
    return map_groups(_with_areas(base, reads), ["doc_id", "page"], ["region_no", "line_no"], one, schema, ["region_no", *_BOX, "text", "confidence", *_AREA])
