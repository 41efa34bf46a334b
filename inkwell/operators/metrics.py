"""Accuracy of parsed documents against a ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions import text as X
from inkwell.operators.grouping import map_groups, spread


def precision_recall(matched: Column, candidate: Column, reference: Column) -> Column:
    """precision, recall and f1; without candidates precision is 1 only if there is no reference either, and vice versa."""
    p = F.when(candidate == 0, F.when(reference == 0, 1.0).otherwise(0.0)).otherwise(matched / candidate)
    r = F.when(reference == 0, F.when(candidate == 0, 1.0).otherwise(0.0)).otherwise(matched / reference)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def bag_matches(candidate: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """matched, candidate and reference counts of values by ``keys``, as bags: order is of no account."""
    left = candidate.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    right = reference.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("r"))
    both = left.join(right, [*keys, value], "full").na.fill(0, ["c", "r"])
    return both.groupBy(*keys).agg(F.sum(F.least("c", "r")).alias("matched"), F.sum("c").alias("candidate"), F.sum("r").alias("reference"))


def _iou(a: tuple, b: tuple) -> float:
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    return wide * high / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - wide * high)


def greedy_matches(candidate: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Pair the lines of one text on one page: each candidate in order takes the unused reference line of greatest overlap,
    the first of equals; a reference line is used once.

    Both: keys, text (normalised), line_no, box.  Gives keys, text, ref_no, cand_no, iou.  Lines of one text on one page are
    one small group.
    """
    group = [*keys, "text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reference.select(*group).schema.fields)
    box = ["x1", "y1", "x2", "y2"]

    def pair(key: tuple, rows: list[tuple]) -> list[tuple]:
        free = [r for r in rows if r[0] == 1]
        out = []
        for _, number, *own in (r for r in rows if r[0] == 0):
            if not free:
                break
            overlaps = [_iou(own, r[2:]) for r in free]
            best = max(overlaps)
            out.append((*key, free.pop(overlaps.index(best))[1], number, best))
        return out

    side = lambda df, n: df.select(*group, F.lit(n).alias("side"), F.col("line_no").cast("int").alias("line_no"), *box)
    both = side(candidate, 0).unionByName(side(reference, 1))
    return map_groups(both, group, ["side", "line_no"], pair, f"{kinds}, ref_no int, cand_no int, iou double", ["side", "line_no", *box])


def truth_pages(truth: DataFrame) -> DataFrame:
    """Pages of ground truth from document, markdown, structure (array of page, start, end): slices of the text by code
    points, in the order of the structure."""
    each = truth.select("document", "markdown", F.posexplode("structure").alias("pos", "s"))
    return each.select("document", F.col("s.page").alias("page"), F.col("pos").alias("seq"), F.substring("markdown", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("markdown"))


def truth_lines(truth: DataFrame) -> DataFrame:
    """Atomic ground-truth lines from document, markdown, children (array of page, atoms (array of start, end, box)); blank
    texts and missing boxes are left out."""
    page = truth.select("document", "markdown", F.explode("children").alias("c"))
    atom = page.select("document", "markdown", F.col("c.page").alias("page"), F.posexplode("c.atoms").alias("line_no", "a"))
    text = F.substring("markdown", F.col("a.start") + 1, F.col("a.end") - F.col("a.start"))
    return atom.select("document", "page", "line_no", X.strip(text).alias("text"), *[F.col(f"a.box.{n}").alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]).where((F.col("text") != "") & F.col("xmin").isNotNull())


def missing_pages(selected: DataFrame, present: DataFrame) -> DataFrame:
    return selected.join(present, ["document", "page"], "left_anti")


def grounding_pages(candidate: DataFrame, reference: DataFrame, sizes: DataFrame, compose: bool = True) -> DataFrame:
    """Line text and grounding of each page: document, page, lines (matched, candidate, reference) and grounding (matched,
    mean_iou).

    candidate: document, page, line_no, text and box of the line catalog, in points; sizes: document, page, width, height of
    the pages in points; reference: as ``truth_lines`` gives it, boxes as shares of the page.  Texts are compared composed,
    with white space collapsed.  Pages without a size are not grounded.
    """
    keys = ["document", "page"]
    plain = lambda df: df.withColumn("text", X.normalize_inline(F.col("text"), compose)).where("text <> ''")
    own = plain(candidate)
    truth = plain(reference.withColumnsRenamed({"xmin": "x1", "ymin": "y1", "xmax": "x2", "ymax": "y2"}))
    bags = bag_matches(own, truth, keys, "text").select(*keys, F.struct("matched", "candidate", "reference").alias("lines"))
    scaled = own.join(sizes.select(*keys, F.col("width").alias("_w"), F.col("height").alias("_h")).where("_w > 0 AND _h > 0"), keys)
    scaled = scaled.withColumns({c: F.col(c) / F.col("_w" if c[0] == "x" else "_h") for c in ("x1", "y1", "x2", "y2")})
    pairs = greedy_matches(scaled, truth, keys).groupBy(*keys).agg(F.struct(F.count(F.lit(1)).alias("matched"), F.avg("iou").alias("mean_iou")).alias("grounding"))
    return bags.join(pairs, keys, "left")


def evaluate_pages(candidate: DataFrame, reference: DataFrame, compose: bool = True, grounded: DataFrame | None = None) -> DataFrame:
    """A row for each reference page: status (failed if the candidate lacks it), raw and normalised character errors, and
    counts for headings, table shapes, table cells and lines, and the grounding.

    Both: document, page, markdown; reference also seq, the place of the page in the structure (by default its number).
    ``grounded`` comes from ``grounding_pages``; without it lines are those of the Markdown, and there is no grounding.
    """
    if "seq" not in reference.columns:
        reference = reference.withColumn("seq", F.col("page"))

    def sides(df: DataFrame, name: str, *more: str) -> DataFrame:
        md = X.normalize_markdown(F.col("markdown"), compose)
        out = df.select("document", "page", *more, F.col("markdown").alias(f"{name}_raw"), md.alias(f"{name}_md"))
        return out.withColumn(f"{name}_tables", X.tables(f"{name}_raw")).withColumn(f"{name}_heads", X.headings(F.col(f"{name}_raw"))).withColumn(f"{name}_lines", F.filter(F.transform(F.split(f"{name}_md", "\n"), lambda x: X.collapse(x)), lambda x: x != ""))

    both = sides(reference, "ref", "seq").join(sides(candidate, "cand"), ["document", "page"], "left")
    ok = F.col("cand_md").isNotNull()

    def bag(c: Column, r: Column) -> Column:
        """Matches of two arrays as bags, within the row: values that both hold, numbered among their likes."""
        each = lambda a: F.transform(F.array_sort(a), lambda x, i: F.struct(x.alias("v"), (i - F.array_position(F.array_sort(a), x)).alias("n")))
        return F.when(ok, F.struct(F.size(F.array_intersect(each(c), each(r))).alias("matched"), F.size(c).alias("candidate"), F.size(r).alias("reference")))

    shapes = lambda t: F.transform(t, lambda x: F.to_json(X.table_shape(x)))
    if grounded is None:
        both = both.withColumn("lines", bag(F.col("cand_lines"), F.col("ref_lines"))).withColumn("grounding", F.lit(None).cast("struct<matched:bigint,mean_iou:double>"))
    else:
        none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("matched", "candidate", "reference")])
        both = both.join(grounded, ["document", "page"], "left").withColumn("lines", F.when(ok, F.coalesce("lines", none))).withColumn("grounding", F.when(ok, F.col("grounding")))
    return both.select(
        "document",
        "page",
        "seq",
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.col("ref_raw"),
        F.col("cand_raw"),
        F.when(ok, X.cer(F.col("cand_raw"), F.col("ref_raw"))).alias("raw_cer"),
        F.when(ok, X.cer(F.col("cand_md"), F.col("ref_md"))).alias("cer"),
        bag(F.transform("cand_heads", lambda h: F.to_json(h)), F.transform("ref_heads", lambda h: F.to_json(h))).alias("headings"),
        bag(shapes(F.col("cand_tables")), shapes(F.col("ref_tables"))).alias("shapes"),
        bag(X.table_cells(F.col("cand_tables")), X.table_cells(F.col("ref_tables"))).alias("cells"),
        "lines",
        "grounding",
    )


def evaluate_documents(pages: DataFrame, compose: bool = True) -> DataFrame:
    """A row for each document: success rate, raw and normalised character errors of the joined pages, micro-averaged scores
    of the pages that are there, and the mean overlap of grounded lines.

    Reference pages are joined in the order of the structure, candidate pages by their numbers.
    """
    ok = F.col("status") == "ok"
    total = lambda c, part: F.coalesce(F.sum(F.when(ok, F.col(f"{c}.{part}"))), F.lit(0))
    micro = lambda c: precision_recall(*[total(c, part) for part in ("matched", "candidate", "reference")]).alias(f"{c}_score")
    joined = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(by).alias("at"), F.col(c).alias("md"))))), lambda s: s["md"]), "\n\n")
    matched = F.sum(F.when(F.col("grounding.mean_iou").isNotNull(), F.col("grounding.matched")))
    out = spread(pages, "document").groupBy("document").agg(
        F.count(F.lit(1)).alias("pages"),
        (F.count_if(ok) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("success_rate"),
        joined("ref_raw", "seq").alias("ref"),
        joined("cand_raw", "page").alias("cand"),
        *[micro(c) for c in ("headings", "shapes", "cells", "lines")],
        (F.sum(F.col("grounding.mean_iou") * F.col("grounding.matched")) / F.nullif(matched, F.lit(0))).alias("grounding_iou"),
    )
    plain = lambda c: X.normalize_markdown(F.col(c), compose)
    # As rows of their own, or whole documents would be normalised anew at each place where their error rate names them.
    normal = out.select("*", F.inline(F.array(F.struct(plain("cand").alias("cand_md"), plain("ref").alias("ref_md")))))
    return normal.withColumn("raw_cer", X.cer(F.col("cand"), F.col("ref"))).withColumn("cer", X.cer(F.col("cand_md"), F.col("ref_md"))).drop("ref", "cand", "cand_md", "ref_md")


def policy_report(results: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each policy: successes, failures, mean metrics over the successful documents, repairs, disagreements."""
    good = F.col("status") == "complete"
    means = [(F.sum(F.when(good, F.col(m)).otherwise(0.0)) / F.greatest(F.lit(1), F.count_if(good))).alias(m) for m in metrics]
    return results.groupBy("policy").agg(F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), *means, F.sum("repairs").alias("repairs"), F.sum("repair_disagreements").alias("repair_disagreements"))


def policy_delta(report: DataFrame, metrics: list[str]) -> DataFrame:
    """accuracy - legacy for each metric; no row unless both policies ran."""
    long = report.select("policy", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))
    wide = long.groupBy("metric").pivot("policy", ["legacy", "accuracy"]).agg(F.first("value"))
    return wide.where("legacy IS NOT NULL AND accuracy IS NOT NULL").select("metric", (F.col("accuracy") - F.col("legacy")).alias("delta"))


def report_markdown(report: DataFrame, metrics: list[str]) -> DataFrame:
    """The report as one Markdown table (a row a policy, so one small group)."""
    row = F.format_string("| %s | %d | %d |" + " %.4f |" * len(metrics), "policy", "successful", "failed", *metrics)
    head = "| policy | ok | failed | " + " | ".join(metrics) + " |\n|" + "---|" * (3 + len(metrics))
    return report.agg(F.concat_ws("\n", F.lit(head), F.array_sort(F.collect_list(row))).alias("markdown"))


def corpus_runs(corpus: DataFrame, policies: list[str]) -> DataFrame:
    """Each document of the fixed evaluation suite under each of the few policies."""
    return corpus.withColumn("policy", F.explode(F.array(*map(F.lit, policies))))


def top_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each left line the right line of the same keys and text with the greatest overlap (the first of equals)."""
    r = right.select(*keys, "text", F.col("line_no").alias("other_no"), G.box("x1", "y1", "x2", "y2").alias("other"))
    joined = left.withColumn("own", G.box("x1", "y1", "x2", "y2")).join(r, [*keys, "text"]).withColumn("overlap", G.iou(F.col("own"), F.col("other")))
    nth = F.row_number().over(Window.partitionBy(*keys, "line_no").orderBy(F.desc("overlap"), "other_no"))
    return joined.withColumn("nth", nth).where("nth = 1").drop("nth", "own", "other")
