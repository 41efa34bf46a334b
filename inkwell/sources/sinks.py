"""Writers of results."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions import text as X


def numbered_stems(artifacts: DataFrame, seq: str = "seq", name: str = "source_name") -> DataFrame:
    """Adds ``stem``: safe file stems without collisions (x, x-2, x-3 in the order of ``seq``).  Numbering is by name, so
    only files of one name meet in a task."""
    base = artifacts.withColumn("_stem", X.safe_stem(F.col(name)))
    nth = F.row_number().over(Window.partitionBy("_stem").orderBy(seq))
    return base.withColumn("_nth", nth).withColumn("stem", F.when(F.col("_nth") == 1, F.col("_stem")).otherwise(F.concat_ws("-", "_stem", F.col("_nth")))).drop("_stem", "_nth")


def result_zips(artifacts: DataFrame, by: str = "batch") -> DataFrame:
    """One ZIP for each batch (batches are limited in files and bytes): Markdown and JSON of documents with Markdown."""
    named = numbered_stems(artifacts.where(F.coalesce(F.col("markdown"), F.lit("")) != ""))

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in batch.sort_values("seq").itertuples():
                for suffix, body in (("md", r.markdown), ("json", r.output_json)):
                    z.writestr(zipfile.ZipInfo(f"{r.stem}.{suffix}"), body or "")
        return pd.DataFrame({by: [str(batch[by].iloc[0])], "files": [len(batch)], "content": [out.getvalue()]})

    return named.withColumn(by, F.col(by).cast("string")).groupBy(by).applyInPandas(pack, f"{by} string, files int, content binary")


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    envelopes.select("output_json").write.mode("overwrite").text(path)


def write_run(results: DataFrame, path: str) -> None:
    """Evaluation results by policy and document."""
    results.write.mode("overwrite").partitionBy("policy", "document").json(path)


def candidates(policy: str, pages: DataFrame, lines: DataFrame, repairs: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """policy, document, markdown, json of what each document was parsed to: its pages in order, its line catalog, repairs and
    issues.

    pages: doc_id, page, markdown; lines: the catalog; repairs and issues as ``parse_documents`` gives them.  All that a
    document has is limited.
    """
    text = F.transform(F.sort_array(F.collect_list(F.struct("page", "markdown"))), lambda p: F.struct(p["page"].alias("page"), p["markdown"].alias("markdown")))
    own = pages.groupBy("doc_id").agg(text.alias("pages"))
    box = F.array("x1", "y1", "x2", "y2").alias("bbox")
    catalog = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "id", "text", box, "source", "confidence"))).alias("lines"))
    both = own.join(catalog, "doc_id", "left")
    parts = [F.coalesce("lines", F.array()).alias("lines")]
    for name, rows, columns in (("repairs", repairs, ("page", "region_id", "bbox", "reason", "replaced_lines", "added_lines", "status", "ocr_calls")), ("issues", issues, ("code", "message", "stage"))):
        if rows is not None:
            both = both.join(rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)), "doc_id", "left")
        parts.append((F.coalesce(name, F.array()) if rows is not None else F.array()).alias(name))
    whole = F.array_join(F.transform("pages", lambda p: p["markdown"]), "\n\n").alias("markdown")
    body = F.to_json(F.struct(whole, "pages", *parts, F.transform("pages", lambda p: p["page"]).alias("processed_pages")))
    return both.select(F.lit(policy).alias("policy"), F.col("doc_id").alias("document"), whole, body.alias("json"))


def write_evaluation(path: str, parsed: DataFrame, results: DataFrame, report: DataFrame) -> None:
    """An evaluation run as files below ``path``: ``candidates`` and ``results`` by policy and document, and ``report`` as
    Markdown.

    parsed: rows of ``candidates``; report: one row with the column markdown.
    """
    parsed.write.partitionBy("policy", "document").json(f"{path}/candidates")
    write_run(results, f"{path}/results")
    report.select("markdown").coalesce(1).write.text(f"{path}/report")


def run_zips(parsed: DataFrame, results: DataFrame) -> DataFrame:
    """policy, files, content: the candidates and results of each policy of an evaluation (of a fixed, small suite) as ZIP."""
    both = parsed.join(results.select("policy", "document", F.to_json(F.struct(*[c for c in results.columns if c not in ("policy", "document")])).alias("metrics")), ["policy", "document"], "left")

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        out, files = io.BytesIO(), 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in batch.sort_values("document").itertuples():
                for name, body in (("candidate.md", r.markdown), ("candidate.json", r.json), ("metrics.json", r.metrics)):
                    z.writestr(zipfile.ZipInfo(f"{r.policy}/{r.document}/{name}"), body or "")
                    files += 1
        return pd.DataFrame({"policy": [batch["policy"].iloc[0]], "files": [files], "content": [out.getvalue()]})

    return both.groupBy("policy").applyInPandas(pack, "policy string, files int, content binary")


def annotations(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Frames to draw on each page's image: doc_id, page, id, frame (pixels), width, colour; pages without size have none."""
    sized = pages.where((F.col("width") > 0) & (F.col("height") > 0)).select("doc_id", "page", (F.col("shot_w") / F.col("width")).alias("across"), (F.col("shot_h") / F.col("height")).alias("down"))
    drawn = lines.join(sized, ["doc_id", "page"]).withColumn("a", G.annotation_frame(G.box("x1", "y1", "x2", "y2"), F.col("source"), F.col("across"), F.col("down")))
    return drawn.select("doc_id", "page", "id", "a.frame", "a.width", "a.colour")
