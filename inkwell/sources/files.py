"""Document files: scan, validation, images, ground truth, prompts."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import fill_template
from inkwell.operators.peers import pixel_digest

FORMATS = ["pdf", "png", "jpg", "jpeg", "tif", "tiff", "webp"]
MOST_FILES, FILE_BYTES, BATCH_BYTES, MOST_PAGES, MOST_PIXELS = 20, 50_000_000, 500_000_000, 100, 40_000_000


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, ext, content, size, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def validate_files(files: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Files with ``problem`` (null if there is none): kind, emptiness, size, the PDF mark; and, given the image source's
    rows of the same files, whether images can be read and are not too large."""
    out = files
    broken: Column = F.lit(False)
    if images is not None:
        seen = images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("_w"), F.col("image.height").alias("_h"))
        out = out.join(seen, "path", "left")
        broken = (F.col("ext") != "pdf") & (F.coalesce(F.col("_w"), F.lit(-1)) < 1)
    problem = (
        F.when(~F.col("ext").isin(FORMATS), "unsupported kind of file")
        .when(F.col("size") == 0, "empty file")
        .when(F.col("size") > FILE_BYTES, "file too large")
        .when((F.col("ext") == "pdf") & ~F.startswith("content", F.lit(b"%PDF-")), "not a PDF")
        .when(broken, "not an image that can be read")
    )
    if images is not None:
        problem = problem.when(F.col("_w").cast("long") * F.col("_h") > MOST_PIXELS, "image too large")
    return out.withColumn("problem", problem).drop("_w", "_h")


def batch_problems(files: DataFrame) -> DataFrame:
    """One row: number of files, bytes, and what is wrong with the batch."""
    total = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return total.withColumn("problem", F.when(F.col("files") < 1, "no files").when(F.col("files") > MOST_FILES, "too many files").when(F.col("bytes") > BATCH_BYTES, "batch too large"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, image (raw), digest of every readable image that isn't too large."""
    found = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    colour = found.where((F.col("nChannels") == 3) & (F.col("width").cast("long") * F.col("height") <= MOST_PIXELS))
    return colour.select(F.col("origin").alias("path"), "width", "height", F.col("data").alias("image"), pixel_digest("data", "height", "width").alias("digest"))


def page_range(value: Column, most: int = MOST_PAGES) -> Column:
    """``1-3,5`` as (pages, error): sorted distinct page numbers, null for blank, an error for anything else."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parts = F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: F.struct(F.try_to_number(F.regexp_extract(p, r"^(\d+)", 1), F.lit("9999999999")).cast("long").alias("a"), F.try_to_number(F.regexp_extract(p, r"(\d+)$", 1), F.lit("9999999999")).cast("long").alias("b")))
    shaped = F.regexp_replace(text, r"\s", "").rlike(r"^\d{1,9}(-\d{1,9})?(,\d{1,9}(-\d{1,9})?)*$")
    sound = shaped & F.forall(parts, lambda p: (p["a"] >= 1) & (p["b"] >= p["a"]) & (p["b"] - p["a"] < most))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(p["a"], p["b"])))))
    good = F.when(sound, pages)
    few = F.size(good) <= most
    return F.when(text == "", F.struct(F.lit(None).cast("array<bigint>").alias("pages"), F.lit(None).cast("string").alias("error"))).otherwise(
        F.struct(F.when(few, good).alias("pages"), F.when(~F.coalesce(sound, F.lit(False)), "not a page range").when(~few, "too many pages").alias("error"))
    )


def range_text(scope: Column, first: Column, last: Column) -> Column:
    """The range text of a choice: all pages, one page, or from one to another."""
    return F.when(scope == "all", "").when(scope == "single", first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))


def select_pages(pages: DataFrame, wanted: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Pages of documents in their selection (doc_id, selected array or null); a document without selection must have at
    most ``most`` pages, a selection must not go beyond the document (``plans.process.preflight`` names those that fail)."""
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    chosen = wanted.join(total, "doc_id").where(F.when(F.col("selected").isNull(), F.col("total") <= most).otherwise(F.array_max("selected") <= F.col("total")))
    return pages.join(chosen.select("doc_id", "selected"), "doc_id").where(F.col("selected").isNull() | F.array_contains("selected", F.col("page").cast("long"))).drop("selected")


def read_truth(spark: SparkSession, path: str, suite: list[str]) -> DataFrame:
    """Ground truth of a fixed suite (``<stem>.parse.json``); all missing documents are named in one error."""
    schema = "markdown string, structure struct<children:array<struct<grounding:struct<page:int,range:struct<start:int,end:int>>,atomic_grounding:array<struct<range:struct<start:int,end:int>,box:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.parse.json").json(path).withColumn("document", F.regexp_extract(F.input_file_name(), r"([^/]*)\.parse\.json$", 1))
    wanted = spark.createDataFrame([(s,) for s in suite], "document string")
    missing = [r[0] for r in wanted.join(raw.select("document"), "document", "left_anti").sort("document").collect()]  # of a short fixed list
    if missing:
        raise FileNotFoundError("missing ground truth: " + ", ".join(missing))
    children = F.col("structure.children")
    return raw.join(wanted, "document", "left_semi").select(
        "document",
        "markdown",
        F.transform(children, lambda c: F.struct(c["grounding"]["page"].alias("page"), c["grounding"]["range"]["start"].alias("start"), c["grounding"]["range"]["end"].alias("end"))).alias("structure"),
        F.transform(children, lambda c: F.struct(c["grounding"]["page"].alias("page"), F.transform(c["atomic_grounding"], lambda a: F.struct(a["range"]["start"].alias("start"), a["range"]["end"].alias("end"), a["box"].alias("box"))).alias("atoms"))).alias("children"),
    )


def load_prompt(folder: str, name: str, **values: str) -> tuple[str, str]:
    """(text with its places filled, SHA-256 of the template)."""
    template = Path(folder, f"{name}.md").read_text(encoding="utf-8")
    return fill_template(template, values), hashlib.sha256(template.encode()).hexdigest()
