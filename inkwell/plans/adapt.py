"""Deterministic views of the driver's tables as parsed documents: lines, repeated reads, regions, pages, blocks.

A document's text lines are its lines, five a page; boxes, confidences and second reads follow from the numbers of document
and line.  The SQL beside each view says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, page, idx, id, text, box in points, confidence."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    page, idx = F.expr("cast(1 + pos div 5 as int)"), F.expr("1 + pos % 5")
    each = each.withColumns({"page": page, "idx": idx})
    top = (F.col("idx") - 1).cast("double") * 12
    return each.select(
        "doc_id",
        "pos",
        "page",
        "idx",
        X.line_id(F.col("page"), F.col("idx")).alias("id"),
        "text",
        F.lit(36.0).alias("x1"),
        (36.0 + top).alias("y1"),
        (36.0 + F.least(F.char_length("text"), F.lit(90)).cast("double") * 5).alias("x2"),
        (46.0 + top).alias("y2"),
        ((80 + (F.col("doc_id") * 7 + F.col("pos") * 13) % 20).cast("double") / 100.0).alias("confidence"),
    )


LINES_SQL = """
src AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
cutted AS (SELECT doc_id, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos FROM src),
lines AS (
  SELECT doc_id, pos, CAST(1 + pos // 5 AS INTEGER) AS page, CAST(1 + pos % 5 AS INTEGER) AS idx,
    printf('p%d-l%04d', 1 + pos // 5, 1 + pos % 5) AS id, text,
    CAST(36 AS DOUBLE) AS x1, CAST(36 + (pos % 5) * 12 AS DOUBLE) AS y1,
    CAST(36 + least(length(text), 90) * 5 AS DOUBLE) AS x2, CAST(46 + (pos % 5) * 12 AS DOUBLE) AS y2,
    CAST(80 + (doc_id * 7 + pos * 13) % 20 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
  FROM cutted
)
"""


def reads(spark: SparkSession, sf_dir: str, third: bool = False) -> DataFrame:
    """Repeated reads of each page as a region: region_id, read_no, line_no, text, box.

    The second read differs where (doc_id + pos) % 211 = 0, the third where it is 1 mod 211."""
    base = lines(spark, sf_dir).select(F.concat_ws("/", "doc_id", "page").alias("region_id"), F.col("idx").alias("line_no"), "text", "x1", "y1", "x2", "y2", (F.col("doc_id") + F.col("pos")).alias("k"))
    numbers = [F.struct(F.lit(1).alias("n"), F.col("text").alias("t")), F.struct(F.lit(2).alias("n"), F.when(F.col("k") % 211 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text")).alias("t"))]
    if third:
        numbers.append(F.struct(F.lit(3).alias("n"), F.when(F.col("k") % 211 == 1, F.concat("text", F.lit("##"))).when(F.col("k") % 422 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("t")))
    return base.select("region_id", F.explode(F.array(*numbers)).alias("r"), "line_no", "x1", "y1", "x2", "y2").select("region_id", F.col("r.n").alias("read_no"), "line_no", F.col("r.t").alias("text"), "x1", "y1", "x2", "y2")


def low_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of the lines of low confidence."""
    low = lines(spark, sf_dir).where(X.is_low_confidence(F.col("confidence")))
    return low.select("doc_id", "page", "x1", "y1", "x2", "y2", F.lit("low confidence").alias("reason"), F.lit(1).alias("src_order"), F.lit(612.0).alias("shot_w"), F.lit(792.0).alias("shot_h"))
