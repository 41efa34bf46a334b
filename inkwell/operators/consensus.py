"""Agreement among repeated reads of one region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions import text as X

LEAST_IOU = 0.35


def resolve_reads(reads: DataFrame, key: str = "region_id", compose: bool = True, made: DataFrame | None = None) -> DataFrame:
    """A row for each region: status (consensus, majority, disagreement), accepted, calls, and the agreed lines.

    reads: key, read_no (1 to 3), line_no, text and box.  Two reads agree when they have the same number of lines with the
    same normalised texts, and boxes that overlap enough.  Else a third read decides line by line: two of three must agree,
    and the earliest of them is taken.  It is all or nothing: one line without agreement rejects the region, and so does a
    read without lines or with another number of lines.

    ``made``: key and read_no of every read that was made, since one that found no lines has none in ``reads``.  Without it,
    reads are those that have lines.
    """
    boxed = reads.withColumn("b", G.box("x1", "y1", "x2", "y2")).withColumn("norm", X.normalize_inline(F.col("text"), compose))
    sizes = boxed.groupBy(key, "read_no").agg(F.count("line_no").alias("n"))
    if made is not None:
        sizes = made.select(key, "read_no").distinct().join(sizes, [key, "read_no"], "left").na.fill(0, ["n"])
    shape = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.when(F.col("read_no") == 1, F.col("n"))).alias("first"))
    # Per line: the largest group of reads with one text; ties go to the group that was read first.
    groups = boxed.groupBy(key, "line_no", "norm").agg(F.count(F.lit(1)).alias("votes"), F.min_by(F.struct("text", "b"), "read_no").alias("pick"), F.min("read_no").alias("seen"), F.collect_list("b").alias("boxes"))
    order = Window.partitionBy(key, "line_no").orderBy(F.desc("votes"), "seen")
    best = groups.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    overlap = F.forall("boxes", lambda x: G.iou(F.col("pick.b"), x) >= LEAST_IOU)
    lines = best.groupBy(key).agg(
        F.bool_and((F.col("votes") >= 2) & overlap).alias("agreed"),
        F.min("votes").alias("least_votes"),
        F.sort_array(F.collect_list(F.struct("line_no", F.col("pick.text").alias("text"), F.col("pick.b").alias("box")))).alias("lines"),
    )
    both = shape.join(lines, key, "left")
    # min_by picks among the agreeing reads the first; a region read twice needs every vote, one read thrice needs two.
    whole = (F.col("least") == F.col("most")) & (F.col("first") > 0) & (F.col("calls") >= 2) & F.col("agreed")
    status = F.when(whole & (F.col("calls") == 2), "consensus").when(whole, "majority").otherwise("disagreement")
    return both.select(key, status.alias("status"), (status != "disagreement").alias("accepted"), F.col("calls").cast("int").alias("calls"), F.when(status != "disagreement", F.col("lines")).alias("lines"))


def needs_third_read(first_two: DataFrame, key: str = "region_id", compose: bool = True, made: DataFrame | None = None) -> DataFrame:
    """Keys of the regions whose two reads don't agree; only those are read a third time."""
    return resolve_reads(first_two, key, compose, made).where("not accepted").select(key)
