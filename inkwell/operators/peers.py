"""Peer evidence: the same printed block on other pages, read where it is clearest."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import geometry as G
from inkwell.functions import text as X
from inkwell.functions.png import write_png

LEAST_LENGTH, CLEARER, LEAST_PEERS = 8, 1.05, 2
CHECKBOXES = "☐☑☒□■✓✗✔✘"


def is_safe_signature(norm: Column) -> Column:
    """Long enough, without digits or boxes to tick: a text that must be the same wherever it stands."""
    return (F.char_length(norm) >= LEAST_LENGTH) & ~norm.rlike(r"\p{Nd}|\p{No}") & ~norm.rlike(f"[{CHECKBOXES}]")


def signatures(blocks: DataFrame, ocr: DataFrame, compose: bool = True) -> DataFrame:
    """Safe blocks: doc_id, page, block_no, kind, signature.  A block counts if OCR lines lie in it and all are printed."""
    b = blocks.where(F.col("x").isNotNull()).withColumn("signature", X.normalize_inline(F.coalesce(F.col("text"), F.lit("")), compose)).where(is_safe_signature(F.col("signature")))
    b = b.withColumn("area", G.box(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")))
    inside = b.join(ocr.select("doc_id", "page", G.box("x1", "y1", "x2", "y2").alias("line"), "source_kind"), ["doc_id", "page"]).where(G.center_inside(F.col("line"), F.col("area")))
    return inside.groupBy("doc_id", "page", "block_no", "kind", "signature").agg(F.bool_and(F.col("source_kind") == "printed").alias("printed")).where("printed").drop("printed")


def peer_blocks(signed: DataFrame, least: int = LEAST_PEERS) -> DataFrame:
    """Blocks with at least ``least`` blocks of the same kind and text on other pages: adds peers.

    Counted by pages, without pairing blocks: peers = pages that hold the text, less one."""
    pages = signed.groupBy("doc_id", "kind", "signature").agg(F.count_distinct("page").alias("on_pages"))
    return signed.join(pages, ["doc_id", "kind", "signature"]).withColumn("peers", F.col("on_pages") - 1).where(F.col("peers") >= least).drop("on_pages")


def target_block(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each region with the first block that holds its centre."""
    b = blocks.where(F.col("x").isNotNull()).select("doc_id", "page", "block_no", G.box(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")).alias("area"))
    hit = regions.join(b, ["doc_id", "page"]).where(G.center_inside(G.box("x1", "y1", "x2", "y2"), F.col("area")))
    return hit.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page", "region_id").orderBy("block_no"))).where("nth = 1").drop("nth", "area")


def clearest_peer(crops: DataFrame) -> DataFrame:
    """For each block the clearest peer of another page, if it is clearer by enough.

    crops: doc_id, kind, signature, page, block_no, clarity.  The best two pages of each text are enough to serve all of its
    blocks, so blocks are not paired with each other.
    """
    by = Window.partitionBy("doc_id", "kind", "signature")
    best = crops.groupBy("doc_id", "kind", "signature", "page").agg(F.max("clarity").alias("clarity"))
    best = best.withColumn("nth", F.row_number().over(by.orderBy(F.desc("clarity"), F.desc("page")))).where("nth <= 2")
    top = best.groupBy("doc_id", "kind", "signature").agg(F.sort_array(F.collect_list(F.struct("nth", "page", "clarity"))).alias("top"))
    pick = F.element_at(F.filter("top", lambda t: t["page"] != F.col("page")), 1)
    joined = crops.join(top, ["doc_id", "kind", "signature"]).withColumn("peer", F.when(F.size(F.filter("top", lambda t: t["page"] != F.col("page"))) > 0, pick))
    return joined.where(F.col("peer.clarity") > F.lit(CLEARER) * F.col("clarity")).select("doc_id", "page", "block_no", F.col("peer.page").alias("peer_page"), F.round("peer.clarity", 4).alias("peer_clarity"))


def grey(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16


def edge_variance(rgb: np.ndarray) -> float:
    """Variance of a grey image after an edge filter: high where strokes are sharp."""
    flat = grey(rgb)
    out = flat.copy()
    if min(flat.shape) >= 3:
        around = sum(flat[1 + dy : flat.shape[0] - 1 + dy, 1 + dx : flat.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[1:-1, 1:-1] = np.clip(9 * flat[1:-1, 1:-1] - around, 0, 255)
    return float(out.var())


@F.pandas_udf(T.DoubleType())
def clarity(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """Clarity of raw images as Spark's image source gives them (rows of blue, green, red)."""
    return pd.Series([edge_variance(np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)[..., ::-1]) for p, h, w in zip(pixels, height, width, strict=True)])


@F.pandas_udf(T.StringType())
def pixel_digest(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """SHA-256 of an image's size and its red, green, blue bytes: the same however the file was encoded."""
    import hashlib

    def one(p, h, w):
        rgb = np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)[..., ::-1]
        return hashlib.sha256(int(w).to_bytes(4, "big") + int(h).to_bytes(4, "big") + np.ascontiguousarray(rgb).tobytes()).hexdigest()

    return pd.Series([one(*x) for x in zip(pixels, height, width, strict=True)])


@F.pandas_udf(T.BinaryType())
def png_pixels(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """A raw image as PNG."""
    return pd.Series([write_png(np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)[..., ::-1]) for p, h, w in zip(pixels, height, width, strict=True)])


@F.pandas_udf(T.BinaryType())
def crop_pixels(pixels: pd.Series, height: pd.Series, width: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """The cut of an image by a pixel box (rounded, and clamped to the image), as PNG."""

    def one(p, h, w, a, b, c, d):
        image = np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)[..., ::-1]
        a, b = max(0, round(a)), max(0, round(b))
        cut = image[b : max(b + 1, min(int(h), round(d))), a : max(a + 1, min(int(w), round(c)))]
        return write_png(cut)

    return pd.Series([one(*x) for x in zip(pixels, height, width, x1, y1, x2, y2, strict=True)])


@F.pandas_udf(T.DoubleType())
def crop_clarity(pixels: pd.Series, height: pd.Series, width: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """Clarity of the cut of an image by a pixel box."""

    def one(p, h, w, a, b, c, d):
        image = np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)[..., ::-1]
        a, b = max(0, round(a)), max(0, round(b))
        return edge_variance(image[b : max(b + 1, min(int(h), round(d))), a : max(a + 1, min(int(w), round(c)))])

    return pd.Series([one(*x) for x in zip(pixels, height, width, x1, y1, x2, y2, strict=True)])


def peer_evidence(regions: DataFrame, blocks: DataFrame, ocr: DataFrame, images: DataFrame, least: int = LEAST_PEERS) -> DataFrame:
    """For each region whose block stands, clearer, on another page too: doc_id, page, region_id, peer_page, peer_clarity and
    peer, the cut of that page's image as a data URL.

    regions, blocks and ocr in pixels: doc_id, page, region_id and box; doc_id, page, block_no, kind, text, x, y, width, height;
    doc_id, page, box and source_kind.  images: doc_id, page, image (rows of blue, green, red), height, width.  Only blocks that
    hold a region, and their likes, are cut.
    """
    keys = ["doc_id", "kind", "signature"]
    signed = peer_blocks(signatures(blocks, ocr), least)
    targets = target_block(regions, blocks).join(signed, ["doc_id", "page", "block_no"]).select("doc_id", "page", "region_id", "block_no", *keys[1:])
    box = blocks.select("doc_id", "page", "block_no", F.col("x").alias("bx1"), F.col("y").alias("by1"), (F.col("x") + F.col("width")).alias("bx2"), (F.col("y") + F.col("height")).alias("by2"))
    likes = signed.join(targets.select(*keys).distinct(), keys, "left_semi").join(box, ["doc_id", "page", "block_no"])
    edges = ["bx1", "by1", "bx2", "by2"]
    crops = likes.join(images, ["doc_id", "page"]).select(*keys, "page", "block_no", crop_clarity("image", "height", "width", *edges).alias("clarity"))
    best = clearest_peer(crops).join(targets, ["doc_id", "page", "block_no"])
    # The first block of that text on the peer's page.
    there = likes.groupBy(*keys, F.col("page").alias("peer_page")).agg(F.min_by(F.struct(*edges), "block_no").alias("b"))
    shown = best.join(there, [*keys, "peer_page"]).join(images.withColumnRenamed("page", "peer_page"), ["doc_id", "peer_page"])
    cut = crop_pixels("image", "height", "width", *[F.col("b")[e] for e in edges])
    return shown.select("doc_id", "page", "region_id", "peer_page", "peer_clarity", X.data_url(cut).alias("peer"))
