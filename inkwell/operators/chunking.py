"""Chunks of a document's pages, bounded in pages and characters, and the tree that merges their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.grouping import map_groups

MOST_PAGES, MOST_CHARS, FAN_IN = 8, 60_000, 10


def fold_chunks(sizes: Column, most_items: int = MOST_PAGES, most_chars: int = MOST_CHARS) -> Column:
    """Chunk number (from 0) of each item of an array of sizes: a chunk is closed before the item that would pass one of
    its two limits.  Built-in functions only; for items that don't have to be split."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, size: Column) -> Column:
        full = (a["items"] > 0) & ((a["items"] >= most_items) | (a["chars"] + size > most_chars))
        chunk = a["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, 1).otherwise(a["items"] + 1).alias("items"), F.when(full, size.cast("long")).otherwise(a["chars"] + size).alias("chars"), F.concat(a["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def split_document(pages: list[tuple[int, str, str, list[tuple[str, str]]]], most_pages: int, most_chars: int) -> list[tuple[str, list[str], list[int]]]:
    """Chunks (markdown, line ids, pages) of pages (page, markdown, catalog, lines).

    A page beyond the limit closes the chunk before it and is split by its lines, or if it has none into raw slices.
    """
    out: list[tuple[str, list[str], list[int]]] = []
    held: list[tuple[int, str, list[str], int]] = []

    def close() -> None:
        if held:
            out.append(("\n\n".join(h[1] for h in held), [i for h in held for i in h[2]], [h[0] for h in held]))
            held.clear()

    for page, markdown, catalog, lines in pages:
        size = len(markdown) + len(catalog)
        if size > most_chars:
            close()
            if not lines:
                out += [(markdown[i : i + most_chars], [], [page]) for i in range(0, len(markdown), most_chars)]
                continue
            ids, texts, filled = [], [], 0
            for line, text in lines:
                if ids and filled + len(text) > most_chars:
                    out.append(("\n".join(texts), ids, [page]))
                    ids, texts, filled = [], [], 0
                ids, texts, filled = [*ids, line], [*texts, text], filled + len(text)
            out.append(("\n".join(texts), ids, [page]))
            continue
        if held and (len(held) >= most_pages or sum(h[3] for h in held) + size > most_chars):
            close()
        held.append((page, markdown, [i for i, _ in lines], size))
    close()
    return out


def chunk_documents(pages: DataFrame, most_pages: int = MOST_PAGES, most_chars: int = MOST_CHARS) -> DataFrame:
    """doc_id, chunk_no, markdown, line_ids, pages from doc_id, page, markdown, catalog, lines (array of id, text).

    A document's pages are one group; pages are limited for each document.
    """
    schema = "doc_id string, chunk_no int, markdown string, line_ids array<string>, pages array<int>"

    def one(key: tuple, rows: list[tuple]) -> list[tuple]:
        pages = [(int(page), markdown or "", catalog or "", [(x["id"], x["text"]) for x in (own if own is not None else [])]) for page, markdown, catalog, own in rows]
        return [(*key, i, *c) for i, c in enumerate(split_document(pages, most_pages, most_chars))]

    named = pages.withColumn("doc_id", F.col("doc_id").cast("string"))
    return map_groups(named, ["doc_id"], ["page"], one, schema, ["page", "markdown", "catalog", "lines"])


def merge_levels(counts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The merges that documents of n chunks need: doc_id, level, inputs, groups, calls (groups of one pass through)."""
    levels = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log(float(fan_in), F.greatest(F.col("n"), F.lit(1)))).cast("int") + 1)), lambda i: F.struct(i.alias("level"), F.ceil(F.col("n") / F.pow(F.lit(float(fan_in)), i - 1)).cast("long").alias("inputs")))
    rows = counts.select("doc_id", F.explode(levels).alias("l")).select("doc_id", "l.level", "l.inputs").where("inputs > 1")
    groups = F.ceil(F.col("inputs") / F.lit(float(fan_in))).cast("long")
    single = (F.col("inputs") % fan_in == 1).cast("long")
    return rows.select("doc_id", "level", "inputs", groups.alias("groups"), (groups - single).alias("calls"))
