"""Corpus pipeline: language ID, removal of near duplicates, mixing to target weights, best-fit packing.

Each stage reads the documents that the one before it kept, as stored Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import free, written
from inkwell.llm.langid import ADDED, UNDETERMINED, identify
from inkwell.llm.mixing import TARGETS, mix_documents
from inkwell.llm.packing import pack_documents
from inkwell.llm.setjoin import jaccard_components

#: Near duplicates: Jaccard similarity of word shingles, in per cent, and words of a shingle.
SIMILARITY, SHINGLE = 80, 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told: texts that are null or have no letters go.  Null keys and repeated rows
    are kept; an empty table stays empty."""
    names = free(docs.columns, *ADDED)
    return identify(docs, names=tuple(names)).where(F.col(names[1]) != UNDETERMINED).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that with the smallest doc_id; a row that repeats a doc_id goes
    with it.  Documents without key or without words are kept."""
    groups = jaccard_components(docs, width=SHINGLE, percent=SIMILARITY)
    drop = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that half of the tokens stay and meet the target shares of sources, languages and topics.  Null is
    a category like any other, rows that repeat a key go the same way, and documents without words go."""
    return mix_documents(docs, TARGETS, keep=docs.columns).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences; a row a piece.  A null text is its end token; every row is packed, also
    without key or if it repeats one; texts of any length are packed whole."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can't express language ID, raking or packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
