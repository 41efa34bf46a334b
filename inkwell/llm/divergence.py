"""How far the sources of a language are from one another, by their use of terms.

Every source, and the language as a whole, gives each term of the language's vocabulary a smoothed share in whole billionths,
p = 1 + floor(10^9 (count + 5) / (N + 5 V)).  Two sources differ by the sum of |p - q| over all terms; a source stands out
by the terms whose share is most above the language's.

Terms with the same counts in all sources have the same shares in all of them.  So terms are grouped by their sparse vector
of counts, every pair of sources is evaluated once for each distinct vector, and the result counts as often as the vector has
terms; only the terms that stand out are looked up again.

* Texts are counted in Arrow batches; a task sends each (language, source, term) once for every few hundred thousand that it
  meets, with its occurrences and documents.
* Distinct vectors are dealt to blocks of about BLOCK by their hash, and sources to tiles of TILE; a group is a block and a
  pair of tiles, so none grows with the table.  Shares are whole numbers and sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, text_bytes, written

#: Documents of its language in which a term must stand, occurrences added to each count, and ranks of terms that are told.
LEAST_DOCUMENTS, ADDED, TOLD = 30, 5, 50
#: Vectors and sources of a group, and counted terms that a task gathers before it sends them on.
BLOCK, TILE, GATHERED = 4096, 256, 300_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Terms of a run of texts, in order, and the row of each: runs of ASCII letters and bytes of other characters."""
    letter = _LETTER[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] |= letter[edges]
    begin = np.flatnonzero(first)
    kept = np.cumsum(letter)
    # Without what parts them, terms lie side by side: where one starts, the one before it ends.
    starts = np.concatenate([kept[begin] - 1, kept[-1:]]).astype(np.int32) if len(begin) else np.zeros(1, np.int32)
    data = _LOWER[raw[letter]]
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(starts.tobytes()), pa.py_buffer(data.tobytes()))
    return words, np.searchsorted(offsets, begin, side="right") - 1


def count_batch(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences) and docs of a batch with lang, source and text."""
    words, row = terms_of(*text_bytes(batch.column("text")))
    held = words.dictionary_encode()
    code, size = held.indices.to_numpy().astype(np.int64), max(1, len(held.dictionary))
    group, names = group_codes(batch)
    # Each (row, term) once with its occurrences, then each (group, term).
    seen, times = np.unique(row * size + code, return_counts=True)
    key = group[seen // size] * size + seen % size
    keys, at = np.unique(key, return_inverse=True)
    n = np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)
    docs = np.bincount(at, minlength=len(keys)).astype(np.int64)
    lang, source = (names.column(i).take(pa.array(keys // size)) for i in (0, 1))
    return pa.Table.from_arrays([lang, source, held.dictionary.take(pa.array(keys % size)), pa.array(n), pa.array(docs)], schema=COUNTED)


def group_codes(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.RecordBatch]:
    """Number of each row's (lang, source), and these by their number."""
    known: dict[tuple, int] = {}
    codes = np.array([known.setdefault(x, len(known)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
    return codes, pa.RecordBatch.from_arrays([pa.array([x[i] for x in known], pa.string()) for i in (0, 1)], names=["lang", "source"])


def summed(parts: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return got.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(COUNTED.names)


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial sums, of ``docs`` with lang, source and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in slices(batches, "text"):
            held.append(count_batch(batch))
            if sum(len(t) for t in held[1:]) > GATHERED // 3:
                held = [summed(held)]
                if len(held[0]) > GATHERED:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                    held = []
        if held:
            yield from summed(held).combine_chunks().to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 count / whole), exact: a long division by thousands, as count is not above whole."""
    out, rest = F.lit(0).cast("long"), count
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, whole), (rest * 1000) % whole
    return out + 1


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same with arrays."""
    out = np.zeros(np.broadcast(count, whole).shape, np.int64)
    rest = count + out
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def pair_sums(n: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums over vectors of times * |p - q|, for each source of one tile (rows) and of another: ``n`` has a vector a row with the
    counts of left's sources, then right's; ``left`` and ``right`` are N + 5 V of each source."""
    p = shares(n[:, : len(left)] + ADDED, left) if len(n) else np.zeros((0, len(left)), np.int64)
    q = shares(n[:, len(left) :] + ADDED, right) if len(n) else np.zeros((0, len(right)), np.int64)
    return np.array([times @ np.abs(p[:, i : i + 1] - q) for i in range(len(left))], np.int64).reshape(len(left), len(right))


def source_pairs(classes: DataFrame, groups: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, a, b, value for each pair of a language's sources, by their numbers (a < b).

    ``classes``: lang, vector (of source number and count) and times; ``groups``: lang, number and whole (N + 5 V).
    """
    # One more block for a language than it may have in full ones: also one without any vector has its pairs.
    made = groups.groupBy("lang").agg(F.max("number").alias("top"), F.max("size").alias("size"))
    made = made.select("lang", F.expr(f"cast(top div {tile} AS int)").alias("last"), F.expr(f"cast(size div {block} AS int) + 1").alias("blocks"))
    tiles = F.expr("flatten(transform(sequence(0, last), i -> transform(sequence(i, last), j -> struct(i, j))))")
    # What a group needs to know of its sources: a row a group.
    lists = groups.groupBy("lang", F.expr(f"cast(number div {tile} AS int)").alias("of")).agg(F.array_sort(F.collect_list(F.struct("number", "whole"))).alias("own"))
    asked = made.select("lang", F.explode(tiles).alias("t"), "blocks").select("lang", F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    side = lambda name, at: lists.select(F.col("lang").alias(f"l_{at}"), F.col("of").alias(f"of_{at}"), F.col("own.whole").alias(name))
    asked = asked.join(side("left", "i"), (F.col("lang") == F.col("l_i")) & (F.col("i") == F.col("of_i"))).join(side("right", "j"), (F.col("lang") == F.col("l_j")) & (F.col("j") == F.col("of_j")))
    asked = asked.select("lang", "i", "j", "block", "left", "right")
    dealt = classes.join(made, "lang").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int")).withColumn("t", F.explode(tiles))
    within = lambda t: f"(x.number div {tile} = t.{t})"
    dealt = dealt.select("lang", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "block", "times", F.expr(f"filter(vector, x -> {within('i')} OR {within('j')})").alias("v"))
    dealt = dealt.select("lang", "i", "j", "block", "times", F.col("v.number").alias("at"), F.col("v.n").alias("n"))

    def evaluate(key: tuple, vectors: pa.Table, sources: pa.Table) -> pa.Table:
        lang, i, j, _ = (x.as_py() for x in key)
        left, right = (np.array(sources[c][0].as_py(), np.int64) for c in ("left", "right"))
        n = np.zeros((vectors.num_rows, len(left) + len(right)), np.int64)
        if vectors.num_rows:
            row = np.repeat(np.arange(vectors.num_rows), [len(x) for x in vectors["at"]])
            at = np.concatenate([np.asarray(x.values) for x in vectors["at"]]).astype(np.int64)
            count = np.concatenate([np.asarray(x.values) for x in vectors["n"]])
            for begin, tile_, size in ((0, i, len(left)), (len(left), j, len(right))):
                own = at // tile == tile_
                n[row[own], begin + at[own] - tile_ * tile] = count[own]
        sums = pair_sums(n, vectors["times"].to_numpy().astype(np.int64), left, right)
        a, b = np.indices(sums.shape)
        a, b = a + i * tile, b + j * tile
        own = a < b
        size = int(own.sum())
        return pa.table({"lang": pa.array([lang] * size, pa.string()), "a": a[own].astype(np.int64), "b": b[own].astype(np.int64), "value": sums[own]})

    by = ["lang", "i", "j", "block"]
    found = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(evaluate, "lang string, a long, b long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, told: int = TOLD, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: by ``pair``, how far each other source of the language is; by ``term``, the
    first ``told`` terms by how far their share is above the language's.

    Null text, language and source count as empty ones, so each is a category.  Repeated rows count as often as they stand
    there; a text of any length is counted whole.  A source without terms is there with its pairs, a language with one
    source has none.  Ties are ranked by item.  An empty table gives no rows, and other columns are not looked at.
    """
    empty = F.lit("")
    docs = docs.select(F.coalesce(lang, empty).alias("lang"), F.coalesce(source, empty).alias("source"), F.coalesce(text, empty).alias("text"))
    # Dealt by term: a common word is one row a task and source by now.
    counted = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = written(counted.withColumn("of_lang", F.sum("docs").over(of_term)).where(F.col("of_lang") >= least).select("lang", "term", "source", "n"), "terms")
    # A row a source: numbers by name within the language, N and V.
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    size = kept.groupBy("lang").agg(F.count_distinct("term").alias("size"), F.sum("n").alias("all"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("number")
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(size, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = written(groups.select("lang", "source", number, zero("size").alias("size"), (zero("own") + zero("size") * ADDED).alias("whole"), (zero("all") + zero("size") * ADDED).alias("all")), "groups")
    vectors = kept.join(groups.select("lang", "source", "number"), ["lang", "source"]).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("number", "n"))).alias("vector"))
    vectors = written(vectors, "vectors")
    classes = vectors.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times"))
    pairs = source_pairs(classes, groups.select("lang", "number", "whole", "size"), block, tile)
    both = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other"))))
    pairs = pairs.select("lang", both.alias("s"), "value").select("lang", F.col("s.own").alias("number"), F.col("s.other").alias("other"), "value")
    names = groups.select("lang", "number", "source")
    pairs = pairs.join(names, ["lang", "number"]).join(names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    # Terms of one vector tie in every source, so no more of them than are told can be among the first.
    few = vectors.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))).where(F.col("nth") <= told)
    few = few.withColumn("whole_n", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"])).select("lang", "term", "whole_n", F.explode("vector").alias("x"))
    stand = few.select("lang", "term", "whole_n", F.col("x.number").alias("number"), F.col("x.n").alias("n")).join(groups.select("lang", "source", "number", "whole", "all"), ["lang", "number"])
    over = share(F.col("n") + ADDED, F.col("whole")) - share(F.col("whole_n") + ADDED, F.col("all"))
    stand = stand.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return columns(pairs, "pair").unionByName(columns(stand, "term").where(F.col("rank") <= told))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (
  SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT i) >= 30
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM docs
), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, coalesce(c.n, 0) + 5 AS part,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + 5 * s.v AS whole,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) + 5 AS lang_part,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) + 5 * s.v AS lang_whole
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * part) // whole AS p, 1 + (1000000000::HUGEINT * lang_part) // lang_whole AS q FROM shares
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
