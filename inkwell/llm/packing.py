"""Best-fit packing of token pieces into training sequences, over the whole corpus at once.

Best-fit decreasing sees only lengths, and there are at most ``capacity`` of them.  So the corpus is reduced to a count
for each length (at most ``capacity`` rows, however many documents), the packing is worked out on counts, and every
piece then finds its sequence by its rank among the pieces of its length.  Bins that are alike are kept as ranges of
sequence numbers: the plan is a table of steps "pieces r..r+k of length L go to sequences s..s+k at offset o".  The result
is that of best-fit decreasing over all pieces, one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import slices, small_batches, table, written
from .tokens import encoder, with_end

CAPACITY = 2048
END_ID = 0


class OpenBins:
    """A segment tree over remaining capacities: the tightest capacity of at least ``need`` that has open bins, in
    logarithmic time.  Each leaf holds the ranges (first sequence, number) of open bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, number: int) -> None:
        if room and number:
            self.ranges[room].append((first, number))
            self._change(room, number)

    def take(self, room: int, most: int) -> tuple[int, int]:
        first, number = self.ranges[room].pop()
        if number > most:
            self.ranges[room].append((first + most, number - most))
            number = most
        self._change(room, -number)
        return first, number

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on counts of lengths: steps (length, first rank, number, first sequence, offset)."""
    bins, steps, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            # The tightest open bins that fit (or new ones) take as many pieces of this length as they hold, bin by bin:
            # a bin that has just taken one is tighter than those it was like before.
            room = bins.tightest(length)
            each = (capacity if room is None else room) // length
            wanted = max(1, left // each)
            first, number = (opened, wanted) if room is None else bins.take(room, wanted)
            opened += number if room is None else 0
            filled = min(each, left)
            for i in range(filled):
                steps.append((length, rank, number, first, capacity - (room or capacity) + i * length))
                rank += number
            left -= filled * number
            bins.add((room or capacity) - filled * length, first, number)
    return steps


def pack_lengths(pieces: DataFrame, capacity: int, length: str = "length", block: str = "block", rank: str = "block_rank") -> DataFrame:
    """Give each row of ``pieces`` a ``sequence_id`` and an ``offset``.

    ``block`` and ``rank`` number the rows of one length within a block of rows (from 0, without gaps).  Lengths must
    lie between 1 and ``capacity``.  ``pieces`` is read twice, so it must be a stored table.
    """
    spark = pieces.sparkSession
    per_block = pieces.groupBy(block, length).agg(F.count(F.lit(1)).alias("in_block"))
    per_block = written(per_block, "lengths")
    counts = {r[0]: r[1] for r in per_block.groupBy(length).agg(F.sum("in_block")).collect()}  # at most ``capacity`` rows
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    steps = sorted(plan(counts, capacity))
    at = {}
    for i, (size, *_) in enumerate(steps):
        at.setdefault(size, i)
    firsts = np.array([s[1] for s in steps], np.int64)
    targets, offsets = np.array([s[3] for s in steps], np.int64), np.array([s[4] for s in steps], np.int64)
    bounds = np.zeros(capacity + 2, np.int64)
    np.add.at(bounds, np.array([s[0] + 1 for s in steps], np.int64), 1)
    bounds = np.cumsum(bounds)
    shared = spark.sparkContext.broadcast((firsts, targets, offsets, bounds))  # at most capacity**2 steps, far fewer as a rule

    # Rank over the whole table = rows of that length in earlier blocks + rank in the block.
    earlier = Window.partitionBy(length).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select(block, length, F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("base_rank"))
    ranked = pieces.join(bases, [block, length]).withColumn("whole_rank", F.col("base_rank") + F.col(rank))
    schema = StructType([*ranked.schema]).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, targets, offsets, bounds = shared.value
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = batch.column("whole_rank").to_numpy(zero_copy_only=False)
            step = np.zeros(len(size), np.int64)
            for each in np.unique(size):
                of = size == each
                low, high = bounds[each], bounds[each + 1]
                step[of] = low + np.searchsorted(firsts[low:high], whole[of], side="right") - 1
            columns = [*batch.columns, pa.array(targets[step] + whole - firsts[step]), pa.array(offsets[step])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema).drop("base_rank", "whole_rank", block, rank)


def cut_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut documents of these many ids: (document, start, length) of each piece; only the first may be short."""
    number = np.maximum(1, -(-sizes // capacity))
    row = np.repeat(np.arange(len(sizes)), number)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    first = sizes - (number - 1) * capacity
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
    length = np.where(piece == 0, first[row], capacity)
    return row, start, length


def tokenized_pieces(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, leading_space: bool = True, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, append ``end_id`` and cut into pieces of at most ``capacity`` ids.

    One row a piece: key, piece, start, length, ids_crc32, (ids as little-endian uint32 with ``with_ids``), and the block
    and rank that ``pack_lengths`` asks for.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", block long, block_rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, leading_space).encode
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, text):
            ids, offsets = with_end(*encode(batch.column(text)), end_id)
            row, start, length = cut_pieces(np.diff(offsets), capacity)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            piece = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
            data, begin = memoryview(ids).cast("B"), offsets[row] + start
            spans = list(zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True))
            order = np.argsort(length, kind="stable")
            by = length[order]
            group = np.flatnonzero(np.diff(by, prepend=-1))
            rank = np.empty(len(by), np.int64)
            rank[order] = np.arange(len(by)) - np.repeat(group, np.diff(group, append=len(by))) + seen[by]
            np.add.at(seen, length, 1)
            columns = [batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(data[a:b]) for a, b in spans], pa.int64())]
            columns += [pa.array([bytes(data[a:b]) for a, b in spans], pa.binary())] if with_ids else []
            columns += [pa.array(np.full(len(row), block)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(key, text).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, leading_space: bool = True, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens by best-fit decreasing.

    Null texts count as empty: such a document is one piece that holds only the end id.  A null or repeated key is kept:
    every row is packed on its own.  A text of any length is packed whole.  An empty table gives no rows.  Other columns are not looked at.  Equal lengths are
    placed in any order; which of them goes where has no meaning.
    """
    with small_batches(docs.sparkSession):
        pieces = written(tokenized_pieces(docs, path, key=key, text=text, capacity=capacity, end_id=end_id, leading_space=leading_space, with_ids=with_ids), "pieces")
    return pack_lengths(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from ``pack_documents(with_ids=True)``: sequence_id, ids (binary), length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most ``capacity`` pieces
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
