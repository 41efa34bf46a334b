"""Counts of n-grams over a whole corpus, told to each block of texts for the n-grams that it holds itself.

Texts are handled in blocks.  A block sends each distinct n-gram it holds once, with its count there, packed for each shard
of n-grams (a range of their hashes); nothing is sent to a shard of which a block holds no n-gram.  A shard adds up and
answers each block in the order of its request.  So every block gets whole-corpus counts of its own n-grams, nothing is
broadcast, no count is cut, and an n-gram that stands in every text is one entry for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, written

#: Text bytes of a block, and entries that a shard should hold.
BLOCK_BYTES, SHARD_ROWS = 4 << 20, 1_500_000
#: Stored bytes of an n-gram's hash besides its shard.  Two n-grams of a shard are taken for one with a chance of about
#: SHARD_ROWS / 2**40 for each; ``WHOLE`` stores all eight bytes.
SHORT, WHOLE = 5, 8
ANSWERS = "block long, shard int, kind int, totals binary, known long, tokens long, ones long, spread array<double>"
#: Weights of a prior for which ``spread`` is worked out.
WEIGHTS = np.logspace(-2, 7, 73)


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.Table]]:
    """Numbered blocks of whole rows of an input partition; a task that is run again numbers them alike."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in slices(batches, text, BLOCK_BYTES // 4):
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= BLOCK_BYTES:
            yield number, pa.Table.from_batches(held)
            number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def shards_for(entries: float) -> int:
    return max(1, int(entries) // SHARD_ROWS)


def edges_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards begin in sorted 64-bit keys (a shard is a range of them), and the end."""
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _squeeze(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), "<u4")


def shared_sums(packed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each n-gram (a row of bytes) the sum of the counts of all rows that are like it; and the sums above 0 that
    n-grams have, in order, with the number of n-grams of each.

    An eighth of the n-grams is sorted at a time, by bits of their hash: sorting takes ten times the stored bytes.
    """
    sums, totals = np.zeros(len(packed), np.float64), [np.zeros(0)]
    eighth = packed[:, 1] >> 5
    for i in range(8):
        of = np.flatnonzero(eighth == i)
        keys = np.zeros((len(of), 8), np.uint8)
        keys[:, : packed.shape[1]] = packed[of]
        keys, at = np.unique(keys.view("<u8").ravel(), return_inverse=True)
        total = np.bincount(at, weights=counts[of], minlength=len(keys))
        sums[of] = total[at]
        totals.append(total[total > 0])
    return sums, *np.unique(np.concatenate(totals), return_counts=True)


def block_counts(docs: DataFrame, text: str, distinct: Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray]]], widths: list[int], shards: int, name: str, prepare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> DataFrame:
    """The answers to all blocks of ``docs``, a stored table: block, shard, kind, totals; and in one row of each shard the
    number of n-grams with a count above 0 (``known``) and of 1 (``ones``), the sum of counts (``tokens``), and that of
    c w / (c - 1 + w) over counts c for each w of WEIGHTS (``spread``).

    ``distinct`` gives, for each kind of n-gram, a block's sorted distinct keys and their counts in the block.
    ``prepare`` sees the batches of each partition first, and may add columns to them.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in blocks(prepare(batches), text):
            out = {"block": [], "shard": [], "kind": [], "keys": [], "counts": []}
            for kind, (keys, counts) in enumerate(distinct(part)):
                edges = edges_of(keys, shards)
                packed = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : widths[kind]])
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = edges[s], edges[s + 1]
                    for column, value in zip(out.values(), (number, s, kind, packed[a:b].tobytes(), _squeeze(counts[a:b])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), pa.array(out["shard"], pa.int32()), pa.array(out["kind"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))

    def add_up(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        width = widths[part["kind"][0].as_py()]
        sizes = np.array([len(x.as_buffer()) // width for x in part["keys"]], np.int64)
        packed = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width) for x in part["keys"]])
        counts = np.concatenate([_unsqueeze(x.as_buffer(), n) for x, n in zip(part["counts"], sizes.tolist(), strict=True)])
        sums, sizes_, times = shared_sums(packed, counts)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        answers = [_squeeze(sums[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        known, tokens = np.zeros(len(answers), np.int64), np.zeros(len(answers), np.int64)
        known[0], tokens[0] = int(times.sum()), int((sizes_ * times).sum())
        ones, spread = np.zeros(len(answers), np.int64), [[] for _ in answers]
        ones[0], spread[0] = int(times[sizes_ == 1].sum()), [float((times * sizes_ * w / (sizes_ - 1 + w)).sum()) for w in WEIGHTS]
        out = pa.table({"block": part["block"], "shard": part["shard"], "kind": part["kind"], "totals": pa.array(answers, pa.binary()), "known": known, "tokens": tokens, "ones": ones, "spread": pa.array(spread, pa.list_(pa.float64()))})
        del packed, counts, sums
        give_back()
        return out

    asked = docs.mapInArrow(ask, "block long, shard int, kind int, keys binary, counts binary")
    return written(asked.groupBy("shard", "kind").applyInArrow(add_up, ANSWERS), name)


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the number of each row's block and its place among the rows of its input partition's block."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in blocks(batches, text):
            row = 0
            for batch in part.to_batches():
                place = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int32))
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, number)), place, *batch.columns], names=["block", "row", *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(run, "block long, row int, " + ", ".join(f"{n} {kinds[n]}" for n in names))


def told(answers: pa.Table, kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """Whole-corpus counts of a block's sorted distinct ``keys``, from the answers to that block."""
    out, edges, got = np.zeros(len(keys), np.int64), edges_of(keys, shards), 0
    for s, k, data in zip(answers["shard"].to_pylist(), answers["kind"].to_pylist(), answers["totals"], strict=True):
        if k == kind:
            a, b = int(edges[s]), int(edges[s + 1])
            out[a:b] = _unsqueeze(data.as_buffer(), b - a)
            got += b - a
    if got != len(keys):
        raise RuntimeError("the input changed while it was read")
    return out


def total_of(answers: DataFrame, kind: int) -> tuple[int, int]:
    """(distinct n-grams with a count above 0, sum of counts) of a kind."""
    return tuple(x or 0 for x in answers.where(F.col("kind") == kind).agg(F.sum("known"), F.sum("tokens")).first())


def prior_weight(answers: DataFrame, kind: int) -> float:
    """The weight of the prior in the histories of ``kind``, such that it takes as much of the probability of training n-grams
    as there are n-grams that nothing else in the training texts foretells: those that occur once.

    With one occurrence left out, a history of count c gives its prior w / (c - 1 + w); summed over all occurrences this must
    be the number of n-grams of the next kind with the count 1.
    """
    ones = answers.where(F.col("kind") == kind + 1).agg(F.sum("ones")).first()[0] or 0
    sums = answers.where(F.col("kind") == kind).select(F.posexplode("spread").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row a weight
    if not sums:
        return 1.0
    spread = np.array([r["x"] for r in sorted(sums, key=lambda r: r["i"])])
    return float(np.exp(np.interp(ones, spread, np.log(WEIGHTS))))
