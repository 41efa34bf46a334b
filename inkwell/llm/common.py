"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine (tests) may go without that setting, and gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def free(columns: list[str], *names: str) -> list[str]:
    """Names for added columns: those given, with underscores added as long as a column has that name."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, what: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/inkwell-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for part in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(part.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch between the JVM and Python where rows hold texts or sets; Spark's own 10,000 of these weigh tens of
#: megabytes, several times over in the JVM.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables that are written meanwhile go through Python in batches of at most BATCH_ROWS rows; the session's setting is
    put back in the end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if before is None or not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = (1 << 20) - 64) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of whole rows of about ``most`` bytes of ``text``: memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        offsets = string_offsets(column)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system (where the C library can): Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def string_offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets (length + 1) of a string or binary array within its data buffer."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind) if column.buffers()[1] else np.zeros(1, kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after another, and the rows' offsets in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    offsets = string_offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): near values become unrelated ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``raw[begin:end]``, all at once.

    A polynomial hash read off running sums and shifted back by modular inverses, so equal bytes hash alike wherever
    they stand; the length is mixed in.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        size = len(raw)
        powers = _powers(_ROOT, size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTES[raw] * powers[:size], out=sums[1:])
        back = _powers(_INVERSE, size + 1)[begin]
        return mix((sums[end] - sums[begin]) * back + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT)
_KNOWN: dict[int, np.ndarray] = {}


def _powers(root: np.uint64, n: int) -> np.ndarray:
    known = _KNOWN.get(int(root))
    if known is None or len(known) < n:
        out = np.full(1 << max(16, (n - 1).bit_length()), root, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(out, out=out)
        known = _KNOWN[int(root)] = out
    return known[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes of text that are handed on at a time, and those that words are hashed from at a time: each of these takes some 50
#: bytes meanwhile, and its worker keeps 16 (powers).
PIECE, HASHED = 1 << 20, (1 << 18) - 64


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Whole rows, by the offsets of their texts, in runs of at most ``most`` bytes (or of one row)."""
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of rows of text, A-Z lower-cased: (hash of each, row of each, words per row)."""
    rows = len(offsets) - 1
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in runs(offsets, HASHED):
        part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part):
            begin, end = word_spans(part, own)
            hashes.append(span_hashes(_LOWER[part], begin, end))
            owners.append(np.searchsorted(own, begin, side="right") - 1 + i)
    row = np.concatenate(owners)
    return np.concatenate(hashes), row, np.bincount(row, minlength=rows)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] |= inside[edges]
    begin = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    last[before] |= inside[before]
    return begin, np.flatnonzero(last) + 1


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: str) -> Callable:
    """A mapInArrow function that applies ``fn`` to bounded runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield fn(part)

    return run
