"""Binary token files with constant-time keyed access.

A shard is two files in a shared folder:

* ``<name>.ids``: raw little-endian ids of its documents, one after another in ascending key order: two bytes each if the
  vocabulary has at most 65,536 ids, else four;
* ``<name>.idx``: the width of an id; a minimal perfect hash over the shard's distinct keys; each slot holds a 64-bit fingerprint of the key,
  the number of its first row and how many rows have that key; then the rows' offsets in the ids file.

Shards are written under a name of their own for each attempt, and only the names that came back from finished tasks are
in the manifest, so a task that is run again leaves no trace in the results.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, scratch, slices, table, written
from .tokens import encoder, with_end

END_ID = 2
#: Bytes of text and rows of a shard: its keys and sizes are held in memory.
SHARD_BYTES, SHARD_ROWS = 256 << 20, 4_000_000
MAGIC = b"INKTOK02"
#: Stands for a null key; null keys sort first.
NULL_KEY = -(1 << 63)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: levels of bit arrays in which only keys without collision
    stay, the rest goes on to the next level; a key's slot is the number of set bits before its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.starts = np.cumsum([0, *[len(x) for x in levels]])
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.before = np.cumsum(bits) - bits
        self.size = int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 2.0) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            n = max(8, int(load * len(rest)))
            at = cls._hash(rest, len(levels), n)
            bits = np.bincount(at, minlength=n) == 1
            levels.append(bits)
            rest = rest[~bits[at]]
        return cls(levels)

    @staticmethod
    def _hash(keys: np.ndarray, level: int, n: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; keys that were not built in get any slot or -1, which the fingerprint then rejects."""
        out = np.full(len(keys), -1, np.int64)
        for i, bits in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            at = self._hash(keys[open_], i, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[self.starts[i] + at[hit]]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xA24BAED4963EE407))


def index_bytes(keys: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """The index of a shard: ``keys`` (sorted int64, a row each, may repeat) and the rows' offsets (one more)."""
    distinct, first, number = np.unique(keys, return_index=True, return_counts=True)
    distinct = distinct.view(np.uint64)
    hashed = PerfectHash.build(distinct)
    slot = hashed.slots(distinct)
    stored = np.zeros((len(distinct), 3), np.uint64)
    stored[slot] = np.stack([fingerprints(distinct), first.astype(np.uint64), number.astype(np.uint64)], axis=1)
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<IIII", width, len(hashed.levels), len(distinct), len(keys)))
    for bits in hashed.levels:
        out.write(struct.pack("<I", len(bits)) + np.packbits(bits).tobytes())
    out.write(stored.astype("<u8").tobytes() + offsets.astype("<u8").tobytes())
    return out.getvalue()


class Shard:
    """An open shard: keyed access to its raw payload."""

    def __init__(self, files: pafs.FileSystem, path: str):
        data = files.open_input_stream(f"{path}.idx").read()
        if data[:8] != MAGIC:
            raise ValueError(f"not a token index: {path}.idx")
        self.width, number, n, rows = struct.unpack_from("<IIII", data, 8)
        at, levels = 24, []
        for _ in range(number):
            (bits,) = struct.unpack_from("<I", data, at)
            size = -(-bits // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 4), count=bits).astype(bool))
            at += 4 + size
        self.hash = PerfectHash(levels)
        self.stored = np.frombuffer(data, "<u8", 3 * n, at).reshape(n, 3)
        self.offsets = np.frombuffer(data, "<u8", rows + 1, at + 24 * n).astype(np.int64)
        self.payload = files.open_input_file(f"{path}.ids")

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; none for keys that aren't here (the fingerprint differs)."""
        keys = keys.view(np.uint64)
        slot = self.hash.slots(keys)
        found = slot >= 0
        found[found] = self.stored[slot[found], 0] == fingerprints(keys[found])
        first, number = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[found], number[found] = self.stored[slot[found], 1], self.stored[slot[found], 2]
        return first, number

    def ids(self, row: int) -> np.ndarray:
        begin, end = self.offsets[row], self.offsets[row + 1]
        return self.read(int(begin), int(end))

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids by their places in the shard, as uint32."""
        data = self.payload.read_at(self.width * (end - begin), self.width * begin)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> list[np.ndarray]:
        first, number = self.rows(np.array([key], np.int64))
        return [self.ids(int(first[0]) + i) for i in range(int(number[0]))]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark names by URI or path."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_tokens(docs: DataFrame, path: str, *, folder: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, leading_space: bool = False, shards: int | None = None) -> DataFrame:
    """Encode whole texts and write them as shards in ``folder``; gives the manifest, a stored table with a row a shard:
    part (its place), shard (path without suffix), first_key, last_key, n_rows, n_ids, base (ids in all shards before it).

    Rows are dealt by ranges of keys, so shards follow one another in key order; the rows of a key that very many have go to
    as many shards as they need.  Without a number, a shard has about SHARD_BYTES of text, and SHARD_ROWS rows, at most.  Null keys come first, under a key of their own; null texts count as empty (only the end
    id); a text of any length is encoded whole; repeated keys are all kept.  An empty table has no shards.  Other columns
    are not looked at.
    """
    if not shards:
        number, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + (size or 0) // SHARD_BYTES, 1 + number // SHARD_ROWS)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias(key), text).withColumns({"_h": F.xxhash64(text), "_i": F.monotonically_increasing_id()})
    by = [key, "_h", "_i"]
    rows = rows.repartitionByRange(shards, *by).sortWithinPartitions(*by).select(key, text)
    schema = "part int, shard string, first_key long, last_key long, n_rows long, n_ids long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        vocabulary, name = encoder(path, leading_space), f"{root}/{uuid.uuid4().hex}"
        width = 2 if max(vocabulary.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        keys, sizes = [], []
        payload = None
        for batch in slices(batches, text):
            payload = payload or files.open_output_stream(f"{name}.ids")
            ids, offsets = with_end(*vocabulary.encode(batch.column(text)), end_id)
            payload.write(ids.astype(f"<u{width}").tobytes())
            keys.append(batch.column(key).to_numpy(zero_copy_only=False))
            sizes.append(np.diff(offsets))
        if payload is None:
            return
        payload.close()
        keys, offsets = np.concatenate(keys), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        with files.open_output_stream(f"{name}.idx") as out:
            out.write(index_bytes(keys, offsets, width))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "shard": [name], "first_key": [keys[0]], "last_key": [keys[-1]], "n_rows": [len(keys)], "n_ids": [offsets[-1]]}, schema=pa.schema([("part", pa.int32()), ("shard", pa.string()), *[(x, pa.int64()) for x in ("first_key", "last_key", "n_rows", "n_ids")]]))

    made = written(rows.mapInArrow(run, schema), "manifest")
    # A row a shard: small enough to be numbered by one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


def read_tokens(keys: DataFrame, manifest: DataFrame, *, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Look every key up in the shards: key, start, n_tokens, ids_crc32 (and the ids), a row for each stored row.

    Keys that no shard holds give no row; a repeated key is looked up once, a null key finds the rows without key, and an
    empty table or manifest gives no rows.  Other columns are not looked at.  Keys are dealt to the shards that may hold them, by the shards' ranges, so each
    shard's index is read once.
    """
    shards = manifest.select("part", "shard", "first_key", "last_key", "base").sort("part").collect()  # a row a shard
    spark = keys.sparkSession
    known = spark.sparkContext.broadcast([(s["shard"], s["base"]) for s in shards])
    first_key, last_key = (np.array([s[c] for s in shards], np.int64) for c in ("first_key", "last_key"))
    kind = keys.schema[key].dataType.simpleString()
    wanted = keys.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("key").to_numpy(zero_copy_only=False)
            low = np.searchsorted(last_key, asked, side="left")
            number = np.maximum(0, np.searchsorted(first_key, asked, side="right") - low)
            shard = np.repeat(low, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.repeat(asked, number))], names=["shard", "key"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        opened: tuple[int, Shard | None] = (-1, None)
        for batch in batches:
            asked, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "shard"))
            for shard in np.unique(at).tolist():
                if opened[0] != shard:
                    opened = (shard, Shard(files, known.value[shard][0]))
                here, own = opened[1], asked[at == shard]
                first, number = here.rows(own)
                row = np.repeat(first, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                if not len(row):
                    continue
                # Neighbouring rows are read together, a few MB at a time.
                out = []
                begin, i = here.offsets[row], 0
                end = here.offsets[row + 1]
                while i < len(row):
                    j = i + 1
                    while j < len(row) and begin[j] == end[j - 1] and end[j] - begin[i] <= 1 << 20:
                        j += 1
                    block = memoryview(here.read(int(begin[i]), int(end[j - 1]))).cast("B")
                    out += [block[4 * int(a - begin[i]) : 4 * int(b - begin[i])] for a, b in zip(begin[i:j], end[i:j], strict=True)]
                    i = j
                columns = [pa.array(np.repeat(own, number)), pa.array(begin + known.value[shard][1]), pa.array(end - begin), pa.array([zlib.crc32(x) for x in out], pa.int64())]
                columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out], pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    placed = wanted.mapInArrow(place, "shard int, key long").repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "key")
    found = placed.mapInArrow(look, schema)
    return found.withColumn("key", F.when(F.col("key") != NULL_KEY, F.col("key")).cast(kind)).withColumnRenamed("key", key)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "tokens")
    manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder=folder)
    return read_tokens(docs, manifest, folder=folder)
