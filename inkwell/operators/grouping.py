"""Python over many small groups without a call for each: rows are dealt by key and sorted, and groups are cut from the
stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Bytes of rows that Python holds as objects at a time.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A record batch in runs of whole rows of about a megabyte."""
    rows = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str | StructType, columns: list[str]) -> DataFrame:
    """``fn(key, rows)`` for each group; rows are tuples of ``columns`` in ``order``; it gives tuples of ``schema``.  A null
    number with places is NaN, both ways.

    Only one group at a time is held besides about a megabyte of the batch that is read.
    """
    names = [*keys, *columns]
    width = len(keys)
    made = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def values(column: pa.Array) -> list:
        return (column.fill_null(float("nan")) if pa.types.is_floating(column.type) else column).to_pylist()

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for piece in pieces(batch.select(names)):
                out: list[tuple] = []
                for row in zip(*map(values, piece.columns), strict=True):
                    if row[:width] != key:
                        if held:
                            out += fn(key, held)
                        key, held = row[:width], []
                    held.append(row[width:])
                if out:
                    yield table(out)
        if held and (out := list(fn(key, held))):
            yield table(out)

    dealt = df.select(*names, *[o for o in order if o not in names]).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over as many tasks as a session has for a shuffle, or four for each core.

    For what takes much more time than its bytes tell: the number is given, so small parts are not put together again.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
