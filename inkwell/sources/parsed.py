"""Parsed documents as a folder that Spark reads as a data source: pages, text items, blocks and screenshots.

A folder holds a manifest (Parquet, a row a page: size, and where the page's body and screenshot lie) and files of bodies, one
after another.  Reading plans a partition for each row group of the manifest; a task reads the manifest's rows, keeps those
that filters on document and page let through, and opens just their byte ranges.  So pages that nobody asked for are never
read, the driver lists files and row groups only, and page counts come from the manifest alone.

``spark.read.format("parsed").option("table", "items").option("pages", "1-3").load(folder)``, after ``register(spark)``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Tables of a folder, and their columns.
TABLES = {
    "documents": "doc_id string, source_name string, source_hash string, total_pages int",
    "pages": "doc_id string, page int, markdown string, width double, height double",
    "items": "doc_id string, page int, idx int, text string, x double, y double, width double, height double",
    "blocks": "doc_id string, page int, block_no int, kind string, text string, x double, y double, width double, height double",
    "screenshots": "doc_id string, page int, width int, height int, image binary",
}
_MANIFEST = "doc_id string, page int, first boolean, width double, height double, source_name string, source_hash string, total_pages int, file string, body_at long, body_size long, shot_at long, shot_size long, shot_w int, shot_h int"
#: Rows of the manifest in a row group, which is what a task reads at least; bytes that are read at a time.
GROUP_ROWS, READ_BYTES = 20_000, 8 << 20
_FILTERED = ("doc_id", "page")
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri.rstrip("/"))


def pack_pages(sources: DataFrame, pages: DataFrame, items: DataFrame, blocks: DataFrame, shots: DataFrame) -> DataFrame:
    """What ``write_parsed`` takes, of tables as TABLES has them (shots: screenshots).  A page may lack items, blocks or a
    screenshot; a document's pages are numbered from 1, not all of them need be there."""
    own = lambda df, name, *columns: df.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "page").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    box = ("x", "y", "width", "height")
    bodies = pages.withColumn("doc_id", F.col("doc_id").cast("string")).join(own(items, "items", "idx", "text", *box), ["doc_id", "page"], "left").join(own(blocks, "blocks", "block_no", "kind", "text", *box), ["doc_id", "page"], "left")
    whole = bodies.select("doc_id", "page", "width", "height", F.to_json(F.struct("markdown", "items", "blocks")).alias("body"))
    seen = shots.select(F.col("doc_id").cast("string").alias("doc_id"), "page", F.col("width").alias("shot_w"), F.col("height").alias("shot_h"), "image")
    known = sources.select(F.col("doc_id").cast("string").alias("doc_id"), "source_name", "source_hash", "total_pages")
    first = pages.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min("page").alias("first"))
    return whole.join(seen, ["doc_id", "page"], "left").join(known.join(first, "doc_id"), "doc_id").withColumn("first", F.col("page") == F.col("first"))


def write_parsed(packed: DataFrame, folder: str) -> None:
    """Write a folder from the rows of ``pack_pages``.  A task writes a file of its own; only files of tasks that ended are
    in the manifest, so one that is run again leaves nothing that is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _files(folder)
        system.create_dir(f"{root}/bodies", recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.bin", 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(f"{root}/bodies/{name}")
            places = []
            for body, image in zip(batch.column("body"), batch.column("image"), strict=True):
                for part in (body.as_buffer(), image.as_buffer()):
                    size = part.size if part is not None else 0
                    places.append((at, size) if part is not None else (None, None))
                    if size:
                        out.write(part)
                    at += size
            columns = {c: batch.column(c) for c in ("doc_id", "page", "first", "width", "height", "source_name", "source_hash", "total_pages")}
            columns |= {"file": pa.array([name] * batch.num_rows)}
            for i, c in enumerate(("body_at", "body_size")):
                columns[c] = pa.array([p[i] for p in places[::2]], pa.int64())
            for i, c in enumerate(("shot_at", "shot_size")):
                columns[c] = pa.array([p[i] for p in places[1::2]], pa.int64())
            columns |= {c: batch.column(c) for c in ("shot_w", "shot_h")}
            yield pa.RecordBatch.from_pydict(columns)
        if out:
            out.close()

    fit = {"doc_id": "string", "page": "int", "first": "boolean", "width": "double", "height": "double", "source_name": "string", "source_hash": "string", "total_pages": "int", "shot_w": "int", "shot_h": "int", "body": "string", "image": "binary"}
    rows = packed.select(*[F.col(c).cast(k).alias(c) for c, k in fit.items()]).repartitionByRange("doc_id", "page").sortWithinPartitions("doc_id", "page")
    rows.mapInArrow(run, _MANIFEST).write.option("parquet.block.row.count.limit", GROUP_ROWS).parquet(f"{folder.rstrip('/')}/manifest")


class _Bounds:
    """What filters and the option ``pages`` let through, by document and page."""

    def __init__(self, pages: str | None):
        self.tests: list[tuple[str, str, object]] = []
        self.spans = None
        if pages and pages.strip():
            ends = [p.strip().split("-") for p in pages.split(",")]
            self.spans = [(int(e[0]), int(e[-1])) for e in ends]

    def add(self, one: Filter) -> bool:
        """Whether the filter is taken over in full."""
        column = getattr(one, "attribute", ("",))
        if len(column) != 1 or column[0] not in _FILTERED or not isinstance(one, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
            return False
        self.tests.append((column[0], type(one).__name__, None if isinstance(one, IsNotNull) else frozenset(one.value) if isinstance(one, In) else one.value))
        return True

    def lets(self, doc_id: str | None, page: int | None) -> bool:
        if self.spans is not None and not any(a <= page <= b for a, b in self.spans):
            return False
        return all(_holds(op, doc_id if column == "doc_id" else page, x) for column, op, x in self.tests)

    def may(self, column: str, low: object, high: object) -> bool:
        """Whether a value between two bounds may pass."""
        if column == "page" and self.spans is not None and not any(a <= high and b >= low for a, b in self.spans):
            return False
        for name, op, x in self.tests:
            if name == column:
                fits = {"EqualTo": lambda x: low <= x <= high, "In": lambda x: any(low <= v <= high for v in x), "GreaterThan": lambda x: high > x, "GreaterThanOrEqual": lambda x: high >= x, "LessThan": lambda x: low < x, "LessThanOrEqual": lambda x: low <= x, "IsNotNull": lambda x: True}
                if not fits[op](x):
                    return False
        return True


def _holds(op: str, value: object, x: object) -> bool:
    if value is None:
        return False
    return {"EqualTo": lambda: value == x, "In": lambda: value in x, "GreaterThan": lambda: value > x, "GreaterThanOrEqual": lambda: value >= x, "LessThan": lambda: value < x, "LessThanOrEqual": lambda: value <= x, "IsNotNull": lambda: True}[op]()


class ParsedReader(DataSourceReader):
    def __init__(self, folder: str, table: str, pages: str | None):
        self.folder, self.table, self.bounds = folder, table, _Bounds(None if table == "documents" else pages)

    def partitions(self) -> list[InputPartition]:
        system, root = _files(self.folder)
        out = []
        for info in sorted(system.get_file_info(pafs.FileSelector(f"{root}/manifest")), key=lambda i: i.path):
            if not info.path.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    if self._may_hold(meta.row_group(g)):
                        out.append(InputPartition((info.path, g)))
        return out or [InputPartition(None)]

    def _may_hold(self, group: pq.RowGroupMetaData) -> bool:
        for c in range(group.num_columns):
            column = group.column(c)
            known = column.statistics if column.is_stats_set else None
            if column.path_in_schema in _FILTERED and known is not None and known.has_min_max and not self.bounds.may(column.path_in_schema, known.min, known.max):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, group = partition.value
        system, root = _files(self.folder)
        with system.open_input_file(path) as f:
            rows = pq.ParquetFile(f).read_row_group(group)
        keep = [self.bounds.lets(d, p) and (self.table != "documents" or first) for d, p, first in zip(*(rows[c].to_pylist() for c in ("doc_id", "page", "first")), strict=True)]
        rows = rows.filter(pa.array(keep, pa.bool_()))
        names = [c.split()[0] for c in TABLES[self.table].split(", ")]
        schema = pa.schema([(n, _KINDS[c.split()[1]]) for n, c in zip(names, TABLES[self.table].split(", "), strict=True)])
        if self.table == "documents":
            yield from rows.select(names).cast(schema).to_batches()
            return
        part = "shot" if self.table == "screenshots" else "body"
        for batch, contents in self._contents(system, root, rows.to_pylist(), part):
            made = [r for row, content in zip(batch, contents, strict=True) for r in self._rows(row, content)]
            if made:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in made], schema=schema)

    def _contents(self, system: pafs.FileSystem, root: str, rows: list[dict], part: str) -> Iterator[tuple[list[dict], list[bytes]]]:
        """Runs of rows that lie side by side in a file, with their bytes."""
        rows, i = [r for r in rows if r[f"{part}_at"] is not None], 0
        while i < len(rows):
            first, j = rows[i], i + 1
            end = first[f"{part}_at"] + first[f"{part}_size"]
            while j < len(rows) and rows[j]["file"] == first["file"] and rows[j][f"{part}_at"] == end and end - first[f"{part}_at"] < READ_BYTES:
                end += rows[j][f"{part}_size"]
                j += 1
            with system.open_input_file(f"{root}/bodies/{first['file']}") as f:
                whole = f.read_at(end - first[f"{part}_at"], first[f"{part}_at"])
            begin = [r[f"{part}_at"] - first[f"{part}_at"] for r in rows[i:j]]
            yield rows[i:j], [whole[a : a + r[f"{part}_size"]] for a, r in zip(begin, rows[i:j], strict=True)]
            i = j

    def _rows(self, row: dict, content: bytes) -> list[tuple]:
        key = row["doc_id"], row["page"]
        if self.table == "screenshots":
            return [(*key, row["shot_w"], row["shot_h"], content)]
        body = json.loads(content)
        if self.table == "pages":
            return [(*key, body.get("markdown"), row["width"], row["height"])]
        columns = [c.split()[0] for c in TABLES[self.table].split(", ")][2:]
        return [(*key, *(x.get(c) for c in columns)) for x in body.get(self.table) or []]


class FilteringReader(ParsedReader):
    """A reader that takes over filters on document and page; sessions must have turned that on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if not self.bounds.add(one):
                yield one


class ParsedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parsed"

    def schema(self) -> str:
        table = self.options.get("table", "pages")
        if table not in TABLES:
            raise ValueError(f"unknown table: {table}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringReader if self.options.get("filters", "false") == "true" else ParsedReader
        return kind(self.options["path"], self.options.get("table", "pages"), self.options.get("pages"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ParsedSource)


def read_parsed(spark: SparkSession, folder: str, table: str = "pages", pages: str | None = None) -> DataFrame:
    """A table of a folder, with a selection of pages (like ``1-3,5``) if one is given.

    Filters on doc_id and page go to the reader where the session has ``spark.sql.python.filterPushdown.enabled``."""
    register(spark)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    reader = spark.read.format("parsed").option("table", table).option("filters", str(pushed).lower())
    return (reader.option("pages", pages) if pages else reader).load(folder)
