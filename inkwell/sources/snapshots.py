"""A table of snapshots: immutable data files, a manifest a version, and commits that fail rather than lose another's.

Rows are dealt to BUCKETS by their key.  A manifest names the data folder of each bucket, so a commit writes new folders for the
buckets that change and leaves the others as they are.  Version n is there once ``versions/n.json`` is; it is created only if
nobody else has created it, so of two writers that started from one version the second gets a ``Conflict``.  A reader of a
version keeps reading its files whatever is committed; ``vacuum`` deletes those that no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import history

BUCKETS = 32


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


class Snapshots:
    """Rows of ``schema`` below ``path``, one for each ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, system = self._at(f"{self.path}/versions")
        names = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """Version, what made it, and the folders of its buckets (a row a bucket); version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "made_by": "none", "buckets": {}}
        where, system = self._at(f"{self.path}/versions/{version}.json")
        stream = system.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        held = self.manifest(version)["buckets"]
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in held.items() if buckets is None or int(b) in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")

    def buckets_of(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # BUCKETS at most

    def commit(self, base: int, rows: DataFrame, buckets: set[int], made_by: str) -> int:
        """The version in which ``buckets`` hold ``rows`` and all else is as in version ``base``."""
        held = dict(self.manifest(base)["buckets"])
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*self.columns).withColumn("bucket", self._bucket()).repartition(len(buckets) or 1, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        filled = self.buckets_of(self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}"))
        held |= {str(b): folder for b in filled}
        held = {b: f for b, f in held.items() if int(b) not in buckets or int(b) in filled}
        where, system = self._at(f"{self.path}/versions/{base + 1}.json")
        try:
            out = system.create(where, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                lost, system = self._at(f"{self.path}/{folder}")
                system.delete(lost, True)
                raise Conflict(f"version {base + 1} is there already") from None
            raise
        out.write(json.dumps({"version": base + 1, "made_by": made_by, "buckets": held}).encode())
        out.close()
        return base + 1

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last ``keep`` and the buckets that only they name; the number of buckets deleted."""
        every = self.versions()
        old, kept = every[: max(0, len(every) - keep)], every[max(0, len(every) - keep) :]
        places = lambda versions: {f"{self.path}/{f}/bucket={b}" for v in versions for b, f in self.manifest(v)["buckets"].items()}
        gone = places(old) - places(kept)
        for path in [*(f"{self.path}/versions/{v}.json" for v in old), *gone]:
            where, system = self._at(path)
            system.delete(where, True)
        return len(gone)


class History(Snapshots):
    """The bounded, expiring table of results as commits."""

    def __init__(self, spark: SparkSession, path: str, schema: str = history.SCHEMA):
        super().__init__(spark, path, schema, "artifact_id")

    def upsert(self, new: DataFrame, order: list[str] | None = None, base: int | None = None) -> int:
        """Only buckets of new rows are read and written.  Rows with ``violations`` are refused, where all columns are there."""
        base = self.manifest()["version"] if base is None else base
        touched = self.buckets_of(new)
        if set(history.columns()) <= set(self.columns):
            history.refuse(new)
        return self.commit(base, history.upsert(self.read(base, touched), new.select(*self.columns), order), touched, "upsert")

    def _without(self, base: int, gone: DataFrame, made_by: str) -> int:
        touched = self.buckets_of(gone)
        if not touched:
            return base
        kept = self.read(base, touched).join(gone.select(self.key), self.key, "left_anti")
        return self.commit(base, kept, touched, made_by)

    def purge(self, now: int, base: int | None = None) -> int:
        base = self.manifest()["version"] if base is None else base
        rows = self.read(base)
        return self._without(base, rows.join(history.purge(rows, now).select(self.key), self.key, "left_anti"), "purge")

    def prune(self, max_bytes: int, protected: str | None = None, base: int | None = None) -> int:
        base = self.manifest()["version"] if base is None else base
        rows = self.read(base)
        return self._without(base, rows.join(history.prune(rows, max_bytes, protected).select(self.key), self.key, "left_anti"), "prune")
