"""A log of what providers answered, so that no request is made twice, in this run or in a later one.

The log is a folder of batches, each a Parquet table of its own that counts once it has been committed whole.  A request's key is
the digest of the provider's name and of the request; requests name their image by its digest, their stage, region, number
of the read and prompts, so pages with the same pixels share what was read, and a new prompt asks anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class AnswerLog:
    """Answers below ``path``; ``name`` tells the provider and its version."""

    SCHEMA = "digest string, response string"

    def __init__(self, path: str, name: str):
        self.path, self.name = path.rstrip("/"), name

    def _batches(self, spark: SparkSession) -> list[str]:
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        found = [f.getPath() for f in system.listStatus(root) if f.isDirectory()]
        return sorted(p.toString() for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def known(self, spark: SparkSession) -> DataFrame:
        """digest and response of all that was answered; a request that two runs asked at once has one answer."""
        batches = self._batches(spark)
        if not batches:
            return spark.createDataFrame([], self.SCHEMA)
        read = spark.read.schema(self.SCHEMA).parquet(*batches).withColumn("batch", F.col("_metadata.file_path"))
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("batch", "response"))
        return read.withColumn("nth", nth).where("nth = 1").select("digest", "response")

    def keyed(self, requests: DataFrame) -> DataFrame:
        return requests.withColumn("digest", F.sha2(F.concat(F.lit(f"{self.name}\0"), "request"), 256))

    def missing(self, requests: DataFrame) -> DataFrame:
        """Keyed requests that have no answer yet, each digest once."""
        return requests.dropDuplicates(["digest"]).join(self.known(requests.sparkSession).select("digest"), "digest", "left_anti")

    def add(self, answers: DataFrame) -> None:
        """Commit answers (digest, response) as a batch; what failed has no response and is not kept."""
        kept = answers.where("response IS NOT NULL").select("digest", "response")
        kept.sortWithinPartitions("digest").write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")

    def compact(self, spark: SparkSession) -> None:
        """All batches as one.  Those it replaces are deleted after it is committed, so answers are never gone in between."""
        old = self._batches(spark)
        if len(old) > 1:
            self.add(self.known(spark))
            for path in old:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
