"""Continuous ingest of parsed lines into a stored table of document statuses (an extension: nothing here is needed for
batch use)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.functions import text as X
from inkwell.operators.history import upsert
from inkwell.sources.store import stored


def anomaly_counts(lines: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Lines and anomalies in each window of time, lines later than ``late`` left out."""
    flagged = lines.withWatermark(time, late).withColumn("odd", X.has_anomaly(F.col("text")))
    return flagged.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("lines"), F.count_if("odd").alias("anomalies")).select("w.start", "w.end", "lines", "anomalies")


def keep_latest(spark: SparkSession, results: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Upsert a stream of results (artifact_id, created_at and more) into a Parquet table at ``path``, dealt to ``buckets``
    folders by a hash of artifact_id.

    Each batch rewrites only the buckets that it has rows for; a batch that is run again leaves the table as it is.
    """

    def store(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("bucket", F.pmod(F.xxhash64("artifact_id"), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        if not touched:
            return
        try:
            before = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        except AnalysisException:  # nothing is stored yet
            before = new.limit(0)
        # Stored apart first, since Spark can't overwrite what it reads.
        merged = stored(upsert(before, new), "ingest")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return results.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
