"""A bounded, expiring table of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400
CONTENT = ["artifact_id", "source_name", "source_hash", "status", "processing_options", "markdown", "output_json", "error"]
SCHEMA = "artifact_id string, source_name string, source_hash string, status string, processing_options string, markdown string, output_json string, error string, created_at bigint, expires_at bigint, retained_bytes bigint"


STATUSES = ("complete", "partial", "failed")
#: Version of the stored schema; no other can be read.
VERSION = 1


def violations(rows: DataFrame) -> DataFrame:
    """artifact_id, problem of rows that must not be stored: a missing value, an unknown status, a size below 0, or a
    second row of an artifact."""
    needed = [c for c in (x.split()[0] for x in SCHEMA.split(", ")) if c not in ("artifact_id", "error")]
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ["artifact_id", *needed]])
    problem = F.when(missing.isNotNull(), missing).when(~F.col("status").isin(*STATUSES), "unknown status").when(F.col("retained_bytes") < 0, "retained_bytes is below 0")
    own = rows.select("artifact_id", problem.alias("problem")).where("problem IS NOT NULL")
    twice = rows.groupBy("artifact_id").count().where("count > 1").select("artifact_id", F.lit("more than one row").alias("problem"))
    return own.unionByName(twice)


def open_history(spark: SparkSession, path: str) -> DataFrame:
    """The rows stored below ``path`` (none yet: an empty table); an error if they have another version of the schema."""
    try:
        version = spark.read.schema("version int").json(f"{path}/version").first()
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], SCHEMA)
    if version is None or version["version"] != VERSION:
        raise ValueError("the stored history has a version that is not supported")
    return spark.read.schema(SCHEMA).parquet(f"{path}/rows")


def columns() -> list[str]:
    return [x.split()[0] for x in SCHEMA.split(", ")]


def refuse(rows: DataFrame) -> None:
    """An error that names the first things that ``violations`` finds, if it finds any."""
    bad = violations(rows).sort("artifact_id", "problem").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.artifact_id}: {r.problem}" for r in bad))


def save_history(rows: DataFrame, path: str) -> None:
    """Store ``rows`` in a new folder; an error names what ``violations`` finds."""
    refuse(rows)
    rows.select(*columns()).write.parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(VERSION,)], "version int").write.json(f"{path}/version")


@dataclass(frozen=True)
class Limits:
    retention_days: int = 30
    max_bytes: int = 1 << 30
    listed: int = 100

    def __post_init__(self):
        if self.retention_days < 1 or self.max_bytes < 1 or self.listed < 1:
            raise ValueError("limits must be 1 at least")


def retained_bytes(columns: list[str] | None = None) -> Column:
    """UTF-8 bytes of what is stored of a result; null counts as nothing."""
    total = F.lit(0).cast("long")
    for c in columns or CONTENT:
        total = total + F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    return total


def prepare(results: DataFrame, now: int, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows too large to be stored at all)."""
    rows = results.withColumn("created_at", F.lit(now).cast("long")).withColumn("expires_at", F.lit(now + limits.retention_days * DAY).cast("long")).withColumn("retained_bytes", retained_bytes())
    fits = F.col("retained_bytes") <= limits.max_bytes
    return rows.where(fits), rows.where(~fits)


def upsert(stored: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Stored and new rows, one for each artifact_id: new before stored, later before earlier."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy("artifact_id").orderBy(F.desc("_new"), *[F.desc(c) for c in order or ["created_at"]])
    return both.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth", "_new")


def purge(rows: DataFrame, now: int) -> DataFrame:
    """Rows whose time has not come; one that expires now has."""
    return rows.where(F.col("expires_at") > F.lit(now))


def prune(rows: DataFrame, max_bytes: int, protected: str | None = None) -> DataFrame:
    """Keep the newest rows whose sizes add up to ``max_bytes`` at most, the protected one first.

    The same rows stay as when the oldest are removed one by one.  The running total goes in two steps, within each day and
    over days, so no task holds all rows.
    """
    first = F.when(F.col("artifact_id") == protected, 1).otherwise(0) if protected else F.lit(0)
    dated = rows.withColumn("_first", first).withColumn("_day", F.when(F.col("_first") == 1, F.lit(None)).otherwise(F.floor(F.col("created_at") / DAY)))
    newest = [F.desc("_first"), F.desc("created_at"), F.desc("artifact_id")]
    days = dated.groupBy("_first", "_day").agg(F.sum("retained_bytes").alias("_bytes"))
    # A row a day: few enough for one task.
    ahead = Window.orderBy(F.desc("_first"), F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(F.col("_first").alias("_f"), F.col("_day").alias("_d"), F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_first", "_day").orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0)
    total = dated.withColumn("_own", F.sum("retained_bytes").over(inner)).join(before, (F.col("_first") == F.col("_f")) & F.col("_day").eqNullSafe(F.col("_d")))
    return total.where(F.col("_before") + F.col("_own") <= max_bytes).select(rows.columns)


def total_bytes(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("retained_bytes"), F.lit(0)).alias("retained_bytes"))


def recent(rows: DataFrame, limit: int = 100) -> DataFrame:
    """The newest entries; contents are not read."""
    if limit < 1:
        raise ValueError("limit must be 1 at least")
    return rows.select("artifact_id", "source_name", "status", "created_at", "expires_at", "retained_bytes").orderBy(F.desc("created_at"), F.desc("artifact_id")).limit(limit)


#: The options of a run, and what holds for those that a stored row lacks; fixed values.
OPTIONS = "instructions string, schema variant, language string, target_pages string, keep_headers_footers boolean, image_mode string, extract_data boolean, generate_annotated_pdf boolean, accuracy_policy string, experimental_peer_evidence boolean"
DEFAULTS = {"instructions": "", "language": "auto", "keep_headers_footers": False, "image_mode": "placeholder", "extract_data": False, "generate_annotated_pdf": False, "accuracy_policy": "accuracy", "experimental_peer_evidence": False}
POLICIES = ("legacy", "accuracy")


def typed_options(text: Column) -> Column:
    """The stored options (JSON) by their kinds, with defaults; null if they are no JSON object, hold an option that isn't
    known or of another kind, or an unknown policy."""
    whole = F.try_parse_json(text)
    held = F.try_variant_get(whole, "$", "map<string,variant>")
    kinds = dict(x.split() for x in OPTIONS.split(", "))
    get = lambda name: F.try_variant_get(whole, f"$.{name}", kinds[name])
    value = {name: F.coalesce(get(name), F.lit(DEFAULTS[name])) if name in DEFAULTS else get(name) for name in kinds}
    # As a string anything can be had, so the kind is looked at; JSON's null stands for a missing value.
    shown = lambda name: F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_element_at(held, F.lit(name))), "^[A-Z]+", 0), F.lit("VOID"))
    fine = F.size(F.array_except(F.map_keys(held), F.array(*map(F.lit, kinds)))) == 0
    for name, kind in kinds.items():
        if kind != "variant":
            fine &= shown(name).isin("VOID", kind.upper())
    return F.when(fine & value["accuracy_policy"].isin(*POLICIES), F.struct(*[v.alias(n) for n, v in value.items()]))


def restore(rows: DataFrame, artifact_id: str) -> DataFrame:
    """One stored result with its output parsed and its options typed; ``corrupt`` tells that one of them can't be read."""
    one = rows.where(F.col("artifact_id") == F.lit(artifact_id))
    read = one.withColumns({"output": F.try_parse_json("output_json"), "options": typed_options(F.col("processing_options"))})
    return read.withColumn("corrupt", F.col("output").isNull() | F.col("options").isNull())


def delete(rows: DataFrame, artifact_id: str) -> tuple[DataFrame, bool]:
    """(the other rows, whether there was such a row)."""
    found = rows.where(F.col("artifact_id") == F.lit(artifact_id)).limit(1).count() > 0
    return rows.where(F.col("artifact_id") != F.lit(artifact_id)), found
