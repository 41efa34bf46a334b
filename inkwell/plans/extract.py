"""Extraction over chunks: call, check, one retry with the errors, then merging up a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import lines as L
from inkwell.operators.chunking import FAN_IN
from inkwell.operators.evidence import check_envelopes
from inkwell.sources.answers import AnswerLog
from inkwell.sources.store import stored

from .providers import Provider, answered


def _answers(units: DataFrame, provider: Provider, schema: dict | None, log: AnswerLog | None, what: str) -> DataFrame:
    """The units (without request and lines where there are no errors) with result, errors, trusted evidence and the lines
    that it cites.  A unit is asked and checked in one pass and stored, so nothing is shuffled and nobody asked twice."""
    got = answered(units, provider, "unit", log).withColumnRenamed("response", "result")
    checked = check_envelopes(got, schema).drop("status", "n_issues").withColumn("errors", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.col("errors"))).drop("error")
    again = F.size("errors") > 0
    return stored(checked.withColumns({c: F.when(again, F.col(c)) for c in ("request", "lines")}), what)


def call_checked(units: DataFrame, provider: Provider, schema: dict | None = None, log: AnswerLog | None = None) -> DataFrame:
    """unit, result, status, issue code for each unit (unit, distinct; request as JSON; lines that an answer may cite, as an
    array of id and text), with its other columns and the lines that the result cites.

    An answer with errors is asked for once more, with the errors told; if that fails too, what has data counts as
    partial and all else as failed, with the code ``unsupported``, which the result then names among its issues.  Only units
    with errors are asked again.  A result holds only evidence that passed its checks.
    """
    first = _answers(units, provider, schema, log, "checked")
    told = F.concat(F.lit('{"feedback":'), F.to_json("errors"), F.lit(","), F.substring("request", 2, 1 << 30))
    again = first.where(F.size("errors") > 0).withColumn("request", told).select(units.columns)
    second = _answers(again, provider, schema, log, "checked-again")
    final = first.where(F.size("errors") == 0).unionByName(second)
    clean = F.size("errors") == 0
    status = F.when(clean, F.get_json_object("result", "$.status")).when(F.col("has_data"), "partial").otherwise("failed")
    final = final.withColumns({"status": status, "code": F.when(~clean, "unsupported")})
    return final.withColumn("result", trusted_result(F.col("result"), F.col("status"), F.col("trusted"), F.col("code"))).drop("request", "lines", "has_data")


#: What a result says of itself where its evidence failed twice.
UNPROVED = "evidence failed its checks after a retry"


def trusted_result(result: Column, status: Column, trusted: Column, code: Column) -> Column:
    """The result (JSON text) with its status, the trusted evidence instead of its own, and an issue if there is a code.

    Data and issues go through VARIANT, so whatever JSON they hold stays as it is.  What is no JSON object stays so.
    """
    whole = F.try_parse_json(result)
    part = lambda name, kind: F.try_variant_get(whole, f"$.{name}", kind)
    evidence = F.transform(F.coalesce(trusted, F.array().cast("array<struct<ev_no:int,path:string,line_ids:array<string>,quote:string>>")), lambda e: F.struct(e["path"].alias("path"), e["line_ids"].alias("line_ids"), e["quote"].alias("quote")))
    own = F.to_variant_object(F.struct(code.alias("code"), F.lit(UNPROVED).alias("message")))
    none = F.array().cast("array<variant>")
    issues = F.concat(F.coalesce(part("issues", "array<variant>"), none), F.when(code.isNotNull(), F.array(own)).otherwise(none))
    body = F.to_json(F.struct(status.alias("status"), part("data", "variant").alias("data"), evidence.alias("evidence"), issues.alias("issues")), {"ignoreNullFields": "false"})
    return F.when(F.try_variant_get(whole, "$", "map<string,variant>").isNotNull(), body).otherwise(result)


def extract_chunks(chunks: DataFrame, lines: DataFrame, provider: Provider, schema: dict | None = None, log: AnswerLog | None = None) -> DataFrame:
    """Results of each chunk (doc_id, chunk_no, line_ids): doc_id, chunk_no, result, status, code, cited (the lines that the
    result cites).  Lines are brought to their chunks once, and stay in the chunk's row until its answer is checked."""
    own = chunks.select("doc_id", "chunk_no", F.posexplode("line_ids").alias("pos", "id")).join(lines.select("doc_id", "id", "text"), ["doc_id", "id"])
    shown = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id", "text"))), lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text")))
    units = own.groupBy("doc_id", "chunk_no").agg(shown.alias("lines")).withColumns({"unit": F.concat_ws("#", "doc_id", "chunk_no"), "request": F.to_json(F.struct("lines"))})
    return call_checked(units, provider, schema, log).drop("unit")


ISSUE = "struct<code:string,message:string,stage:string>"


def _own_issues(result: Column) -> Column:
    """The issues that a result itself reports."""
    own = F.coalesce(F.from_json(F.get_json_object(result, "$.issues"), "array<struct<code:string,message:string>>"), F.array().cast("array<struct<code:string,message:string>>"))
    return F.transform(own, lambda i: L.issue(i["code"], F.coalesce(i["message"], F.lit("Unspecified extraction issue")), "extraction"))


LINES = "array<struct<id:string,text:string>>"


def _with_cited(results: DataFrame, lines: DataFrame) -> DataFrame:
    """Results with ``cited``, the lines that their evidence cites."""
    evidence = F.from_json(F.get_json_object("result", "$.evidence"), "array<struct<line_ids:array<string>>>")
    ids = results.select("doc_id", "chunk_no", F.explode(F.flatten(F.transform(evidence, lambda e: F.coalesce(e["line_ids"], F.array().cast("array<string>"))))).alias("id")).distinct()
    cited = ids.join(lines.select("doc_id", "id", "text"), ["doc_id", "id"]).groupBy("doc_id", "chunk_no").agg(F.collect_list(F.struct("id", "text")).alias("cited"))
    return results.join(cited, ["doc_id", "chunk_no"], "left").withColumn("cited", F.coalesce("cited", F.array().cast(LINES)))


def _once(sorted_: Column) -> Column:
    """A sorted array with each element once, in one pass."""
    return F.transform(F.array(sorted_), lambda s: F.filter(s, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(s, i - 1))))[0]


def _merge_units(groups: DataFrame) -> DataFrame:
    """Requests of groups (doc_id, g, unit, parts, issues): the partial results and the lines that they cite."""
    units = groups.select("doc_id", "g", "unit", "issues", F.col("parts")[0].alias("head"), F.transform("parts", lambda p: p["result"]).alias("results"), _once(F.sort_array(F.flatten("parts.cited"))).alias("lines"))
    body = F.concat(F.lit('{"results":['), F.array_join("results", ","), F.lit('],"lines":'), F.to_json("lines"), F.lit("}"))
    return units.withColumn("request", body).drop("results")


def merge_tree(results: DataFrame, merge: Provider, lines: DataFrame, schema: dict | None = None, fan_in: int = FAN_IN, log: AnswerLog | None = None) -> DataFrame:
    """One result a document (doc_id, result, status, issues): groups of ``fan_in`` neighbours are merged, level by level;
    groups of one pass through.

    A merge is told the lines that its parts cite, and its answer is checked like an extraction, with one retry.  A merge that
    fails keeps its first part.  Failed chunks and merges are issues, and so is what results report themselves; a document
    with issues is partial at best.

    results: doc_id, chunk_no, result, status, code, cited; lines: doc_id, id, text, only read for results without ``cited``.
    A result carries the lines that it cites up the tree.  The levels grow with the logarithm of the most chunks of a document.
    """
    results = results if "cited" in results.columns else _with_cited(results, lines)
    results = stored(results.select("doc_id", "chunk_no", "result", "status", "code", "cited"), "results")
    none = F.array().cast(f"array<{ISSUE}>")
    usable = results.where("status <> 'failed'").select("doc_id", F.row_number().over(_by_chunk()).alias("n"), "result", "cited", none.alias("issues"))
    most = usable.agg(F.max("n")).first()[0] or 0
    now = usable
    while most > 1:
        grouped = now.withColumn("g", F.floor((F.col("n") - 1) / fan_in).cast("int") + 1).groupBy("doc_id", "g").agg(F.sort_array(F.collect_list(F.struct("n", "result", "cited"))).alias("parts"), F.flatten(F.collect_list("issues")).alias("issues"))
        grouped = stored(grouped.withColumn("unit", F.concat_ws("#", "doc_id", "g")), "groups")
        merged = call_checked(_merge_units(grouped.where(F.size("parts") > 1)), merge, schema, log)
        lost = F.coalesce(F.col("status") == "failed", F.lit(True)) | F.col("result").isNull()
        failed = F.when(lost, F.array(L.issue(F.lit("extraction_merge_failed"), F.lit("a group of partial results could not be merged"), "extraction")))
        weak = F.when(~lost & F.col("code").isNotNull(), F.array(L.issue(F.col("code"), F.lit(UNPROVED), "extraction")))
        kept = [F.when(lost, F.col("head")[c]).otherwise(F.col(c)).alias(c) for c in ("result", "cited")]
        merged = merged.select("doc_id", F.col("g").alias("n"), *kept, F.concat("issues", F.coalesce(failed, none), F.coalesce(weak, none)).alias("issues"))
        single = grouped.where(F.size("parts") == 1).select("doc_id", F.col("g").alias("n"), *(F.col("parts")[0][c].alias(c) for c in ("result", "cited")), "issues")
        now = merged.unionByName(single)
        most = -(-most // fan_in)
    lost = F.when(F.col("status") == "failed", L.issue(F.lit("extraction_chunk_failed"), F.lit("a part of the document could not be extracted"), "extraction"))
    unproved = F.when((F.col("status") != "failed") & F.col("code").isNotNull(), L.issue(F.col("code"), F.lit(UNPROVED), "extraction"))
    told = F.concat(_own_issues(F.col("result")), F.filter(F.array(lost, unproved), lambda i: i.isNotNull()))
    whole = results.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", told.alias("i")))), lambda s: s["i"])).alias("chunk_issues"))
    out = whole.join(now.select("doc_id", "result", "issues"), "doc_id", "left")
    issues = F.array_distinct(F.concat("chunk_issues", F.coalesce("issues", none), F.when(F.col("result").isNotNull(), _own_issues(F.col("result"))).otherwise(none)))
    out = out.withColumn("issues", issues)
    own = F.coalesce(F.get_json_object("result", "$.status"), F.lit("failed"))
    return out.select("doc_id", "result", F.when((own == "complete") & (F.size("issues") > 0), "partial").otherwise(own).alias("status"), "issues")


def _by_chunk():
    return Window.partitionBy("doc_id").orderBy("chunk_no")
