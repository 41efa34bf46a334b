"""Mixing sources to target weights: raking to source, language and topic marginals, in built-in functions only.

Documents are reduced to cells (source, language, topic) with their tokens.  Iterative proportional fitting scales the
cells' weights until the weighted tokens have the target share for every source, language and topic.  Fitting is bounded: the
weights are the probabilities of keeping a document, so they add up to the wanted part of all tokens and none is above 1; a
cell that would pass 1 is held there and the others make up for it.  A document is then kept or not by a hash of its key.
So the size of the result is what was asked for, whatever the rarest cell is.  Targets that temper the actual shares never
ask a category for more tokens than it has; where given shares do, all that there are is kept, and ``reached`` tells the gap.

Topics are clusters of texts by form: the shares of six kinds of characters give a point, clusters start at the points of
TOPICS, and a few rounds over all documents move them to the means of what is nearest to them.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, free, table, written

#: Stands for null in a margin, so that null is a category like any other.
NONE = "\0"
#: Part of all tokens that a mixture keeps.
SIZE = 0.5
#: Fitting ends when no share is further from its target than TOLERANCE, relative to the target; when a sweep over all margins
#: moves no weight by more than SETTLED of itself (then the targets can't be met); or after ROUNDS rounds of SWEEPS.
TOLERANCE, SETTLED, ROUNDS, SWEEPS = 1e-4, 1e-7, 60, 5
#: Cells that one task fits; more are dealt out.
TASK_CELLS = 100_000
#: Target shares of the query's margins; a number tempers the actual shares (share ** number, normalised).
TARGETS: dict[str, Mapping[str, float] | float] = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Kinds of characters whose shares describe a text.
FORM = {"figures": "[0-9]", "cells": r"[|\t]", "signs": r"[#$%&*<>{}\[\]=@_~^\\]", "capitals": r"\p{Lu}", "breaks": r"\n", "blanks": " "}
#: Where clusters start: per mille square roots of the shares of FORM.
TOPICS = {
    "prose": (30, 0, 20, 130, 100, 390),
    "record": (280, 0, 100, 150, 130, 380),
    "table": (50, 320, 20, 120, 100, 430),
    "markup": (40, 0, 300, 130, 100, 390),
    "shouting": (20, 0, 20, 850, 100, 390),
    "list": (40, 0, 30, 250, 300, 330),
}
#: Rounds in which clusters move.
MOVES = 4


def form_of(text: Column) -> Column:
    """A text's point: per mille square roots of the shares of FORM, whole numbers, so that means of them are exact."""
    size = F.greatest(F.char_length(text), F.lit(1))
    return F.when(text.isNotNull(), F.array(*[F.round(F.sqrt(F.regexp_count(text, F.lit(chars)) / size) * 1000).cast("long") for chars in FORM.values()]))


def nearest(form: Column, centres: Mapping[str, tuple[float, ...]]) -> Column:
    """The name of the cluster whose centre is nearest; ties go to the first by name."""
    apart = lambda at: F.aggregate(F.zip_with(form, F.array(*[F.lit(float(x)) for x in at]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.array_min(F.array(*[F.struct(apart(at).alias("far"), F.lit(name).alias("name")) for name, at in centres.items()]))["name"]


def topic_centres(forms: DataFrame, form: str = "form") -> dict[str, tuple[float, ...]]:
    """Clusters of all points, from the starts TOPICS; a cluster that nothing is nearest to stays where it is."""
    centres = {k: tuple(map(float, v)) for k, v in TOPICS.items()}
    for _ in range(MOVES):
        means = forms.where(F.col(form).isNotNull()).groupBy(nearest(F.col(form), centres).alias("topic")).agg(*[F.avg(F.col(form)[i]).alias(f"c{i}") for i in range(len(FORM))])
        centres |= {r["topic"]: tuple(r[f"c{i}"] for i in range(len(FORM))) for r in means.collect()}  # a row a cluster
    return centres


def token_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_shares(cells: DataFrame, margin: str, target: Mapping[str, float] | float, size: float | None = None) -> DataFrame:
    """margin, target (adding up to 1) for every category that has tokens.

    A mapping fixes categories' shares; those it doesn't name divide what is left in proportion to their tokens.  A number
    tempers the actual shares, and with a ``size`` (the part of all tokens to keep) no target passes what its category has:
    what it would be short of goes to the others in proportion.
    """
    actual = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    if isinstance(target, Mapping):
        rest = max(0.0, 1.0 - sum(target.values()))
        fixed = F.coalesce(*[F.when(F.col(margin) == k, F.lit(float(v))) for k, v in target.items()], F.lit(None).cast("double")) if target else F.lit(None).cast("double")
        actual = actual.withColumn("fixed", fixed)
        others = actual.agg(F.sum(F.when(F.col("fixed").isNull(), F.col("tokens")))).first()[0] or 1.0
        raw = actual.select(margin, F.coalesce("fixed", F.col("tokens") / F.lit(others) * F.lit(rest)).alias("raw"))
    else:
        raw = actual.select(margin, F.pow("tokens", F.lit(float(target))).alias("raw"), "tokens")
        if size:
            return within_reach(raw, margin, size)
    total = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(margin, (F.col("raw") / F.lit(total)).alias("target")).where("target > 0")


def within_reach(raw: DataFrame, margin: str, size: float) -> DataFrame:
    """margin, target: in proportion to ``raw``, but none above what its category has of the kept tokens.

    In the order of what a category has to what it is asked for, the first ones get all that they have; the others share the
    rest.  A row a category, so one task can do it.
    """
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("raw"), margin)
    shares = raw.select(margin, "raw", (F.col("tokens") / F.sum("tokens").over(whole) / F.lit(float(size))).alias("most"))
    shares = shares.withColumns({"full": F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("raw").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    # What one part of raw is worth if all before get what they have: it holds for the first category that stays below.
    shares = shares.withColumn("worth", (1 - F.col("full")) / F.col("open"))
    worth = F.min(F.when(F.col("worth") * F.col("raw") <= F.col("most"), F.struct(F.col("most") / F.col("raw"), F.col(margin), F.col("worth").alias("worth")))).over(whole)
    return shares.select(margin, F.least("most", F.coalesce(worth["worth"] * F.col("raw"), F.col("most"))).alias("target")).where("target > 0")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], size: float | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """cells (the margins' columns and tokens) with a weight: weighted tokens have the target shares.

    With a ``size``, weights add up to that part of all tokens and none is above 1; else they average 1 and have no bound.
    Cells of categories with a target of 0 get the weight 0.  Targets that can't be met (they contradict each other in
    empty cells, or ask for more tokens than there are) are met as nearly as fitting brings them, with a warning.
    """
    cells = written(cells, "cells")
    total, number = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = total or 0
    now = cells.withColumn("weight", F.when(F.col("tokens") > 0, float(size or 1.0)).otherwise(0.0))
    if not total:
        return now
    for margin, target in targets.items():
        shares = target_shares(cells, margin, target, size).withColumnRenamed("target", f"_to_{margin}")
        now = now.join(shares, margin, "left").withColumn(f"_to_{margin}", F.coalesce(f"_to_{margin}", F.lit(0.0)) * F.lit(float(total * (size or 1.0))))
    now = written(now, "cells")
    have = lambda m: F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m))
    for _ in range(rounds):
        held, now = now, now.coalesce(1 + number // TASK_CELLS)  # few cells in one partition need no shuffle for any margin
        for sweep in range(SWEEPS):
            if sweep == SWEEPS - 1:
                now = now.withColumns({"_off": F.lit(0.0), "_was": F.col("weight")})
            for margin in targets:
                scaled = F.when(F.col("_have") > 0, F.col("weight") * F.col(f"_to_{margin}") / F.col("_have")).otherwise(0.0)
                now = now.withColumn("_have", have(margin))
                if sweep == SWEEPS - 1:
                    gap = F.abs(F.col("_have") / F.col(f"_to_{margin}") - 1)
                    now = now.withColumn("_off", F.greatest("_off", F.when(F.col(f"_to_{margin}") > 0, gap).otherwise(0.0)))
                now = now.withColumn("weight", F.least(scaled, F.lit(1.0)) if size else scaled)
        larger = F.greatest("weight", "_was")
        moved = F.when(larger > 0, F.abs(F.col("weight") - F.col("_was")) / larger).otherwise(0.0)
        now = written(now.withColumn("_moved", moved).drop("_have", "_was"), "cells")
        drop_written(held)
        off, most = now.agg(F.max("_off"), F.max("_moved")).first()
        if (off or 0.0) < tolerance or (most or 0.0) < SETTLED:
            break
    if (off or 0.0) >= tolerance:
        why = "the targets can't be met" if most < SETTLED else f"fitting had not ended after {rounds} rounds"
        warnings.warn(f"raking leaves a share {100 * off:.2f} per cent from its target: {why}", stacklevel=2)
    return now.select(*cells.columns, "weight")


def reached(fitted: DataFrame, targets: Mapping[str, Mapping[str, float] | float], size: float | None = None) -> DataFrame:
    """margin, category, target and share: what each share of the weighted tokens should be and is."""
    out = None
    for margin, target in targets.items():
        whole = fitted.agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0] or 1.0
        got = fitted.groupBy(margin).agg((F.sum(F.col("tokens") * F.col("weight")) / F.lit(whole)).alias("share"))
        rows = target_shares(fitted, margin, target, size).join(got, margin).select(F.lit(margin).alias("margin"), F.col(margin).alias("category"), "target", "share")
        out = rows if out is None else out.unionByName(rows)
    return out


def mix_documents(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], *, size: float = SIZE, key: str = "doc_id", text: str = "text", topic: Column | None = None, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """The documents that the mixture keeps: key, the columns ``keep``, the margins' values, n_tokens and probability.

    ``targets`` names the margins: columns of ``docs``, or ``topic``, a cluster by form unless ``topic`` is given (null texts:
    ``empty``); ``size`` is the part of all tokens to keep.  Null is a category of its own.  A row is kept or not by a hash of
    its key (null keys alike), so rows that repeat a key go the same way if they are in the same cell.  Documents without
    tokens have no weight and are left out; a text of any length counts whole.  An empty table gives no rows.  A column of
    ``keep`` takes precedence over an added one of its name, whatever that is.
    """
    margins, kept = list(targets), list(dict.fromkeys([key, *(keep or [])]))
    of = dict(zip(margins, free(kept, *[f"margin_{m}" for m in margins]), strict=True))
    form, tokens, probability = free([*kept, *of.values()], "form", "tokens", "probability")
    clustered = "topic" in targets and topic is None
    value = {m: F.coalesce(topic if m == "topic" else F.col(m).cast("string"), F.lit(NONE)) for m in margins if not (m == "topic" and clustered)}
    # Texts are looked at once; what follows reads what was found.
    marked = docs.select(*kept, *[v.alias(of[m]) for m, v in value.items()], token_count(F.col(text)).alias(tokens), *([form_of(F.col(text)).alias(form)] if clustered else []))
    marked = written(marked, "marked")
    if clustered:
        centres = topic_centres(marked, form)
        marked = marked.withColumn(of["topic"], F.when(F.col(form).isNull(), "empty").otherwise(nearest(F.col(form), centres)))
    # A row for each combination of the margins' values that occurs.
    cells = marked.groupBy(*of.values()).agg(F.sum(tokens).alias("tokens"))
    fitted = rake(cells.select(*[F.col(c).alias(m) for m, c in of.items()], "tokens"), targets, size)
    fitted = fitted.select(*[F.col(m).alias(c) for m, c in of.items()], F.col("weight").alias(probability))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") / float(1 << 53)
    # Few cells, so Spark hands them to every task when they are small enough, and splits hot cells when they are not.
    sample = marked.join(fitted, list(of.values())).where((F.col(tokens) > 0) & (uniform < F.col(probability)))
    added = {m: F.when(F.col(c) != NONE, F.col(c)) for m, c in of.items()} | {"n_tokens": F.col(tokens), "probability": F.col(probability)}
    taken = {c.lower() for c in kept}
    return sample.select(*kept, *[c.alias(n) for n, c in added.items() if n.lower() not in taken])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), TARGETS)
