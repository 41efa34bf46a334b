"""Document fingerprints by consistent weighted sampling, in built-in functions only.

Terms are the words of a text in lower case, weighted by how often they occur.  For each of SLOTS independent samples, a term
t of weight w draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from hashes of t and the slot, sets

    k = floor(ln w / r + b),   ln y = r (k - b),   ln a = ln c - ln y - r

and the slot takes the (t, k) of the least ln a.  Two texts agree in a slot with a probability equal to their generalised
Jaccard similarity (sum of least weights over sum of greatest).  A slot is stored as a hash of its least ln a, which is the
same exactly where (t, k) is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SLOTS = 36
#: Keys of a range in which each key looks for the next lower one.
PER_BUCKET = 50_000


def _log_a(term: Column, log_weight: Column, slot: int) -> Column:
    one, two = F.xxhash64(term, F.lit(2 * slot)), F.xxhash64(term, F.lit(2 * slot + 1))
    part = lambda h, by, bits: (F.shiftrightunsigned(h, by).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)
    r = -F.log(part(one, 0, 20) * part(one, 20, 20))
    b = part(one, 40, 24)
    log_c = F.log(-F.log(part(two, 0, 31) * part(two, 31, 31)))
    return log_c - r * (F.floor(log_weight / r + b).cast("double") - b + 1.0)


def sample_slots(texts: DataFrame, keys: list[str], text: str, slots: int = SLOTS) -> DataFrame:
    """keys and ``slots`` (array of int) for each row; ``keys`` must tell rows apart.  A text without words has nulls.

    If ``texts`` is already dealt out by one of the keys, nothing is shuffled: a text's words meet where the text is.
    """
    word = F.explode_outer(F.split(F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D]", " ")), " +"))
    terms = texts.select(*keys, word.alias("word")).select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    weighted = terms.groupBy(*keys, "term").agg(F.log(F.count(F.lit(1)).cast("double")).alias("log_weight"))
    least = [F.min(_log_a(F.col("term"), F.col("log_weight"), i)).alias(f"a{i}") for i in range(slots)]
    got = weighted.where(F.col("term").isNotNull()).groupBy(*keys).agg(*least)
    return got.select(*keys, F.array(*[F.shiftright(F.xxhash64(f"a{i}"), 32).cast("int") for i in range(slots)]).alias("slots"))


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """Share of slots in which two fingerprints agree; two empty texts are alike, an empty and another are not."""
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] == z["y"])) / float(slots)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def as_hex(slots: Column) -> Column:
    """The fingerprint as text, eight digits a slot; that of a text without words is empty."""
    return F.coalesce(F.array_join(F.transform(slots, lambda x: F.lpad(F.hex(F.shiftleft(x.cast("long"), 32)), 16, "0").substr(1, 8)), ""), F.lit(""))


def next_lower(keys: DataFrame, key: str, number: int) -> DataFrame:
    """key and ``next_key``, the next lower key (null for the lowest), for ``number`` distinct keys.

    Spark deals the keys to ranges of about PER_BUCKET by a sample of them, so no range grows with gaps between keys; each
    looks within its range, and the lowest key of a range looks at the highest of the range below.
    """
    ranges = max(1, number // PER_BUCKET)
    placed = written(keys.repartitionByRange(ranges, key).select(key, F.spark_partition_id().alias("bucket")), "ranges")
    inner = placed.withColumn("next_key", F.lead(key).over(Window.partitionBy("bucket").orderBy(F.desc(key))))
    # A row a range.
    tops = placed.groupBy("bucket").agg(F.max(key).alias("top")).select("bucket", F.lead("top").over(Window.orderBy(F.desc("top"))).alias("next_top"))
    return inner.join(tops, "bucket").select(key, F.coalesce("next_key", "next_top").alias("next_key"))


def fingerprint_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Each document's fingerprint, and that of its text with the last half replaced by the start of the next document's.

    The next document is the one with the next lower key (after the lowest: the highest).  A null text counts as empty.
    Rows with a null key have no place in the order: they are their own next document.  Rows that repeat a key are kept;
    the next document of the key above is the one with the smallest text.  A text of any length is sampled whole.  An
    empty table gives no rows.  Other columns are not looked at.
    """
    high, filled, distinct, nulls = docs.agg(F.max(key), F.count(key), F.count_distinct(F.col(key)), F.count(F.when(F.col(key).isNull(), 1))).first()
    # Where keys tell rows apart, both sides of the join below are the same dealt-out table, and Spark shuffles it once.
    apart = F.lit(0).cast("long") if filled == distinct and nulls < 2 else F.monotonically_increasing_id()
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("rid", apart)
    if nulls:
        alone = rows.where(F.col(key).isNull()).withColumn("next_text", F.col("text"))
        rows = rows.where(F.col(key).isNotNull())
    first = rows
    if filled > distinct:
        # Each task sends one row of a key, so a key that very many rows repeat meets in one task as few rows.
        first = rows.groupBy(key).agg(F.min(F.struct("text", "rid")).alias("least")).select(key, "least.text", "least.rid")
    sizes = docs.where(F.col(key).isNotNull()).select(key, (F.char_length(F.coalesce(F.col(text), F.lit(""))) / 2).cast("long").alias("half"))
    order = next_lower(sizes.select(key).distinct(), key, distinct).withColumn("next_key", F.coalesce("next_key", F.lit(high)))
    order = written(order.join(sizes.groupBy(key).agg(F.max("half").alias("half")), key), "order")
    # Only as much of the next text travels as is needed.
    wanted = order.select(F.col(key).alias("target"), F.col("next_key").alias(key), "half")
    pieces = first.select(key, "text").join(wanted, key).select(F.col("target").alias(key), F.expr("left(text, cast(half AS int))").alias("next_text"))
    both = rows.join(pieces, key)
    if nulls:
        both = both.unionByName(alone)
    both = both.select(key, "rid", "text", F.char_length("text").cast("long").alias("n_chars"), F.concat(F.expr("left(text, cast(char_length(text) - char_length(text) div 2 AS int))"), F.expr("left(next_text, cast(char_length(text) div 2 AS int))")).alias("edited"))
    sides = both.select(key, "rid", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s")).select(key, "rid", "s.side", "s.text")
    found = sample_slots(sides, [key, "rid", "side"], "text", slots)
    found = found.groupBy(key, "rid").agg(F.max(F.when(F.col("side") == 0, F.col("slots"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("slots"))).alias("edit"))
    facts = both.select(F.col(key).alias("k"), F.col("rid").alias("r"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    out = written(facts.join(found, F.col("k").eqNullSafe(F.col(key)) & (F.col("r") == F.col("rid")), "left").select(F.col("k").alias(key), F.col("r").alias("rid"), "n_chars", "edited_sha256", "own", "edit"), "prints")
    ahead = out
    if filled > distinct:
        ahead = out.join(first.select("rid"), "rid", "left_semi")
    ahead = order.join(ahead.select(F.col(key).alias("next_key"), F.col("own").alias("next_own")), "next_key").select(F.col(key).alias("k"), "next_own")
    joined = out.join(ahead, F.col(key) == F.col("k"), "left")
    next_own = F.when(F.col(key).isNull(), F.col("own")).otherwise(F.col("next_own"))
    return joined.select(key, "n_chars", "edited_sha256", as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit"), slots).alias("near_edited"), likeness(F.col("own"), next_own, slots).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
