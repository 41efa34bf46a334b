"""JSON pointers: escaping, the leaves of a document, and looking one up."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def leaves(value, path: str = "/data") -> Iterator[tuple[str, object]]:
    """(pointer, value) of every scalar that isn't null; empty containers have none."""
    waiting = [(path, value)]
    while waiting:
        at, here = waiting.pop()
        if isinstance(here, dict):
            waiting += [(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(here.items())]
        elif isinstance(here, list):
            waiting += [(f"{at}/{i}", v) for i, v in reversed(list(enumerate(here)))]
        elif here is not None:
            yield at, here


def resolve(value, pointer: str):
    """What a pointer below /data names; LookupError if nothing is there."""
    if not pointer.startswith("/data/"):
        raise LookupError(pointer)
    for part in pointer.split("/")[2:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list):
            if not part.isdigit() or int(part) >= len(value):
                raise LookupError(pointer)
            value = value[int(part)]
        elif isinstance(value, dict) and part in value:
            value = value[part]
        else:
            raise LookupError(pointer)
    return value


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def nodes(docs: DataFrame, variant: str, root: str = "/data", depth: int | None = None) -> DataFrame:
    """The rows of ``docs`` (other columns than ``variant``) with path and node: one for each value in a VARIANT column, the
    whole, its members, theirs and so on.

    Each level is a lateral ``variant_explode`` of the containers of the level above, so all is one chain of generators
    without a shuffle.  ``depth`` is the number of levels below the root; if it isn't given, levels are added until one
    holds no containers, which looks at the table once a level.  A null variant has no nodes.
    """
    keep = [c for c in docs.columns if c != variant]
    level = docs.where(F.col(variant).isNotNull()).select(*keep, F.lit(root).alias("path"), F.col(variant).alias("node"))
    out, below = level, 0
    while depth is None or below < depth:
        held = level.where(_kind(F.col("node")).rlike("^(OBJECT|ARRAY)"))
        if depth is None and held.isEmpty():
            break
        part = F.coalesce(escape(F.col("key")), F.col("pos").cast("string"))
        level = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("node").outer())).select(*keep, F.concat("path", F.lit("/"), part).alias("path"), F.col("value").alias("node"))
        out, below = out.unionByName(level), below + 1
    return out


def leaf_pointers(docs: DataFrame, variant: str, depth: int | None = None) -> DataFrame:
    """The other columns of ``docs``, path and value (as text) of every scalar in a VARIANT column that isn't null."""
    return nodes(docs, variant, depth=depth).where(~_kind(F.col("node")).rlike("^(OBJECT|ARRAY|VOID)")).withColumn("value", F.col("node").cast("string")).drop("node")


def resolved(value: Column, pointer: Column) -> Column:
    """The VARIANT that a pointer below /data names in a VARIANT; null if nothing is there (a JSON null is a VARIANT).

    One step for each part of the pointer: a member by its name, or an element by its number.
    """
    def step(at: Column, raw: Column) -> Column:
        part = F.replace(F.replace(raw, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        member = F.try_element_at(F.try_variant_get(at, "$", "map<string,variant>"), part)
        number = F.when(part.rlike("^[0-9]{1,9}$"), part).cast("int")
        return F.coalesce(member, F.get(F.try_variant_get(at, "$", "array<variant>"), number))

    parts = F.slice(F.split(pointer, "/"), 3, F.greatest(F.size(F.split(pointer, "/")) - 2, F.lit(0)))
    return F.when(F.startswith(pointer, F.lit("/data/")), F.aggregate(parts, value, step))


GENERIC_METADATA = re.compile(r"/data/fields/[^/]*/(name|value_type)")


def is_generic_metadata(path: Column) -> Column:
    """Names and kinds of the generic schema's fields need no evidence."""
    return path.rlike(f"^{GENERIC_METADATA.pattern}$")
