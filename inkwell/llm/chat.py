"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example's context are all turns before its target, and only the target's text is trainable.  A conversation is formatted
once, a row a turn, and stored; ``expand_examples`` makes of it an example for each target, with its whole context.  The
contexts of a conversation of T turns hold T² / 4 turns, so examples are streamed and not stored.

Template: ``### role: text</turn>`` and a line feed.  In texts and roles a backslash is put before each backslash, between
two signs of ``##`` and into ``</turn>``, so neither ``###`` nor ``</turn>`` stands in an escaped text; in roles also before
colons.  Taking each backslash away from what it stands before undoes it.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length is spread over as many tasks as it needs;
places of turns and examples are running sums within ranges, plus what earlier ranges hold of the conversation that goes on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PIECE, slices, table, written

HEAD, TAIL, TARGET = "### ", "</turn>", "assistant"
END = f"{TAIL}\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: The turns of the conversation that is added to the query's table.
PLANTED = r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("##"), F.lit("#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a turn, stored: conv, place (from 0), begin (code points of the conversation before the turn),
    formatted, example (from 0; null unless it is a target), loss_begin and loss_end (code points of the conversation).

    The formatted texts of a conversation's rows, one after another, are the conversation.  Turns are in the order of
    (turn, role, digest of the text), nulls first, so ties have an order as well; repeated rows are all kept.  Null texts and
    roles are empty ones; rows without conversation are one conversation without name.  A text of any length is formatted
    whole.  An empty table gives no rows, and other columns are not looked at.
    """
    rows = conversations.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    # By a digest and a number, so that ranges can part even a turn that very many rows repeat, and no text is sampled.
    rows = rows.withColumns({"d": F.sha2("x", 256), "i": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("c", "t", "r", "d", "i").withColumn("part", F.spark_partition_id())
    target = F.col("r") == TARGET
    lead = F.concat(F.lit(HEAD), F.replace(escaped(F.col("r")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    made = dealt.withColumns({"head": F.char_length(lead).cast("long"), "inner": escaped(F.col("x")), "lead": lead})
    made = made.select("part", "c", "t", "r", "d", "i", "head", F.char_length("inner").cast("long").alias("size"), F.concat("lead", "inner", F.lit(END)).alias("formatted"))
    made = made.withColumn("chars", F.char_length("formatted").cast("long"))
    # Within a range: no group is larger than its range.
    within = Window.partitionBy("part", "c").orderBy("t", "r", "d", "i").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda column: F.coalesce(column, F.lit(0).cast("long"))
    made = made.withColumns({"place": zero(F.count(F.lit(1)).over(within)), "begin": zero(F.sum("chars").over(within)), "example": zero(F.sum(target.cast("long")).over(within))})
    made = written(made.select("part", "c", "place", "begin", "example", "head", "size", "chars", target.alias("target"), "formatted"), "turns")
    held = made.groupBy("part", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum(F.col("target").cast("long")).alias("targets"))
    # Conversations that go over the edge of a range: two a range at most, so their number is that of the ranges.
    edge = held.groupBy("c").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("c")
    across = held.join(edge, held["c"].eqNullSafe(edge["c"]), "left_semi")
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = across.select(F.col("part").alias("p"), F.col("c").alias("k"), *[zero(F.sum(x).over(earlier)).alias(f"past_{x}") for x in ("n", "chars", "targets")])
    whole = made.join(F.broadcast(carry), (F.col("part") == F.col("p")) & F.col("c").eqNullSafe(F.col("k")), "left")
    begin = F.col("begin") + zero(F.col("past_chars"))
    loss = F.when(F.col("target"), begin + F.col("head"))
    return whole.select(
        F.col("c").alias(conv), (F.col("place") + zero(F.col("past_n"))).alias("place"), begin.alias("begin"), "formatted",
        F.when(F.col("target"), F.col("example") + zero(F.col("past_targets"))).alias("example"), loss.alias("loss_begin"), (loss + F.col("size")).alias("loss_end"),
    )


def chat_examples(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The examples of formatted turns: conv, example, loss_begin (as many code points of context) and loss_end."""
    return turns.where(F.col("example").isNotNull()).select(conv, "example", "loss_begin", "loss_end")


def in_order(turns: DataFrame, conv: str) -> DataFrame:
    """Formatted turns, conversation by conversation and in order, for a function that streams over them."""
    return turns.repartition(conv).sortWithinPartitions(conv, "place")


def expand_examples(turns: DataFrame, conv: str = "conv_id", rest: bool = False) -> DataFrame:
    """conv, example, text (context, target and the end of its turn), loss_begin, loss_end: examples with their whole texts.

    With ``rest`` a conversation that goes on after its last target ends with a row of all its turns, without target (example,
    loss_begin and loss_end null).  Rows come conversation by conversation and in order.  A task streams over its
    conversations and holds the text of one and about a megabyte of examples; what comes out grows with the square of the turns.
    """
    kind = turns.schema[conv].dataType.simpleString()
    names = [conv, "example", "text", "loss_begin", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, done, size, ended = None, [], [], 0, True

        def rows() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        kinds = None
        for batch in slices(batches, "formatted"):
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for name, place, formatted, example, begin, end in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if place == 0:
                    if rest and not ended:
                        done.append((own, None, "".join(parts), None, None))
                        size += len(done[-1][2])
                    own, parts = name, []
                parts.append(formatted)
                ended = example is not None
                if ended:
                    parts = ["".join(parts)]
                    done.append((name, example, parts[0], begin, end))
                    size += len(parts[0])
                if size >= PIECE:
                    yield rows()
                    done, size = [], 0
        if rest and not ended:
            done.append((own, None, "".join(parts), None, None))
        if done:
            yield rows()

    return in_order(turns.select(conv, "place", "formatted", "example", "loss_begin", "loss_end"), conv).mapInArrow(run, f"`{conv}` {kind}, example long, text string, loss_begin long, loss_end long")


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("no formatted turn")
    return unescaped(found[1]), unescaped(found[2])


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation: neither ends before its ``</turn>``, which no text holds."""
    begin = 0
    while begin < len(text):
        end = text.index(END, begin) + len(END)
        yield parse_turn(text[begin:end])
        begin = end


def read_examples(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What expanded examples (with ``rest``) hold, a row a conversation: n_turns, the digest of its roles and texts,
    characters and digest of all text under the masks of its examples, its formatted characters, its examples and their
    characters.

    Turns are read from the last text of a conversation, which holds them all; each text has to go on with the one before.
    Digests go over a conversation in order, so a task streams over its examples and holds two of them.
    """
    kind = examples.schema[conv].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]

    class Sums:
        def __init__(self, name):
            self.name, self.last, self.loss = name, "", hashlib.sha256()
            self.loss_chars = self.examples = self.example_chars = 0

        def add(self, text: str, begin: int, end: int) -> None:
            trained = unescaped(text[begin:end])
            self.loss.update(trained.encode())
            self.loss_chars += len(trained)
            self.examples += 1
            self.example_chars += len(text)

        def row(self) -> list:
            turns, n = hashlib.sha256(), 0
            for n, (role, text) in enumerate(parse_turns(self.last), 1):
                turns.update(f"{role}\n{text}\n".encode())
            return [self.name, n, turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), len(self.last), self.examples, self.example_chars]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = None, None
        for batch in slices(batches, "text"):
            done, kind = [], batch.schema.field(0).type
            for name, example, text, begin, end in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own is None or example == 0 or not (own.name == name or own.name != own.name and name != name):  # NaN is one name
                    done += [own.row()] if own else []
                    own = Sums(name)
                if not text.startswith(own.last):
                    raise ValueError("an example does not go on with the one before")
                own.last = text
                if example is not None:
                    own.add(text, begin, end)
            if done:
                yield rows(done, kind)
        if own:
            yield rows([own.row()], kind)

    def rows(done: list[list], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *map(pa.array, columns[1:])], names=[conv, *names])

    kinds = ["long", "string", "long", "string", "long", "long", "long"]
    streamed = examples.select(conv, "example", "text", "loss_begin", "loss_end")
    return streamed.mapInArrow(run, f"`{conv}` {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def read_turns(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What formatted turns hold, read back from their expanded examples."""
    return read_examples(expand_examples(turns, conv, rest=True), conv)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(PLANTED).alias("text"))
    return read_examples(expand_examples(format_turns(conversations.unionByName(planted)), rest=True))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length('### ' || replace(replace(replace(replace(r, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:') || ': '
    || replace(replace(replace(t, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') || '</turn>') + 1 AS chars FROM turns
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(t) ROWS UNBOUNDED PRECEDING) AS until FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, sha256(t))) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, sha256(t)) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE r = 'assistant') AS n_examples,
  CAST(coalesce(sum(until) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS example_chars
FROM placed GROUP BY conv_id
"""
