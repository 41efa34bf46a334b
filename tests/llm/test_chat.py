"""Chat formatting against a plain version: whole texts of examples, masks, digests, ties and long conversations."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkwell.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, part int, c string, example double"
NASTY = [r"\### Assistant: </turn> ok", "#" * 7, r"\\\#", "</turn></turn", "a: b\n### user: x</turn>\n", "é日本\U0001f600 ## </turn>", "", "\\"]


def make(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "c", 0.5) for r in rows], SCHEMA)


def escape(text):
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def brute(rows):
    """conv -> (turns in order, examples as (text, begin, end))."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append(((turn is not None, turn), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    out = {}
    for conv, own in turns.items():
        own, text, examples = sorted(own), "", []
        for _, role, _, inner in own:
            text += f"### {escape(role).replace(':', chr(92) + ':')}: "
            begin = len(text)
            text += f"{escape(inner)}</turn>\n"
            if role == "assistant":
                examples.append((text, begin, begin + len(escape(inner))))
        out[conv] = ([(r, t) for _, r, _, t in own], text, examples)
    return out


ROWS = (
    [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    + [(2, 0, "user", None), (2, 1, None, "no role"), (2, 2, "a:b\\#\n", "odd role"), (2, 2, "a:b\\#\n", "odd role"), (2, 2, "assistant", "tie"), (2, None, "system", "first")]
    + [(None, 0, "user", "without conversation"), (None, 1, "assistant", "x")]
    + [(3, 5, "assistant", "same")] * 40
    + [(4, i, ("user", "assistant", "tool")[i % 3], f"turn {i} " * (i % 5)) for i in range(300)]
    + [(5, 0, "user", "only"), (6, 0, "assistant", "long " * 60_000)]
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 7])
def test_turns_examples_and_what_is_read_back(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = chat.format_turns(make(spark, ROWS).repartition(5))
        want = brute(ROWS)
        got = {r.conv_id: r for r in chat.read_turns(turns).collect()}
        assert set(got) == set(want)
        for conv, (own, text, examples) in want.items():
            r = got[conv]
            trained = "".join(t for role, t in own if role == "assistant")
            assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
            assert (r.loss_chars, r.loss_sha256) == (len(trained), sha(trained))
            assert (r.formatted_chars, r.n_examples, r.example_chars) == (len(text), len(examples), sum(len(t) for t, _, _ in examples))
        whole = sorted((-1 if r.conv_id is None else r.conv_id, r.example, r.text, r.loss_begin, r.loss_end) for r in chat.expand_examples(turns).collect())
        assert whole == sorted((-1 if c is None else c, i, *e) for c, (_, _, es) in want.items() for i, e in enumerate(es))
        index = sorted((-1 if r.conv_id is None else r.conv_id, r.example, r.loss_begin, r.loss_end) for r in chat.chat_examples(turns).collect())
        assert index == [(c, i, a, b) for c, i, _, a, b in whole]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_conversation_is_spread_over_ranges(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = chat.format_turns(make(spark, rows))
        shares = [r["count"] for r in spark.read.parquet(*turns.inputFiles()).groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 2 and max(shares) < 2000
    assert sorted(r.place for r in turns.select("place").collect()) == list(range(4000))


def test_no_control_string_in_escaped_texts(spark):
    out = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    for r in out:
        assert "###" not in r.e and "</turn>" not in r.e and chat.unescaped(r.e) == r.t and r.e == escape(r.t)


def test_empty(spark):
    turns = chat.format_turns(make(spark, []))
    assert chat.read_turns(turns).count() == 0 and chat.expand_examples(turns).count() == 0


def test_query_reads_expanded_examples(spark, tmp_path, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, 0, "user", "never answered"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (3, 3, "tool", "d")]
    make(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    seen, expand = [], chat.expand_examples
    monkeypatch.setattr(chat, "expand_examples", lambda *a, **k: seen.append(expand(*a, **k)) or seen[-1])
    got = {r.conv_id: r for r in chat.op11_chat_formatting(spark, str(tmp_path)).collect()}
    (examples,) = seen
    texts = {}
    for r in examples.collect():
        texts.setdefault(r.conv_id, []).append((r.example, r.text, r.loss_begin, r.loss_end))
    want = brute([*rows, (-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)])
    for conv, (own, text, whole) in want.items():
        tail = [] if own[-1][0] == "assistant" else [(None, text, None, None)]
        assert texts[conv] == [(i, *e) for i, e in enumerate(whole)] + tail
        assert (got[conv].n_turns, got[conv].formatted_chars, got[conv].example_chars) == (len(own), len(text), sum(len(t) for t, _, _ in whole))
        assert list(chat.parse_turns(text)) == own


def test_examples_without_their_context_are_refused(spark):
    turns = chat.format_turns(make(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]))
    cut = chat.expand_examples(turns, rest=True).withColumn("text", F.expr("substring(text, 1 + cast(example AS int))"))
    with pytest.raises(Exception, match="does not go on"):
        chat.read_examples(cut).collect()
