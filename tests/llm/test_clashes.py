"""Columns of a table that are called like columns that operators and stages add or use inside."""

import corpus_pipeline
from inkwell.llm import langid, mixing

NAMES = ["score", "held_out", "lang_pred", "has_letters", "has_letters_", "_has_letters", "_tokens", "tokens", "form", "probability", "margin_source", "margin_lang", "margin_topic", "weight", "Score", "n_tokens", "topic", "component_id", "block", "list"]


def make(spark):
    names = NAMES[:14] + NAMES[15:]  # Spark takes Score for score
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} double" for n in names)
    rows = [(i, f"the word{i} and of some other word{i % 5} " * 9, ("en", "de")[i % 2], f"s{i % 3}", 1, *[0.123 + j for j in range(len(names))]) for i in range(60)]
    return spark.createDataFrame(rows, schema), names


def test_stages_keep_a_users_columns(spark):
    docs, names = make(spark)
    own = {r.doc_id: tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r) == own[r.doc_id] for r in rows)
    assert corpus_pipeline.packing(spark, docs, "").count() == 60


def test_operators_keep_a_users_columns(spark):
    docs, names = make(spark)
    own = {r.doc_id: r for r in docs.collect()}
    out = langid.identify(docs, names=("a", "b", "c"))
    assert out.columns == [*docs.columns, "a", "b", "c"]
    assert all(tuple(r)[: len(docs.columns)] == tuple(own[r.doc_id]) for r in out.collect())
    added = langid.identify(docs).collect()
    assert all(r.has_letters == own[r.doc_id].has_letters and r.lang_pred in ("en", "de") and 0 <= r.score <= 1 for r in added)
    mixed = mixing.mix_documents(docs, mixing.TARGETS, keep=docs.columns)
    assert mixed.columns == [*docs.columns] and all(tuple(r) == tuple(own[r.doc_id]) for r in mixed.collect())
