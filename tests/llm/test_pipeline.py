"""The stages on a small corpus."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"the word{i} and of" for i in range(40))


def test_stages(spark, tmp_path):
    rows = [(i, f"{BASE} number{i} " + " ".join(f"only{i}x{j}" for j in range(60)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[0][1] + f" edit{i}", "en", "s0", 1) for i in range(5)] + [(200, None, "en", "s1", 1), (201, "12 34", "en", "s1", 1), (202, rows[1][1], "de", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "mixing", "packing"]
    first = corpus_pipeline.language_id(spark, docs, "")
    assert first.columns == docs.columns and first.count() == len(rows) - 2
    second = corpus_pipeline.near_duplicates(spark, first, "")
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == set(range(60))
    third = corpus_pipeline.mixing(spark, second, "")
    assert third.columns == docs.columns and 0 < third.count() <= 60
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == {r.doc_id for r in third.collect()} and out.groupby("sequence_id").length.sum().max() <= 2048


def brute_components(texts, width=5, percent=80):
    """doc_id -> smallest doc_id of its group of near duplicates, by all pairs."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_against_brute_force(spark, tmp_path):
    """The whole pipeline on texts with edited copies: what each stage keeps, and the packing of what is left."""
    rng = random.Random(5)
    texts = {}
    for i in range(40):
        own = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(3, 160))]
        texts[10 * i] = " ".join(own)
        for c in range(rng.randrange(4)):
            copy = list(own)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts[10 * i + 1 + c] = " ".join(copy)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()] + [(900, "123 456", "en", "s0", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    groups = brute_components(texts)
    heads = {i for i, c in groups.items() if i == c}
    second = corpus_pipeline.near_duplicates(spark, corpus_pipeline.language_id(spark, docs, ""), "")
    assert {r.doc_id for r in second.collect()} == heads
    third = {r.doc_id for r in corpus_pipeline.mixing(spark, second, "").collect()}
    words = {i: len(texts[i].split()) for i in heads}
    assert third < heads and 0.25 < sum(words[i] for i in third) / sum(words.values()) < 0.75
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted((len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in third), reverse=True)
    bins = []
    for n in sizes:
        fits = [room for room in bins if room >= n]
        if fits:
            bins.remove(min(fits))
        bins.append((min(fits) if fits else 2048) - n)
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == third and sorted(out.length, reverse=True) == sizes and out.sequence_id.nunique() == len(bins)


def test_edges(spark, tmp_path):
    """Empty tables, null keys and columns, repeated rows, and columns with the names of internal ones."""
    extra = SCHEMA + ", block string, n string, bucket int, weight double"
    for name, rows in (("none", []), ("odd", [(None, None, None, None, None), (None, "a text without key", None, None, 1), (1, "some words here", "en", "s", 1), (1, "some words here", "en", "s", 1), (2, "", "en", "s", 0)])):
        docs = spark.createDataFrame([(*r, "b", "n", 1, 1.0) for r in rows], extra)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert not out if name == "none" else {r.doc_id for r in out} <= {None, 1}


def test_registration():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries()) and "pipeline" in queries()
