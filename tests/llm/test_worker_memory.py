"""What a Python worker holds while it works on texts is bounded, and so are the batches that it is given."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import common, ngram_counts, setjoin

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def many_texts(size: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [" ".join(f"w{(i * 7919 + j * 104729) % 99991}" for j in range(400)) for i in range(size // 2500)]
    return common.text_bytes(pa.array(rows))


def test_shingles_take_a_few_bytes_for_each_of_text():
    raw, offsets = many_texts(4 << 20)
    common.span_hashes(raw[:10], np.array([0]), np.array([10]))
    tracemalloc.start()
    try:
        values, _ = setjoin.shingle_sets(raw, offsets, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(values) > 100_000
    assert peak < 8 * len(raw)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_pieces_change_no_set(monkeypatch, width):
    rows = ["", "a b", "A b c d e f", None, "one", "x " * 300, "a b c a b c a b c", " ".join(map(str, range(200)))] * 3
    raw, offsets = common.text_bytes(pa.array(rows))
    whole = setjoin.shingle_sets(raw, offsets, width)
    for most in (1, 7, 64, 1000):
        monkeypatch.setattr(setjoin, "HASHED", most)
        for a, b in zip(whole, setjoin.shingle_sets(raw, offsets, width), strict=True):
            assert a.dtype == b.dtype and a.tolist() == b.tolist()
    none = setjoin.shingle_sets(np.zeros(0, np.uint8), np.zeros(1, np.int64), width)
    assert none[0].tolist() == [] and none[1].tolist() == [0]


@pytest.mark.parametrize("own", [None, "77", "5000", "0"])
def test_join_is_given_small_batches_and_puts_the_setting_back(spark, monkeypatch, own):
    seen, wrote = [], setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, what: (seen.append(spark.conf.get(NAME)), wrote(df, what))[1])
    before = spark.conf.get(NAME, None)
    if own:
        spark.conf.set(NAME, own)
    try:
        docs = wrote(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h"), (4, None)], "doc_id long, text string"), "docs")
        got = {r[0]: r[2] for r in setjoin.jaccard_components(docs).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4}
        assert set(seen) == {"77" if own == "77" else str(common.BATCH_ROWS)}
        assert spark.conf.get(NAME, None) == own
        with pytest.raises(ZeroDivisionError), common.small_batches(spark):
            1 / 0
        assert spark.conf.get(NAME, None) == own
    finally:
        spark.conf.unset(NAME) if before is None else spark.conf.set(NAME, before)


@pytest.mark.parametrize("width", [5, 8])
def test_sums_of_a_shard_take_little_memory_and_are_those_of_all_its_rows(width):
    random = np.random.default_rng(3)
    keys = random.integers(0, 1 << 62, 200_000, dtype=np.uint64)[random.integers(0, 200_000, 400_000)]
    counts = random.integers(0, 5, len(keys)).astype("<u4")
    packed = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width])
    tracemalloc.start()
    try:
        sums, sizes, times = ngram_counts.shared_sums(packed, counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    _, at = np.unique(keys & np.uint64((1 << 8 * width) - 1 & (1 << 64) - 1), return_inverse=True)
    total = np.bincount(at, weights=counts)
    assert (sums == total[at]).all()
    assert [x.tolist() for x in (sizes, times)] == [x.tolist() for x in np.unique(total[total > 0], return_counts=True)]
    assert peak < 30 * len(keys)
    none = ngram_counts.shared_sums(packed[:0], counts[:0])
    assert [len(x) for x in none] == [0, 0, 0]
