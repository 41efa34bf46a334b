"""Fill-in-middle against a plain version on strings; rank and select against counting."""

import hashlib

import numpy as np

from inkwell.llm import fim

SCHEMA = "doc_id long, text string, n string, form int, output string, lang string"


def brute(key, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_against_strings(spark):
    rng = np.random.default_rng(4)
    letters = list("ab <>PSM\n") + ["é", "日", "\U0001f600", "́"]
    rows = [(i, "".join(rng.choice(letters, int(rng.integers(0, 90))))) for i in range(400)]
    rows += [(i, t) for i in range(400, 440) for t in ("x", "日", "<P", "a<S>b", "\U0001f600" * 3000)]
    rows += [(None, "no key é"), (None, "no key é"), (7, None), (8, ""), (9, "long é日 " * 200_000)]
    docs = spark.createDataFrame([(k, t, "n", 1, "o", "en") for k, t in rows], SCHEMA)
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    pick = lambda r: (-1 if r[0] is None else r[0], *(str(x) for x in r[1:]))
    assert sorted(pick((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == sorted(pick((k, *brute(k, t), t or "")) for k, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    none = spark.createDataFrame([], SCHEMA)
    assert fim.fill_in_middle(none).count() == 0


def test_rank_and_select():
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 3000):
        for part in (0.0, 0.03, 0.5, 1.0):
            flags = rng.random(size) < part
            bits = fim.Bits(flags)
            assert bits.total == flags.sum()
            assert bits.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(flags).tolist()]
            ones = np.flatnonzero(flags)
            assert bits.select(np.arange(len(ones) + 2)).tolist() == [*ones.tolist(), size, size]
