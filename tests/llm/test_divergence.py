"""The source audit against a plain version, with few documents wanted and with small blocks and tiles."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkwell.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, number int, vector string, n double"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, told):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(LOWER))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= told:
                        out.add((lang, s, part, item, value, rank))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["É", "é", "日本", "Straße", "K", "the"]
    found = []
    for i in range(240):
        lang = ("en", "de", None, "")[i % 4] if i % 11 else "fr"
        text = " ".join(rng.choice(words, int(rng.integers(0, 25)))) + (" 12 x-y_z@q The THE" if i % 3 else "")
        found.append((i, text, lang, f"s{rng.integers(0, 5)}" if i % 9 else None))
    found += [(900, None, "en", "blank"), (901, "", "xx", "alone"), (902, "12 34", "yy", "a"), (903, None, "yy", "b"), (904, "the " * 50_000, "en", "s1")]
    return found + found[:3]


@pytest.mark.parametrize(("block", "tile", "told"), [(4096, 256, 50), (3, 2, 2)])
def test_against_brute_force(spark, rows, block, tile, told):
    docs = spark.createDataFrame([(*r, "t", 1, "v", 0.5) for r in rows], SCHEMA).repartition(5)
    got = divergence.audit_sources(docs, least=6, told=told, block=block, tile=tile).collect()
    assert {tuple(r) for r in got} == brute(rows, 6, told) and len(got) == len({tuple(r) for r in got})


def test_gathering_in_small_parts(spark, rows, monkeypatch):
    """What a task sends on before its end adds up to the same."""
    monkeypatch.setattr(divergence, "GATHERED", 6)
    part = [r for r in rows if r[2] == "de"] + [(1000, None, "de", "zero")]
    docs = spark.createDataFrame([(*r, "t", 1, "v", 0.5) for r in part], SCHEMA)
    assert {tuple(r) for r in divergence.audit_sources(docs, least=4).collect()} == brute(part, 4, 50)


def test_shares_are_exact(spark):
    rng = np.random.default_rng(1)
    whole = rng.integers(1, 1 << 53, 300)
    count = (whole * rng.random(300)).astype(np.int64)
    want = [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole)]
    assert divergence.shares(count, whole).tolist() == want
    df = spark.createDataFrame(list(zip(count.tolist(), whole.tolist())), "c long, w long")
    assert [r[0] for r in df.select(divergence.share(divergence.F.col("c"), divergence.F.col("w"))).collect()] == want


def test_empty(spark):
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0
