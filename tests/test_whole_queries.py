"""Registered queries over whole tables and whole texts, against brute force on a few documents."""

import datetime
import itertools
import random
import unicodedata
from collections import Counter

import pytest

from inkwell.functions import text as X
from inkwell.operators import history
from inkwell.plans import queries as Q

LONG = "Größe und Maß der Änderung, naïve façade " * 9
#: Texts with accents, lines beyond 80 characters, pages beyond the second, and lines that repeat on a page.
TEXTS = [
    "Überschrift hier\nkurz\nKopfzeile Straße\n" + LONG + "\nkurz\nkurz\nfin\nl'été\nSTRASSE\nx\nab\nzwölfte Zeile mit mehr als dreißig Zeichen",
    "plain first line of the document, long enough\nKopfzeile Straße\nKopfzeile  Straße\nend\n\nend\nend\n" + LONG + "z",
    "Kopfzeile Straße\n" + "a b c d e f g h " * 20 + "\nOverview Section\nOverview Section\nOverview Section",
    "Overview Section\nsecond\nthird\nfourth\nfifth\nsixth ß\nseventh\neighth\nninth\ntenth\neleventh ſ line that is longer than thirty",
    "Overview Section\nKopfzeile Straße",
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i + 4, t, "de", "s", len(t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def documents():
    return {i + 4: t for i, t in enumerate(TEXTS)}


def all_lines():
    """(doc_id, pos, page, idx, text) of every line."""
    return [(d, i, 1 + i // 5, 1 + i % 5, x) for d, t in documents().items() for i, x in enumerate(t.split("\n"))]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choices("abé𝄞", k=rng.randrange(n))) for n in (90, 70))
        assert X.edit_distance(a, b) == distance(a, b)
    for a, b in itertools.product(["", "a", "ab", "ba", "é"], repeat=2):
        assert X.edit_distance(a, b) == distance(a, b)


def test_cer_pairs(spark, sf_dir):
    docs = documents()
    want = {d: distance(t, docs[d + 1]) for d, t in docs.items() if d + 1 in docs}
    got = {r.doc_id: r for r in Q.cer_pairs(spark, sf_dir).collect()}
    assert {d: r.edits for d, r in got.items()} == want
    assert all(got[d].rate == pytest.approx(n / len(docs[d + 1])) and got[d].score == pytest.approx(max(0, 1 - n / len(docs[d + 1]))) for d, n in want.items())


def test_page_evaluation(spark, sf_dir):
    want = {}
    for d, t in documents().items():
        parts = t.split("\n")
        truth = ["\n".join(parts[i : i + 5]) for i in range(0, len(parts), 5)]
        mark = " x" if d % 3 == 0 else ""
        read = [p.strip() + mark if (d + n) % 10 else None for n, p in enumerate(truth, 1)]
        ref, cand = "\n\n".join(p.strip() for p in truth), "\n\n".join(p for p in read if p is not None)
        want[d] = (len(truth), sum(p is not None for p in read) / len(truth), distance(cand, ref))
    got = {r.document: (r.pages, pytest.approx(r.success_rate), r.cer.edits) for r in Q.page_evaluation(spark, sf_dir).collect()}
    assert got == want


def test_evidence(spark, sf_dir):
    fold = lambda s: " ".join(unicodedata.normalize("NFC", s).split()).casefold()
    want = {}
    for d, pos, _, _, text in all_lines():
        quote = "zzz" if d % 5 == 0 else text[2:22].upper()
        known = d % 7 != 0
        want[d, f"/data/{pos + 1}"] = (known, known and fold(quote) != "" and fold(quote) in fold(text))
    got = [((r.doc_id, r.path), (r.known_ids, r.trusted)) for r in Q.evidence_grounding(spark, sf_dir).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert any(ok for (d, path), (_, ok) in want.items() if path == "/data/9" and d == 4)  # STRASSE, on page 2
    bare = sorted((r.doc_id, r.path) for r in Q.uncovered_leaves(spark, sf_dir).collect())
    assert bare == sorted(k for k, (_, ok) in want.items() if not ok)


def text_lines():
    return [x for x in all_lines() if x[4] != ""]


def overlap(a, b):
    """Of two lines of one text: equally wide, ten high."""
    high = max(0, 10 - abs(a - b))
    return high / (20 - high)


def test_peer_blocks(spark, sf_dir):
    signed = {(d, " ".join(unicodedata.normalize("NFC", x).split())) for d, _, _, _, x in all_lines()}
    on = Counter(s for _, s in signed)
    want = {(d, s, on[s] - 1) for d, s in signed if len(s) >= 8 and not any(c.isdigit() for c in s) and on[s] > 2}
    got = [tuple(r) for r in Q.peer_blocks(spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want and "Kopfzeile Straße" in {s for _, s, _ in want}


def test_selected_pages_and_pixels(spark, sf_dir):
    want = Counter((d, p) for d, _, p, _, _ in all_lines() if p <= 3)
    assert {(r.doc_id, r.page): r.n for r in Q.selected_pages(spark, sf_dir).collect()} == want
    moved = Counter((d, p, 72.0, 72.0 + (i - 1) * 24) for d, _, p, i, _ in all_lines())
    assert Counter(tuple(r) for r in Q.point_to_pixel(spark, sf_dir).collect()) == moved


def test_catalog_provenance(spark, sf_dir):
    want = {}
    for d, _, p, i, x in text_lines():
        reads = [12 * (n - i) for e, pos, q, n, y in text_lines() if (e, q, y.strip()) == (d, p, x.strip()) and (d + pos) % 3]
        hit = any(overlap(0, r) >= 0.35 for r in reads)
        want[d, f"p{p}-l{i:04d}"] = ("repair_400" if d % 4 == 0 else "ocr_300") if hit else "native"
    got = [((r.doc_id, r.id), r.source) for r in Q.catalog_provenance(spark, sf_dir).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_greedy_grounding(spark, sf_dir):
    want = set()
    for d, p, x in {(d, p, x) for d, _, p, _, x in text_lines()}:
        free = [i for e, _, q, i, y in text_lines() if (e, q, y) == (d, p, x)]
        for cand in list(free):
            best = max(free, key=lambda r: (overlap(12 * r + 12, 12 * cand), -r))
            free.remove(best)
            want.add((d, p, x, best, cand, overlap(12 * best + 12, 12 * cand)))
    got = [tuple(r) for r in Q.greedy_grounding(spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_history_upsert_meets_stored_rows(spark, tmp_path, monkeypatch):
    rows = [(i, datetime.datetime(2024, 1, 1 + day), user, "{}") for i, (user, day) in enumerate([(1, 0), (1, 9), (2, 1), (2, 2), (3, 8), (3, 7), (4, 9), (4, 9)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    sides, upsert = [], history.upsert

    def seen(stored, new, order):
        sides.append((stored.count(), new.count()))
        return upsert(stored, new, order)

    monkeypatch.setattr(Q.history, "upsert", seen)
    got = {r.artifact_id: r.event_id for r in Q.history_upsert(spark, str(tmp_path)).collect()}
    assert sides == [(3, 5)] and got == {"a0001": 1, "a0002": 3, "a0003": 4, "a0004": 7}


def test_new_rows_go_before_later_stored_rows(spark):
    kind = "artifact_id string, created_at long, n int"
    stored = spark.createDataFrame([("a", 9, 1), ("b", 1, 2)], kind)
    new = spark.createDataFrame([("a", 3, 3), ("a", 2, 4), ("c", 1, 5)], kind)
    assert {r.artifact_id: r.n for r in history.upsert(stored, new).collect()} == {"a": 3, "b": 2, "c": 5}
