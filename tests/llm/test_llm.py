"""Each operator against a brute-force version on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkwell.llm import fingerprints, html_text, langid, lm, mixing, packing, setjoin, token_store, topk, url_filter
from inkwell.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, bucket int, one string, rid int, block string"
EXTRA = ("x", 1, "y", 2, "z")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def make(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), *EXTRA) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


BASE = " ".join(f"word{i} and{i % 7}" for i in range(60))
ODD = [
    (0, "The quick  brown fox.\n\nIt's 12 o'clock… don’t\t stop! <|endoftext|> é ß 日本"),
    (1, None),
    (2, ""),
    (3, "   \n "),
    (4, BASE),
    (5, BASE),
    (6, BASE + " tail"),
    (7, BASE.replace("word3 ", "other ")),
    (8, "one two"),
    (9, "one two"),
    (10, "One"),
    (11, "x" * 5000 + " " + BASE * 40),
    (12, BASE + " A B C D E F G H I J K L M N"),
    (None, "row without key"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(docs, path, capacity=64).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for key, text in ODD:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = out[out.doc_id.isna() if key is None else out.doc_id == key].sort_values("piece")
        assert own.length.sum() == len(ids) and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert (own.length.iloc[1:] == 64).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_ids_survive(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(docs.where("doc_id IN (0, 4, 8)"), path, with_ids=True)
    joined = b"".join(r.ids for r in packing.sequences(out).collect())
    assert len(joined) == 4 * out.toPandas().length.sum()


def best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return bins


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.integers(1, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 200))).tolist()
        steps = packing.plan(dict(Counter(lengths)), capacity)
        used = {}
        for length, _, number, first, offset in steps:
            for b in range(first, first + number):
                assert used.get(b, 0) == offset
                used[b] = offset + length
        assert sum(n for _, _, n, _, _ in steps) == len(lengths)
        assert sorted(capacity - u for u in used.values()) == sorted(best_fit(lengths, capacity))


def test_token_files(spark, docs, empty):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "t")
    whole = docs.unionByName(docs.where("doc_id = 8"))
    manifest = token_store.write_tokens(whole, path, folder=folder, shards=3)
    out = token_store.read_tokens(whole, manifest, folder=folder, with_ids=True).toPandas()
    assert len(out) == len(ODD) + 1
    tokenizer, start = Tokenizer.from_file(path), 0
    for r in out.sort_values("start").itertuples():
        key = None if np.isnan(r.doc_id) else int(r.doc_id)
        ids = [*tokenizer.encode(dict(ODD)[key] or "", add_special_tokens=False).ids, 2]
        assert r.start == start and r.n_tokens == len(ids) and list(r.ids) == ids
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    strangers = spark.createDataFrame([(777,), (-5,)], "doc_id long")
    assert token_store.read_tokens(strangers, manifest, folder=folder).count() == 0
    manifest = token_store.write_tokens(empty, path, folder=scratch(spark, "t"))
    assert token_store.read_tokens(empty, manifest, folder=folder).count() == 0


def test_token_files_split_a_hot_key(spark):
    """The rows of one key go to several shards, and all are found again, in order."""
    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "t")
    rows = [(5, f"text {i % 40}") for i in range(400)] + [(None, "none")] * 60 + [(1, "first"), (9, "last " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("x"), "part": F.lit(1)})
    manifest = token_store.write_tokens(df, path, folder=folder, shards=6)
    assert manifest.where("first_key = 5 OR last_key = 5").count() > 1
    out = token_store.read_tokens(df, manifest, folder=folder, with_ids=True).collect()
    assert len(out) == len(rows) and Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    tokenizer, start = Tokenizer.from_file(path), 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    want = Counter(tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for _, t in rows)
    assert Counter(tuple(r.ids) for r in out) == want


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 64], 1, "s") for i in range(700)]
    bad = [(900, None, 1, "s"), (901, [None] * 8, 1, "s"), (920, [float("nan")] * 8, 1, "s"), (940, [float("inf")] * 8, 1, "s"), (None, [0.1] * 8, 1, "s"), (960, [1.0], 1, "s")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, shard string")
    out = topk.top_k(df, k=5, shards=3).toPandas()
    points = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(int)
    for i in range(0, 700, 20):
        score = points @ points[i]
        order = [j for j in np.lexsort((np.arange(700), -score)) if j != i][:5]
        own = out[out.query_id == i].sort_values("rank")
        assert own.vec_id.tolist() == order and own.score.tolist() == score[order].tolist()
    assert out.query_id.nunique() == 35
    assert topk.top_k(df.where("vec_id < 3"), k=20).count() == 2
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_repeats_ties_and_lengths(spark):
    """Against brute force: repeated rows and keys, ties, vectors of two lengths, vectors without components."""
    rng = np.random.default_rng(15)
    rows = [(int(i) % 150, [float(x) for x in rng.integers(-2, 3, 4 if i % 5 else 3) / 64], 1, "s") for i in range(400)]
    rows += [rows[3], rows[40], (20, [], 1, "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, width int, shard string")
    got = {}
    for r in topk.top_k(df, k=7, shards=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    points = [(i, np.floor(64 * np.array(v, np.float32)).astype(int)) for i, v, *_ in rows if v]
    for q in range(0, 150, 20):
        own = min(((len(v), v.tolist()) for i, v in points if i == q), default=None)
        want = sorted((-int(v @ own[1]), i) for i, v in points if i != q and len(v) == own[0])[:7]
        assert sorted(got[q]) == [(n, -s, i) for n, (s, i) in enumerate(want, 1)]


def test_ball_tree_visits_by_bound_and_heeds_the_floor():
    rng = np.random.default_rng(16)
    points, queries = rng.integers(-9, 10, (3000, 6)).astype(float), rng.integers(-9, 10, (40, 6)).astype(float)
    tree, none = topk.BallTree(points, np.arange(3000), leaf=32), np.full(40, -1)
    whole = np.sort(queries @ points.T, 1)[:, ::-1]
    score, _ = tree.search(queries, none, 5, np.full(40, -np.inf))
    assert (score == whole[:, :5]).all()
    score, _ = tree.search(queries, none, 5, whole[:, 2])
    assert (np.where(score >= whole[:, 2:3], score, 0) == np.where(whole[:, :5] >= whole[:, 2:3], whole[:, :5], 0)).all()


def test_url_rules(spark):
    urls = ["https://a.example.com/en/7x", "http://EXAMPLE.com/en/8", "http://xcom/en/1", "http://b.net/de/?q", "http://b.net/de", "http://example.net/de/80", "ftp://x.org/es/#f", None, "", "nonsense", "http://org/es/", "http://spam-farm.example.org/fr/", "x://h?y://z"]
    rules = (*(url_filter.place_rule(*g) for g in url_filter.GIVEN), *url_filter.OWN_RULES)
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert out[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert out[1] == ("example.com", "/en/8", "com/en/", "block")
    assert out[2] == ("xcom", "/en/1", None, "allow")
    assert out[3][2:] == ("net/de/", "allow") and out[4][2:] == (None, "allow")
    assert out[5][2:] == ("example.net/de/8", "block") and out[6][2:] == ("org/es/", "block")
    assert out[7] == out[8] == out[9] == ("", "", None, "allow")
    assert out[10][2:] == ("org/es/", "block") and out[11][2:] == (None, "block") and out[12][:2] == ("h", "")
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    odd = spark.createDataFrame([(None, urls[1]), (None, urls[1]), (5, "http://a.net/de/" + "x" * 300_000)], "page_id long, url string")
    assert sorted((r.page_id is None, r.verdict) for r in url_filter.judge_urls(odd, rules).collect()) == [(False, "allow"), (True, "block"), (True, "block")]


def test_own_url_rules():
    """The index finds what trying every rule finds."""
    index, rng = url_filter.RuleIndex(url_filter.OWN_RULES), np.random.default_rng(12)
    parts = ["casino", "cheap-pills", "pills", "example", "xxx", "spam-farm", "spam", "link", "farm", "www", "news"]
    paths = ["", "/", "/a.exe", "/exe", "/wp-login.php", "/cgi-bin/x", "/feed/", "/feeds", "/calendar/2024/01/", "/calendar/24", "/x;jsessionid=1", "/search", "/search/a", "/a.zip"]
    seen = set()
    for _ in range(3000):
        host = ".".join(rng.choice(parts, int(rng.integers(1, 4)))) + rng.choice([".com", "-shop.org", ".net"])
        url = host + rng.choice(paths)
        want = "block" if any(re.search(r.pattern, url) for r in url_filter.OWN_RULES) else "allow"
        assert index.judge(host, url[len(host) :]) == (None, want)
        seen.add(want)
    assert seen == {"allow", "block"}


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><ul><li><a>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p><b>First  line<br><p>Second\n line</p>
    <aside>Side</aside><form>Mail <input></form><p>Be.</p></article><section id="comments"><p>Nice!</p></section><footer>&copy; me</footer>"""
    plain = "<body><div class=menu><a>a</a><a>b</a></div><div><p>" + "Long text. " * 30 + "</p><p>Short.</p></div><footer>f</footer></body>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", plain), (4, "w", plain)], "page_id long, url string, html string")
    out = html_text.extract_text(df).collect()
    got = {r.page_id: r for r in out}
    assert got[1].text == "Head & more\n\nFirst line\n\nSecond line\n\nBe." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].url is None
    assert got[4].text == ("Long text. " * 30).strip() + "\n\nShort." and len(out) == 5


LONG = "Plain words that tell a story, one after another, without any links between them. " * 4
MENU = "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(12))


def test_html_region_without_article():
    """One long section and several short ones, a headline in a box of its own, and a menu that nothing marks as one."""
    short = "".join(f"<section><h2>Part {i}</h2><p>Short part {i}.</p></section>" for i in range(3))
    page = f"<body><div><ul>{MENU}</ul></div><div><div><h1>Headline</h1></div><section><p>{LONG}</p><p>{LONG}</p></section>{short}</div></body>"
    want = ["Headline", LONG.strip(), LONG.strip(), *(x for i in range(3) for x in (f"Part {i}", f"Short part {i}."))]
    assert html_text.main_text(page).split("\n\n") == want


def test_html_headline_beside_the_body_of_an_article():
    page = f"<body><article><div><h1>Headline</h1></div><div><p>{LONG}</p><p>Short.</p><div>{MENU}</div></div></article><div><p>Teaser beside it.</p></div></body>"
    # The box that holds nothing but links is no text of the article, with or without a mark.
    assert html_text.main_text(page).split("\n\n") == ["Headline", LONG.strip(), "Short."]
    listed = page.replace("<div><li>", "<ul><li>").replace("</li></div>", "</li></ul>")
    assert html_text.main_text(listed).split("\n\n")[3:] == [f"Entry {i}" for i in range(12)]


def test_html_ratios_decide_on_marked_pages():
    """An article element that only lists links loses to dense text elsewhere; other ratios give another region."""
    page = html_text.page_lines(f"<body><article><ul>{MENU}</ul></article><div><p>{LONG}</p><p>{LONG}</p><p>End.</p></div></body>")
    ratios = html_text.line_ratios(page)
    assert [x.text for x in html_text.content_lines(page, ratios)] == [LONG.strip(), LONG.strip(), "End."]
    turned = [max(ratios) - r for r in ratios]
    assert [x.text for x in html_text.content_lines(page, turned)] == [f"Entry {i}" for i in range(12)]


def test_html_ratios_smoothing_and_clusters():
    rng = np.random.default_rng(6)
    values = rng.gamma(1.0, 20.0, 30).tolist()
    kernel = np.exp(-(np.arange(-2, 3) ** 2) / 2)
    want = np.convolve(values, kernel, "same") / np.convolve(np.ones(30), kernel, "same")
    assert np.allclose(html_text.smoothed(values), want)
    logs = np.log1p(want)
    cut = logs.mean()
    for _ in range(50):
        cut = (logs[logs < cut].mean() + logs[logs >= cut].mean()) / 2
    assert html_text.dense_lines(values) == (logs >= cut - 1e-9).tolist()
    page = html_text.page_lines("<p>abcd <a>ef</a></p><article><p><b>12345678</b></p></article>")
    assert [(x.text, x.linked, x.tags) for x in page.lines] == [("abcd ef", 2, 4), ("12345678", 0, 4)]
    assert html_text.line_ratios(page) == [5 / 4, 2 * html_text.EVIDENCE]


def test_html_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    long = "<body><article><p>" + "word " * 200_000 + "</p></article>"
    df = spark.createDataFrame([(None, "u", "<p>a</p>", "x", "y"), (None, "u", "<p>a</p>", "x", "y"), (1, "u", long, "x", "y"), (2, "u", "<b>&amp;&nbsp;x", "x", "y"), (3, "u", "<p", "x", "y")], schema)
    out = html_text.extract_text(df).collect()
    assert [r.text for r in out if r.page_id is None] == ["a", "a"] and {r.page_id: r.n_chars for r in out}[1] == 5 * 200_000 - 1
    assert {r.page_id: r.text for r in out}[2] == "& x" and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert html_text.extract_text(df.limit(0)).count() == 0


def shingles(text, width):
    w = word_list(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard_brute(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("chunk", [4, 512])
def test_jaccard_long_lists(spark, monkeypatch, chunk):
    """Lists whose members share nearly all elements and mostly don't link: pairs of chunks, all components found."""
    monkeypatch.setattr(setjoin, "CHUNK", chunk)
    rng = np.random.default_rng(21)
    texts = []
    for i in range(110):
        group = int(rng.integers(0, 3))
        own = rng.choice(48, int(rng.integers(34, 44)), replace=False)
        texts.append((i, " ".join(f"g{group if x < 8 else 0}x{x}" for x in own)))
    texts += [(200 + i, texts[i][1]) for i in range(40)] + [(3, "another text of a key that is there already")]
    df = make(spark, texts[:-1])
    sets = {i: shingles(t, 1) for i, t in texts[:-1]}
    want = jaccard_brute(sets, 80)
    assert 3 < len(set(want.values())) < 100
    got = {r.doc_id: r.component_id for r in setjoin.jaccard_components(df, width=1, percent=80).collect()}
    assert got == want


def test_jaccard_repeated_keys(spark):
    """Rows of one key are one document: what links with one of them links with all."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " tail"), (9, b + " tail"), (9, b + " tail"), (11, "alone " * 3), (None, a)]
    out = [(r.doc_id, r.component_id) for r in setjoin.jaccard_components(make(spark, rows), width=3, percent=80).collect()]
    assert sorted(out, key=str) == sorted([(5, 5), (5, 5), (7, 5), (9, 5), (9, 5), (11, 11), (None, None)], key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 90)])
def test_jaccard_components(spark, docs, empty, width, percent):
    rng = np.random.default_rng(8)
    texts = [t for t in ODD if t[0] is not None]
    for size in [8, 9, 10, 11, 17, 18, 19, 20, 21, 40, 100]:
        base = [f"w{size}x{i}" for i in range(size + width - 1)]
        for _ in range(8):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = f"e{rng.integers(0, 1 << 30)}"
            texts.append((len(texts) + 20, " ".join(own[int(rng.integers(0, 2)) :])))
    df = make(spark, texts)
    out = {r.doc_id: r for r in setjoin.jaccard_components(df, width=width, percent=percent).collect()}
    sets = {i: shingles(t, width) for i, t in texts}
    assert {i: r.component_id for i, r in out.items()} == jaccard_brute(sets, percent)
    assert {i: r.n_shingles for i, r in out.items()} == {i: len(s) for i, s in sets.items()}
    if width == 3:
        assert setjoin.jaccard_components(docs).where("doc_id IS NULL").first().component_id is None
        assert setjoin.jaccard_components(empty).count() == 0


def test_boundary_moves_with_the_histogram():
    rule = setjoin.Rule(90)
    assert setjoin.boundary({12: 1000}, rule) > 12 >= 1
    assert setjoin.boundary({30: 1000}, rule) <= 30


def test_fingerprints(spark, empty):
    texts = [(i, t) for i, t in ODD if i is not None]
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(make(spark, texts)).collect()}
    order = sorted(texts, reverse=True)
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[i].n_chars == len(text) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (Counter(x.lower().split()) for x in (text, edited))
        true = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
        assert abs(out[i].near_edited - true) < 0.35
    assert out[4].fingerprint == out[5].fingerprint and out[1].fingerprint == out[2].fingerprint
    assert out[5].near_next == 1.0 and out[2].near_next == 1.0 and out[9].near_next == 1.0
    assert fingerprints.fingerprint_edits(empty).count() == 0
    again = fingerprints.fingerprint_edits(make(spark, [*texts, (8, "one two"), (None, "a b")])).toPandas()
    assert len(again) == len(texts) + 2 and again[again.doc_id.isna()].near_next.tolist() == [1.0]


def test_next_lower(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "PER_BUCKET", 40)
    keys = sorted({*(int(x) for x in np.random.default_rng(4).integers(-1000, 1000, 500)), 1 << 62, -(1 << 62)})
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = dict(fingerprints.next_lower(df, "k", len(keys)).collect())
    assert got == dict(zip(keys, [None, *keys[:-1]]))


def test_fingerprints_estimate_jaccard(spark):
    """Over many pairs, likeness has the mean and the spread of a binomial share of the true weighted Jaccard similarity."""
    rng = np.random.default_rng(11)
    texts = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(20, 200))) % (30 + i % 50))) for i in range(500)]
    out = {r.doc_id: r for r in fingerprints.fingerprint_edits(make(spark, texts)).collect()}
    off, spread = [], []
    for i, text in texts:
        for name, other in (("near_edited", text[: len(text) - len(text) // 2] + texts[i - 1][1][: len(text) // 2]), ("near_next", texts[i - 1][1])):
            a, b = Counter(text.split()), Counter(other.split())
            true = sum((a & b).values()) / sum((a | b).values())
            off.append(getattr(out[i], name) - true)
            spread.append(true * (1 - true) / fingerprints.SLOTS)
    assert abs(np.mean(off)) < 4 * (np.mean(spread) / len(off)) ** 0.5 + 0.004
    assert 0.85 < np.mean(np.square(off)) / np.mean(spread) < 1.15


def lm_brute(texts, held, mu):
    """Scores by the model's formulas on plain counters: no states, no arcs."""
    tokens = {i: [*word_list(t), "</>"] for i, t in texts}
    uni, bi, tri, starts = Counter(), Counter(), Counter(), 0
    for i, w in tokens.items():
        if not held[i]:
            uni.update(w)
            bi.update(zip(["<>", *w], w))
            tri.update(zip(["<>", *w], w, w[1:]))
            starts += 1
    total, out = sum(uni.values()), {}
    for i, w in tokens.items():
        base = [(uni[t] + 1) / (total + len(uni) + 1) for t in w]
        path = []
        for n, t in enumerate(w):
            h = w[n - 1] if n else "<>"
            p = (bi[h, t] + mu[0] * base[n]) / ((uni[h] if n else starts) + mu[0])
            if n:
                g = w[n - 2] if n > 1 else "<>"
                p = (tri[g, h, t] + mu[1] * p) / (bi[g, h] + mu[1])
            path.append(p)
        out[i] = (len(w), sum(uni[t] > 0 for t in w), total, np.log10(base).sum(), np.log10(path).sum())
    return out


def test_lm_scores(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "WALK", 7)  # walkers that start within a text must reach the state of one that reads it all
    rng = np.random.default_rng(9)
    texts = [*ODD, *[(100 + i, " ".join(f"v{int(x)}" for x in rng.zipf(1.3, int(rng.integers(0, 90))) % 40)) for i in range(60)], (30, BASE), (31, "Unseen words only here")]
    out = {r.doc_id: r for r in lm.score_texts(make(spark, texts), mu=(3.0, 2.0)).collect()}
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    for i, (n, known, total, base, score) in lm_brute(texts, held, (3.0, 2.0)).items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
    assert lm.score_texts(empty).count() == 0
    # Nothing to learn from: every token has probability 1.
    only = lm.score_texts(docs.where("doc_id IS NULL")).first()
    assert only.train_tokens == 0 and only.base_score == only.score == 0.0


def test_lm_repeated_rows_and_keys(spark):
    rows = [(1, "a b a b"), (1, "a b a b"), (1, "b a"), (3, None)]
    out = lm.score_texts(make(spark, rows)).collect()
    assert len(out) == 4 and len({r.score for r in out if r.n_tokens == 5}) == 1
    assert {r.train_tokens for r in out} == {sum(r.n_tokens for r in out if not r.held_out)}


def test_lm_states_are_distributions():
    """From any state, the probabilities of all words (and of one unknown word) add up to 1."""
    import pyarrow as pa

    texts = ["a b a c", "b a b", "c c a b a", "z"]
    block = lm.Block(pa.chunked_array([pa.array(texts)]))
    training = np.array([True, True, True, False])[block.row]
    counts = [np.bincount(at[at >= 0], weights=training[at >= 0], minlength=len(k)) for k, at in block.kinds()]
    machine = lm.Automaton(block, *counts, int(counts[0].sum()), int((counts[0] > 0).sum()), 3, (3.0, 2.0))
    for state in range(len(machine.fail)):
        _, weight = machine.step(np.full(len(block.words), state), np.arange(len(block.words)))
        # Nothing follows the end of a text, so states that end with it are never left.
        end = machine.of_word[block.words == lm.END][0]
        assert end in (state, machine.fail[state]) or abs((10**weight).sum() - 1) < 1e-9


def test_language_id(spark, empty):
    say = {"en": "the cat and the dog went to the house with them ", "de": "der hund und die katze gingen nicht nach hause ", "fr": "le chat et les chiens sont dans la maison avec nous ", "es": "el gato y los perros no estan en la casa con ellos "}
    rows = [(i, " ".join(np.random.default_rng(i).permutation((say[c] * 3).split())), c) for i, c in enumerate(list(say) * 40)]
    texts = [(i, t) for i, t, _ in rows] + [(500, None), (501, ""), (502, "123 !!! 456"), (None, say["de"])]
    df = make(spark, texts, {i: c for i, _, c in rows})
    out = langid.identify(df).collect()
    got = {r.doc_id: r for r in out}
    assert set(df.columns) <= set(out[0].asDict()) and len(out) == len(texts)
    assert np.mean([got[i].lang_pred == c for i, _, c in rows if got[i].held_out]) > 0.95
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0
    assert got[None].held_out and got[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in out)
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(1, 0))).where("doc_id >= 500").collect()} <= {"und", ""}


def test_language_sample_holds_every_language(spark):
    """A language with few rows among very many others is learned; repeated rows are one; the sample keeps its bound."""
    rows = [(i, f"the text {i}", "en") for i in range(9000)] + [(10_000 + i, f"y testun {i}", "cy") for i in range(5)] + [(10_000, "y testun 0", "cy")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r.lang for r in langid.choose(df, "text", "lang", "doc_id").collect()]
    assert got.count("cy") == 5 and abs(got.count("en") - langid.SAMPLE / 2) < 5 * langid.SAMPLE**0.5


def test_language_margins_are_the_machines(spark):
    """Predictions off running sums against the machines' votes by plain products, text by text."""
    import pyarrow as pa

    say = {"en": "the cat and the dog went to the house", "de": "der hund und die katze gingen nach hause", "nl": "de hond en de kat gingen naar huis", "fr": "le chat et les chiens sont dans la maison"}
    texts = [" ".join(np.random.default_rng(i).permutation((say[c] * 2).split())) for i, c in enumerate(list(say) * 12)]
    langs = np.array(list(say) * 12, dtype=object)
    column = pa.array(texts)
    x = langid.vectors(column)
    model = langid.Identifier(x, langs)
    names, score = model.predict(column)

    def vote(machine, row):
        confidence = dict.fromkeys(machine.classes, 0.0)
        for w, (i, j) in zip(machine.weights, machine.pairs):
            p = 1 / (1 + np.exp(np.clip(-3.0 * float(w.astype(float) @ row), -60, 60)))
            confidence[machine.classes[i]] += p
            confidence[machine.classes[j]] += 1 - p
        best = max(machine.classes, key=lambda c: confidence[c])
        return best, confidence[best] / (len(machine.classes) - 1) if machine.pairs else 1.0

    for i, row in enumerate(x.astype(float)):
        family, sure = vote(model.family, row)
        lang, inner = vote(model.within[model.family.classes.index(family)], row)
        assert names[i] == lang and abs(score[i] - sure * inner) < 1e-4
    assert (names == langs).mean() > 0.95


def test_language_of_repeated_rows_and_long_texts(spark):
    rows = [(i, "the cat and the dog ", "en") for i in range(20)] + [(20 + i, "le chat et le chien ", "fr") for i in range(20)] + [(7, "le chat ", None)] * 3 + [(99, "le chat et le chien " * 20_000, None), (None, None, None)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out if r.lang is None and r.text} == {"fr"} and [r.lang_pred for r in out if r.text is None] == ["und"]


def test_mixing(spark, empty):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), ["en", "de", None][int(rng.integers(0, 3))], f"s{int(rng.integers(0, 4) ** 2 % 5)}", 0, *EXTRA) for i in range(3000)]
    df = spark.createDataFrame([*rows, (9000, None, "en", "s0", 0, *EXTRA), (9001, "", "en", "s0", 0, *EXTRA)], SCHEMA)
    targets = {"source": {"s0": 0.25, "s1": 0.5}, "lang": {"en": 0.5, "de": 0.25}}
    cells = {}
    for r in rows:
        cells[r[3], r[2] or mixing.NONE] = cells.get((r[3], r[2] or mixing.NONE), 0) + len(r[1].split())
    fitted = mixing.rake(spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, tokens long"), targets).toPandas()
    fitted["t"] = fitted.tokens * fitted.weight / fitted.tokens.sum()
    shares = fitted.groupby("source").t.sum()
    assert abs(shares["s0"] - 0.25) < 1e-3 and abs(shares["s1"] - 0.5) < 1e-3
    assert abs(fitted.groupby("lang").t.sum()["en"] - 0.5) < 1e-9
    # Weights are products of factors of the margins: cross ratios stay 1.
    w = fitted.set_index(["source", "lang"]).weight
    assert abs(w["s0", "en"] * w["s1", "de"] / (w["s0", "de"] * w["s1", "en"]) - 1) < 1e-9
    kept = mixing.mix_documents(df, targets).toPandas()
    assert kept.doc_id.is_unique and not set(kept.doc_id) & {9000, 9001} and kept.probability.max() <= 1
    assert abs(kept.n_tokens.sum() / sum(cells.values()) - mixing.SIZE) < 0.05
    assert abs(kept[kept.source == "s1"].n_tokens.sum() / kept.n_tokens.sum() - 0.5) < 0.08
    assert mixing.mix_documents(df, mixing.TARGETS, keep=df.columns).columns[: len(df.columns)] == df.columns
    assert mixing.mix_documents(empty, mixing.TARGETS).count() == 0
    odd = [(None, "w w", "en", "s0", 0, *EXTRA)] * 2 + [(7, "w " * 5, None, None, 0, *EXTRA)] * 3 + [(8, "w " * 200_000, "en", "s1", 0, *EXTRA)]
    got = mixing.mix_documents(spark.createDataFrame(odd, SCHEMA), {"source": 1.0}, size=1.0).toPandas()
    assert len(got) == 6 and got.n_tokens.max() == 200_000 and got[got.doc_id == 7].source.isna().all()


def rake_brute(cells, targets, size, rounds=400):
    """Bounded raking on a dict (categories -> tokens), margin after margin; targets are shares by category."""
    total = sum(cells.values())
    weight = dict.fromkeys(cells, size)
    for _ in range(rounds):
        for m, shares in enumerate(targets):
            have = Counter()
            for c, n in cells.items():
                have[c[m]] += n * weight[c]
            for c in cells:
                weight[c] = min(1.0, weight[c] * shares[c[m]] * size * total / have[c[m]])
    return weight


@pytest.mark.parametrize("size", [0.3, 0.6])
def test_bounded_raking(spark, size):
    """Against brute force, where a rare category can and can't give what its target asks for."""
    rng = np.random.default_rng(4)
    cells = {(f"s{i}", f"l{j}"): int(rng.integers(50, 5000)) for i in range(6) for j in range(3)}
    cells |= {("rare", "l0"): 40, ("rare", "l2"): 3}
    total = sum(cells.values())
    have = [Counter(), Counter()]
    for c, n in cells.items():
        for m in (0, 1):
            have[m][c[m]] += n
    powers = (0.5, 0.7)
    targets = [{k: n**p / sum(x**p for x in have[m].values()) for k, n in have[m].items()} for m, p in enumerate(powers)]
    want = rake_brute(cells, targets, size)
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, tokens long")
    fitted = mixing.rake(df, {"source": 0.5, "lang": 0.7}, size)
    got = {(r.source, r.lang): r.weight for r in fitted.collect()}
    assert max(got.values()) <= 1.0 and want["rare", "l2"] == got["rare", "l2"] == 1.0
    assert all(abs(got[c] - w) < 0.01 for c, w in want.items())
    kept = sum(n * got[c] for c, n in cells.items()) / total
    assert abs(kept - size) < 0.02
    shares = {(r.margin, r.category): (r.target, r.share) for r in mixing.reached(fitted, {"source": 0.5, "lang": 0.7}).collect()}
    assert shares["source", "rare"][1] < shares["source", "rare"][0] and abs(shares["lang", "l1"][0] - shares["lang", "l1"][1]) < 0.01


def test_targets_within_reach(spark):
    """No tempered target passes what its category has; what is missing goes to the others in proportion."""
    rng = np.random.default_rng(3)
    for size in (0.1, 0.5, 0.9, 1.0):
        held = {f"c{i}": int(x) for i, x in enumerate(rng.zipf(1.4, 9) * 10)}
        total = sum(held.values())
        share = {k: n**0.3 for k, n in held.items()}
        most = {k: n / total / size for k, n in held.items()}
        full = set()
        while True:  # give all to whoever asks for more, until nobody does
            rest = (1 - sum(most[k] for k in full)) / max(1e-300, sum(s for k, s in share.items() if k not in full))
            more = {k for k in share if k not in full and share[k] * rest > most[k] * (1 + 1e-12)}
            if not more:
                break
            full |= more
        want = {k: most[k] if k in full else share[k] * rest for k in share}
        df = spark.createDataFrame([(k, n) for k, n in held.items()], "m string, tokens long")
        got = {r.m: r.target for r in mixing.target_shares(df, "m", 0.3, size).collect()}
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and abs(sum(got.values()) - 1) < 1e-9


def test_topics_are_clusters(spark):
    """Centres and clusters against a plain version, in whole numbers."""
    rng = np.random.default_rng(5)
    kinds = ["plain words go on and on here. ", "12 34 5678 90 figures 7 ", "a | b | c\t| d | ", "<p>{x}=[y]#&% </p> ", "LOUD WORDS ARE HERE ", "Item\nOther\nThird\n"]
    texts = [kinds[int(i)] * int(rng.integers(1, 20)) + kinds[0] * int(rng.integers(0, 3)) for i in rng.integers(0, 6, 300)] + [None, "", " "]
    marks = list(mixing.FORM.values())
    python = [m.replace(r"\p{Lu}", "[A-Z]") for m in marks]
    points = [None if t is None else [int(np.floor(1000 * (len(re.findall(m, t)) / max(1, len(t))) ** 0.5 + 0.5)) for m in python] for t in texts]
    centres = {k: tuple(map(float, v)) for k, v in mixing.TOPICS.items()}
    near = lambda p: min(centres, key=lambda k: (sum((a - b) ** 2 for a, b in zip(p, centres[k])), k))
    for _ in range(mixing.MOVES):
        groups = {}
        for p in points:
            if p is not None:
                groups.setdefault(near(p), []).append(p)
        centres = centres | {k: tuple(sum(c) / len(ps) for c in zip(*ps)) for k, ps in groups.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("form", mixing.form_of(F.col("text")))
    assert [r.form for r in df.sort("i").collect()] == points
    got = mixing.topic_centres(df)
    assert all(np.allclose(got[k], centres[k]) for k in centres)
    named = [r.t for r in df.sort("i").select(mixing.nearest(F.col("form"), got).alias("t")).collect()]
    assert named[:-3] == [near(p) for p in points[:-3]] and len(set(named[:-3])) >= 5


def test_slow_fitting_goes_on_and_contradictions_are_told(spark):
    """A chain of cells through which shares travel slowly is fitted to the end; targets that contradict each other end early."""
    rows = [(f"a{i}", f"b{j}", 1000) for i in range(8) for j in (i, i + 1) if j < 8]
    df = spark.createDataFrame(rows, "a string, b string, tokens long")
    targets = {"a": {f"a{i}": (1 + i) / 36 for i in range(8)}, "b": {f"b{i}": (1.3 if i % 2 else 0.7) * (1 + i) / 36.6 for i in range(8)}}
    with pytest.warns(UserWarning, match="can't be met|had not ended"):
        mixing.rake(spark.createDataFrame([("x", "u", 10), ("y", "v", 10)], "a string, b string, tokens long"), {"a": {"x": 0.9, "y": 0.1}, "b": {"u": 0.1, "v": 0.9}}, 0.5)
    fitted = mixing.rake(df, {"a": 0.5, "b": 0.3}, 0.4)
    off = [abs(r.share / r.target - 1) for r in mixing.reached(fitted, {"a": 0.5, "b": 0.3}, 0.4).collect()]
    assert max(off) < 2 * mixing.TOLERANCE and targets


def test_prior_weights_solve_their_equation(spark):
    """Against counters: with one occurrence left out, priors take as much as there are n-grams that occur once."""
    rng = np.random.default_rng(21)
    texts = [(i, " ".join(f"v{int(x) % 60}" for x in rng.zipf(1.4, 40))) for i in range(80)]
    uni, bi, tri, seen = Counter(), Counter(), Counter(), []
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [*word_list(t), "</>"]
            uni.update(w)
            bi.update(zip(["<>", *w], w))
            tri.update(zip(["<>", *w], w, w[1:]))
    real = lm.prior_weight
    lm.prior_weight = lambda answers, kind: seen.append(real(answers, kind)) or seen[-1]
    try:
        lm.score_texts(make(spark, texts)).count()
    finally:
        lm.prior_weight = real
    for weight, history, grams in zip(seen, (uni, bi), (bi, tri)):
        ones = sum(n == 1 for n in grams.values())
        mass = sum(c * weight / (c - 1 + weight) for c in history.values())
        assert len(seen) == 2 and abs(mass / ones - 1) < 0.02
