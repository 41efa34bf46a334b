import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions import pointers as P
from inkwell.functions import text as X
from inkwell.sources import files


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_inline_and_markdown(spark):
    got = values(spark, [("  á\x1c b\n c ", " x \r\ny  z \n\n")], "a string, b string", X.normalize_inline(F.col("a")), X.normalize_markdown(F.col("b")))
    assert got == [("á b c", "x\ny\n z")]


def test_anomalies(spark):
    rows = [("[ILLEGIBLE_TEXT]",), ("a�",), ("a\x07b",), ("--------",), ("a\tb\nc",), ("-------",), ("fine",)]
    assert [r[0] for r in values(spark, rows, "t string", X.has_anomaly(F.col("t")))] == [True] * 4 + [False] * 3
    assert values(spark, [(0.9,), (0.8999,)], "c double", X.is_low_confidence(F.col("c"))) == [(False,), (True,)]


def test_cer_and_headings(spark):
    (c,) = values(spark, [("axc", "abc"), ("", "")], "a string, b string", X.cer(F.col("a"), F.col("b")))[0]
    assert (c.edits, c.rate, c.score) == (1, pytest.approx(1 / 3), pytest.approx(2 / 3))
    (h,) = values(spark, [("# One \ntext\n### Two\n####### no",)], "t string", X.headings(F.col("t")))[0]
    assert [tuple(x) for x in h] == [(1, "One"), (3, "Two")]


def test_tables():
    text = "| A | B |\n|---|---|\n| 1 | 2 |\n\n<table><tr><th>x &amp; y</th></tr></table>\n| A |\n|---|\n| 1 |"
    assert X.parse_tables(text) == [[["x & y"]], [["A", "B"], ["1", "2"]]]


def test_tables_keep_empty_parts_and_compose_entities():
    html = "<TABLE><tr></tr><tr><td>e&#769;  x</td><th>b</tr></table><table></table><td>stray</td>"
    assert X.parse_tables(html) == [[[], ["é x"]], []]
    nested = "<table><tr><td>outer<table><tr><td>inner</td></tr></table></td></tr></table>"
    assert X.parse_tables(nested) == [[["inner"]]]
    pipes = "|a|b|\n|--|---|\n| c | d\n:---|:---:\n e\u0301 | f |\n   \n|x|\n|---|\n|g|h|\n|---|---|"
    assert X.parse_tables(pipes) == [[["c", "d"], ["é", "f"]], [["g", "h"]]]
    again = "|a|b|\n|---|---|\n|c|d|\n|---|---|\n|e|f|"
    assert X.parse_tables(again) == [[["a", "b"], ["c", "d"], ["---", "---"], ["e", "f"]]]


def test_visible_text():
    md = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n- x\n- y\n\n```\nfew    blanks\n```\n<script>alert(\"x\")</script>"
    assert X.visible(X.markdown_html(md)) == 'a\tb\n1\t2\n3\t4\n\n• x\n\n• y\n\nfew    blanks\n\n<script>alert("x")</script>'
    assert X.visible("<head><title>t</title></head><script>var a='<p>'</script><!-- c --><p>a &amp; b<br>c</p>") == "a & b\nc"


def test_only_whole_references_are_decoded():
    assert X.visible("<p>ver&amp</p><p>a&ltb &notit; &copy;&#39;&#x27;&eacute;&amp;lt; &nope;</p>") == "ver&amp\na&ltb &notit; ©''é&lt; &nope;"


def test_two_places(spark):
    got = values(spark, [(2.675, 0.125), (72.0, 1e-3)], "a double, b double", X.two_places(F.col("a")), X.two_places(F.col("b")))
    assert [tuple(r) for r in got] == [("2.67", "0.12"), ("72.0", "0.0")]


def test_clipboard(spark):
    md = "# Title\n\n**Bold** and <b>raw</b> [link](http://x)\n\n- one\n- two\n\n| A | B |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```"
    (got,) = values(spark, [(md,)], "m string", X.clipboard("m"))[0]
    assert "A\tB" in got.text and "• one" in got.text and "**" not in got.text and "&lt;b&gt;" in got.html and "code" in got.text


def test_stems(spark):
    rows = [("../../Invoice 123?.pdf",), ("CON.pdf",), ("???.png",), ("a" * 90 + ".pdf",), ("x/.hidden",)]
    assert [r[0] for r in values(spark, rows, "n string", X.safe_stem(F.col("n")))] == ["Invoice_123", "_CON", "document", "a" * 80, "hidden"]


def test_template():
    assert X.fill_template("{{A}} {{B}} {{a}}", {"A": "{{B}}", "B": "x"}) == "{{B}} x {{a}}"
    with pytest.raises(KeyError):
        X.fill_template("{{MISSING}}", {})


def test_small_formats(spark):
    got = values(spark, [(b"x" * 100, 1700000000, 1536)], "b binary, t long, n long", X.data_url(F.col("b")), X.epoch_text(F.col("t")), X.kib_text(F.col("n")))[0]
    assert len(got[0]) == len("data:image/png;base64,") + 136 and got[1:] == ("2023-11-14 22:13 UTC", "1.5 KiB")
    assert values(spark, [(3, 7)], "p int, i int", X.line_id(F.col("p"), F.col("i")), X.region_id(F.col("p"), F.col("i"))) == [("p3-l0007", "p3-r007")]


def test_page_ranges(spark):
    rows = [("1-3,5",), (" ",), (None,), ("0",), ("2-1",), ("a",), ("1,,2",), ("1-",), ("1-101",), ("5,1-2,2",), ("1-60,50-110",)]
    got = [r[0] for r in values(spark, rows, "r string", files.page_range(F.col("r")))]
    assert [g.pages for g in got] == [[1, 2, 3, 5], None, None, None, None, None, None, None, None, [1, 2, 5], None]
    assert [g.error is None for g in got] == [True, True, True, False, False, False, False, False, False, True, False]


def test_boxes(spark):
    row = [((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0))]
    kind = "struct<x1:double,y1:double,x2:double,y2:double>"
    got = values(spark, row, f"a {kind}, b {kind}", G.iou(F.col("a"), F.col("b")), G.touch(F.col("a"), F.col("b"), 0.0), G.center_inside(F.col("b"), F.col("a")), G.clamp(F.col("b"), F.lit(12), F.lit(8)), G.is_valid(F.col("a")))[0]
    assert got[0] == pytest.approx(1 / 3) and got[1] and got[2] and tuple(got[3]) == (5, 0, 12, 8) and got[4]
    crop = values(spark, [((10.0, 10.0, 50.0, 30.0),)], f"a {kind}", G.crop_shares(F.col("a"), F.lit(100.0), F.lit(100.0)))[0][0]
    assert tuple(round(v, 2) for v in (crop.left, crop.top)) == (0.08, 0.08) and round(crop.right, 2) == 0.48 and round(crop.bottom, 2) == 0.68


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="ab/~", min_size=1, max_size=3), x, max_size=3), max_leaves=12))
def test_pointers_resolve_what_they_enumerate(value):
    for path, leaf in P.leaves(value):
        assert path == "/data" or P.resolve(value, path) == leaf


def test_generic_metadata(spark):
    rows = [("/data/fields/0/name",), ("/data/fields/0/value",), ("/data/fields/0/value_type",), ("/data/x",)]
    assert [r[0] for r in values(spark, rows, "p string", P.is_generic_metadata(F.col("p")))] == [True, False, True, False]


def test_headings_are_composed_and_collapsed(spark):
    rows = [("#  a  b\r\n##\u2003e\u0301\u00a0 x \t\n### \n#no\n\u2028#### z",)]
    (h,) = values(spark, rows, "t string", X.headings(F.col("t")))[0]
    assert [tuple(x) for x in h] == [(1, "a b"), (2, "\u00e9 x"), (4, "z")]


def test_edit_distances_by_band_and_by_columns(monkeypatch):
    """Pairs of all lengths together and one by one, near and far ones, against the plain matrix; a near pair needs no whole columns."""
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé\U0001f600") for _ in range(n))
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("ab", "ba")]
    for n in (1, 5, 63, 64, 65, 130, 300):
        far = word(n)
        pairs += [(far, word(n)), (far, word(n // 3)), (far, far[: n // 2] + "x" + far[n // 2 + n // 9 :]), ("x" + far[3:] + "y", far), (far[::-1], far)]
    want = [plain(a, b) for a, b in pairs]
    assert X.edit_distances(pairs) == want
    monkeypatch.setattr(X, "TOGETHER", 1)
    assert X.edit_distances(pairs) == want and X.edit_distances([]) == []

    monkeypatch.setattr(X, "_by_columns", lambda held: [] if not held else pytest.fail("whole columns for near texts"))
    text = word(20_000)
    near = text[:5000] + text[5400:12_000] + "x" + text[12_000:] + "x"
    assert X.edit_distance("y" + text, near) == 403
