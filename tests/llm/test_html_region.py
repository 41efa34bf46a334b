"""The content region of web pages: against a plain version, on pages stripped of their marks, and on hard pages."""

import random
import re
import time

import pytest

from inkwell.llm import html_text

LONG = "Plain words that tell a story, one after another, without any links between them. " * 4


def brute_region(page, ratios):
    """The region by the definition: every container's lines are looked for anew, up to its parents."""
    tree, lines = html_text.Tree(page), page.lines
    chain = lambda c: [] if c < 0 else [c, *chain(page.parent[c])]
    inside = lambda c: [x for x in lines if c in chain(x.container)]
    dense = [x for x, d in zip(lines, html_text.dense_lines(ratios)) if d]
    mass = lambda xs: sum(len(x.text) * html_text.weight(tree, x.container) for x in xs)
    every = range(len(page.parent))
    enough = [c for c in every if mass([x for x in dense if c in chain(x.container)]) >= html_text.HOLDS * mass(dense) - 1e-9]
    region = max(enough, key=lambda c: len(chain(c)))
    linked = lambda xs: sum(x.linked for x in xs) > html_text.LINKS * sum(len(x.text) for x in xs)
    lists = {c for c in every if linked(inside(c)) and len(inside(c)) >= html_text.MENU_LINES}
    if page.article[region] >= 0:
        region = page.article[region]
    else:
        for around in chain(region)[1:]:
            added = [x for x in inside(around) if x not in inside(region)]
            if linked(added) or any(around in chain(c) and region not in chain(c) for c in lists) or around in lists:
                break
            region = around if added else region
    return region, lists


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.35 and depth < 4:
            tag = rng.choice(["div", "div", "section", "article", "main", "span", "nav"])
            mark = rng.choice(["", "", ' class="sidebar"', ' class="page with-footer"', ' id="comments"'])
            out.append(f"<{tag}{mark}>{random_page(rng, depth + 1)}</{tag}>")
        elif kind < 0.6:
            out.append("<ul>" + "".join(f"<li><a>{'link ' * rng.randrange(1, 3)}</a></li>" for _ in range(rng.randrange(1, 5))) + "</ul>")
        else:
            out.append(f"<p>{'word ' * rng.choice([1, 2, 8, 40, 90])}</p>")
    return "".join(out)


def test_region_against_brute_force():
    rng = random.Random(11)
    seen = set()
    for _ in range(400):
        page = html_text.page_lines(random_page(rng))
        ratios = html_text.line_ratios(page)
        if not ratios:
            continue
        region, lists = brute_region(page, ratios)
        got = html_text.content_lines(page, ratios)
        tree = html_text.Tree(page)
        within = [x for x in page.lines if region <= x.container <= tree.last[region]]
        assert set(got) <= set(within)
        # Whatever is left out of the region is marked, links, or a thin box.
        for x in within:
            if x not in got:
                chain, c = [], x.container
                while c > region:
                    chain.append(c)
                    c = page.parent[c]
                assert tree.aside[x.container] or any(c in lists for c in chain) or 2 * x.linked > len(x.text) or x.container != region
        seen.add(page.article[region] >= 0)
    assert seen == {True, False}


def test_ratios_decide_on_pages_stripped_of_their_marks(spark):
    """Without classes and without the tags that say what is what, ratios find the same text on nearly all pages; turned
    upside down, they find it on half as many."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]

    def strip(html):
        html = re.sub(r' (class|id|role)="[^"]*"', "", html)
        return re.sub(r"<(/?)(nav|article|footer|header|main|aside|section)\b", r"<\1div", html)

    same = turned = 0
    for html in pages:
        want, page = html_text.main_text(html), html_text.page_lines(strip(html))
        ratios = html_text.line_ratios(page)
        same += "\n\n".join(x.text for x in html_text.content_lines(page, ratios)) == want
        turned += "\n\n".join(x.text for x in html_text.content_lines(page, [max(ratios) - r for r in ratios])) == want
    assert len(pages) >= 100 and same >= 0.95 * len(pages) and turned < 0.6 * same


def test_equal_lines():
    for n in range(1, 30):
        for size in range(1, 60):
            for page in ("%s", "<article>%s</article>"):
                assert html_text.main_text(page % (f"<p>{'x' * size}</p>" * n)) == "\n\n".join(["x" * size] * n)


@pytest.mark.parametrize("page", ["<div>some text here " * 20_000, "<div class=side>some text " * 20_000, "<b>" * 20_000 + "<hr>x" * 20_000, "<b>" * 20_000 + "x</i>" * 20_000, "<div>" * 20_000 + "x</section>" * 20_000])
def test_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    assert html_text.main_text(page)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("mark", ['div class="has-sidebar"', 'div class="page with-footer"', 'div class="layout-sidebar-right"', 'div class="grid form"', 'div class="main-content side"', 'div class="content comments-open"', "form", 'span id="header"'])
def test_wrappers_are_no_asides(mark):
    tag = mark.split()[0]
    aside = "<nav><a>a</a></nav>", '<div class="sidebar"><p>Beside it.</p></div>'
    for own in (f"<article><p>{LONG}</p><p>x</p></article>", f"<p>{LONG}</p><p>x</p>"):
        assert html_text.main_text(f"<body><{mark}>{aside[0]}{own}{aside[1]}</{tag}></body>") == f"{LONG.strip()}\n\nx"


def test_asides_stay_asides():
    for comments in (f'<div class="comments"><p>{LONG * 9}</p></div>', f"<aside><article><p>{LONG[:90]}</p></article></aside>"):
        assert html_text.main_text(f"<body><article><p>{LONG}</p></article>{comments}</body>") == LONG.strip()
        assert html_text.main_text(f"<body><article><p>{LONG}</p>{comments}</article></body>") == LONG.strip()
    assert html_text.main_text("<footer>&copy; me</footer>") == html_text.main_text("<div class=cookie>We use cookies</div>") == ""
    related = "".join(f"<li><a>Read this too {i}</a></li>" for i in range(5))
    assert html_text.main_text(f"<article><p>{LONG}</p><div><ul>{related}</ul></div><p>End.</p></article>") == f"{LONG.strip()}\n\nEnd."
    assert html_text.main_text('<p>One <span class="share">Tell others</span>two</p><p>three</p>') == "One two\n\nthree"
