"""Markdown to HTML: blocks, inlines, nesting, tables, and texts that must not take long."""

import time

import pytest

from inkwell.functions.markdown import NESTING, markdown_html
from inkwell.functions.text import visible

CASES = [
    ("# A\n\nB *c* **d** _e_ __f__ ~~g~~ `h`","<h1>A</h1>\n<p>B <em>c</em> <strong>d</strong> <em>e</em> <strong>f</strong> <s>g</s> <code>h</code></p>\n"),
    ("> a\nb\n\n> c","<blockquote>\n<p>a\nb</p>\n</blockquote>\n<blockquote>\n<p>c</p>\n</blockquote>\n"),
    ("- a\n  - b\n    - c\n- d","<ul>\n<li>a\n<ul>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),
    ("- a\n\n- b","<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"),
    ("3. x\n4. y","<ol start=\"3\">\n<li>x</li>\n<li>y</li>\n</ol>\n"),
    ("Title\n===\n\nSub\n---\n\n***","<h1>Title</h1>\n<h2>Sub</h2>\n<hr />\n"),
    ("![alt *x*](u.png \"t\")","<p><img src=\"u.png\" alt=\"alt x\" title=\"t\" /></p>\n"),
    ("[a](<b c> 't') [r] [r][] [x][r]\n\n[r]: /url \"T\"","<p><a href=\"b%20c\" title=\"t\">a</a> <a href=\"/url\" title=\"T\">r</a> <a href=\"/url\" title=\"T\">r</a> <a href=\"/url\" title=\"T\">x</a></p>\n"),
    ("***a***","<p><em><strong>a</strong></em></p>\n"),
    ("*foo**bar**baz*","<p><em>foo<strong>bar</strong>baz</em></p>\n"),
    ("**foo*","<p>*<em>foo</em></p>\n"),
    ("foo_bar_baz","<p>foo_bar_baz</p>\n"),
    ("a  \nb\\\nc\nd","<p>a<br />\nb<br />\nc\nd</p>\n"),
    ("    code\n\n    more","<pre><code>code\n\nmore\n</code></pre>\n"),
    ("```py\na<b\n```","<pre><code class=\"language-py\">a&lt;b\n</code></pre>\n"),
    ("<script>alert(\"x\")</script>","<p>&lt;script&gt;alert(&quot;x&quot;)&lt;/script&gt;</p>\n"),
    ("| a | b |\n|:-|-:|\n| 1 | *2* |\n| 3 |","<table>\n<thead>\n<tr>\n<th style=\"text-align:left\">a</th>\n<th style=\"text-align:right\">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td style=\"text-align:left\">1</td>\n<td style=\"text-align:right\"><em>2</em></td>\n</tr>\n<tr>\n<td style=\"text-align:left\">3</td>\n<td style=\"text-align:right\"></td>\n</tr>\n</tbody>\n</table>\n"),
    ("[x](javascript:alert(1))","<p>[x](javascript:alert(1))</p>\n"),
    ("<http://a.b?c=d&e> <m@x.org>","<p><a href=\"http://a.b?c=d&amp;e\">http://a.b?c=d&amp;e</a> <a href=\"mailto:m@x.org\">m@x.org</a></p>\n"),
    ("&copy; \\* &nope; a&b","<p>© * &amp;nope; a&amp;b</p>\n"),
    ("`` a`b ``","<p><code>a`b</code></p>\n"),
    ("- a\n\n  b\n\n      code","<ul>\n<li>\n<p>a</p>\n<p>b</p>\n<pre><code>code\n</code></pre>\n</li>\n</ul>\n"),
    ("> - a\n> - b\n>\n> c","<blockquote>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<p>c</p>\n</blockquote>\n"),
    ("# a #\n## \n#nope","<h1>a</h1>\n<h2></h2>\n<p>#nope</p>\n"),
    ("text\n- item\n2. no","<p>text</p>\n<ul>\n<li>item</li>\n</ul>\n<ol start=\"2\">\n<li>no</li>\n</ol>\n"),
    ("*a `*` b*","<p><em>a <code>*</code> b</em></p>\n"),
    ("[a [b](c) d](e)","<p>[a <a href=\"c\">b</a> d](e)</p>\n"),
    ("- - a","<ul>\n<li>\n<ul>\n<li>a</li>\n</ul>\n</li>\n</ul>\n"),
    ("-\n  a\n- ","<ul>\n<li>a</li>\n<li></li>\n</ul>\n"),
    ("> ```\n> x\ny","<blockquote>\n<pre><code>x\n</code></pre>\n</blockquote>\n<p>y</p>\n"),
    ("",""),
]


@pytest.mark.parametrize(("markdown", "html"), CASES)
def test_html(markdown, html):
    assert markdown_html(markdown) == html


def test_visible():
    md = "# Invoice\n\n**Total:** 5 `INV-1`\n\n> quoted *text*\n\n- First\n  1. inner\n\n| Item | Price |\n|---|---:|\n| Tea | 3 |\n\n[Portal](https://example.com) ![logo](l.png)"
    assert visible(markdown_html(md)) == "Invoice\n\nTotal: 5 INV-1\n\nquoted text\n\n• First\n\n• inner\n\nItem\tPrice\nTea\t3\n\nPortal"


@pytest.mark.parametrize("piece", [">", "*a ", "**a*b ", "[", "[a](", "_a__b ", "a* ", "|", "1. ", "&", "<a", "\t", "![[]()", "[x](y) ", "[a]: b\n", ">a\nb\n", "- x\n", "`", "a~~b ", "# x\n"])
def test_long_texts(piece):
    began = time.perf_counter()
    markdown_html(piece * 20_000)
    markdown_html("x " + piece * 20_000 + " y")
    assert time.perf_counter() - began < 10


def test_nesting_ends():
    deep = markdown_html("> " * 200 + "x")
    assert deep.count("<blockquote>") == NESTING and "&gt; x" in deep
