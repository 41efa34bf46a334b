"""Markdown to HTML: CommonMark's blocks and inlines, pipe tables and strikethrough; raw HTML is shown, not passed on.

Blocks are found line by line: quotes and list items take their lines without their marks and are read in turn, down to
NESTING levels.  Inlines are found in one pass over a block's text that notes runs of emphasis marks and brackets; runs are
then matched by the rules for opening and closing ones, with the lowest place below which no opener can be remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from urllib.parse import quote

#: Quotes and lists within one another; what is nested deeper is text.
NESTING = 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*)$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*$""")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


class Lazy(str):
    """A line that goes on with a paragraph although the marks of its quote or item are missing."""


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _expand(line: str) -> str:
    """Tabs among a line's leading blanks as blanks."""
    out = ""
    for i, c in enumerate(line):
        if c == "\t":
            out += " " * (4 - len(out) % 4)
        elif c == " ":
            out += c
        else:
            return out + line[i:]
    return ""


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


@dataclass
class Node:
    kind: str
    text: str = ""
    level: int = 0
    info: str = ""
    children: list[Node] = field(default_factory=list)
    loose: bool = False
    rows: list[list[str]] = field(default_factory=list)
    align: list[str] = field(default_factory=list)


def _cells(line: str) -> list[str]:
    """Cells of a table's row; an escaped bar is part of its cell."""
    parts = [p.strip() for p in re.split(r"(?<!\\)\|", line.strip())]
    parts = parts[1:] if line.strip().startswith("|") else parts
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    return [p.replace("\\|", "|") for p in parts]


class Blocks:
    """Blocks of lines, and the link definitions that stand among them."""

    def __init__(self):
        self.links: dict[str, tuple[str, str]] = {}

    def read(self, lines: list[str], depth: int = 0) -> tuple[list[Node], bool]:
        """(blocks, whether an empty line parts two of them)."""
        out: list[Node] = []
        i, gap, parted = 0, False, False
        while i < len(lines):
            if not lines[i].strip():
                gap, i = bool(out), i + 1
                continue
            node, i = self._one(lines, i, depth)
            if node is not None:
                parted |= gap
                out.append(node)
            gap = False
        return out, parted

    def _one(self, lines: list[str], i: int, depth: int) -> tuple[Node | None, int]:
        line = lines[i]
        if not isinstance(line, Lazy):
            if _indent(line) >= 4:
                return self._indented(lines, i)
            if (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
                return self._fenced(lines, i, m)
            if m := _HEADING.match(line):
                return Node("heading", (m[2] or "").strip(), len(m[1])), i + 1
            if _RULE.match(line):
                return Node("rule"), i + 1
            if depth < NESTING and _QUOTE.match(line):
                return self._quote(lines, i, depth)
            if depth < NESTING and _ITEM.match(line):
                return self._list(lines, i, depth)
            if i + 1 < len(lines) and self._opens_table(line, lines[i + 1]):
                return self._table(lines, i)
        return self._paragraph(lines, i, depth)

    def _starts(self, line: str, depth: int) -> bool:
        """Whether a line may interrupt a paragraph."""
        if isinstance(line, Lazy) or _indent(line) >= 4:
            return False
        fence = _FENCE.match(line)
        if (fence and not (fence[2][0] == "`" and "`" in fence[3])) or _HEADING.match(line) or _RULE.match(line):
            return True
        if depth >= NESTING:
            return False
        item = _ITEM.match(line)
        return bool(_QUOTE.match(line)) or bool(item and line[item.end() :].strip() and (item[2] or int(item[3]) == 1))

    def _indented(self, lines: list[str], i: int) -> tuple[Node, int]:
        j = i
        while j < len(lines) and (not lines[j].strip() or (_indent(lines[j]) >= 4 and not isinstance(lines[j], Lazy))):
            j += 1
        while not lines[j - 1].strip():
            j -= 1
        return Node("code", "\n".join(x[4:] for x in lines[i:j])), j

    def _fenced(self, lines: list[str], i: int, m: re.Match) -> tuple[Node, int]:
        close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        j = next((j for j in range(i + 1, len(lines)) if close.match(lines[j])), len(lines))
        cut = lambda x: x[min(len(m[1]), _indent(x)) :]
        return Node("code", "\n".join(map(cut, lines[i + 1 : j])), info=_plain(m[3].strip())), j + 1

    def _inside(self, line: str, last: str, fenced: bool, depth: int) -> bool:
        """Whether a line without marks goes on with the paragraph that the line before it (without marks) ends with."""
        while m := _QUOTE.match(last) or _ITEM.match(last):
            last = last[m.end() :].lstrip(" ")
        open_ = bool(last.strip()) and not fenced and not _HEADING.match(last) and not _RULE.match(last) and not _FENCE.match(last)
        return open_ and bool(line.strip()) and not self._starts(line, depth) and (_indent(line) >= 4 or depth >= NESTING or not _ITEM.match(line))

    def _quote(self, lines: list[str], i: int, depth: int) -> tuple[Node, int]:
        own: list[str] = []
        fenced = False
        while i < len(lines):
            m = None if isinstance(lines[i], Lazy) else _QUOTE.match(lines[i])
            if m:
                own.append(_expand(lines[i][m.end() :]))
                fenced ^= bool(_FENCE.match(own[-1]))
            elif self._inside(lines[i], own[-1], fenced, depth) and _indent(own[-1]) < 4:
                own.append(Lazy(lines[i]))
            else:
                break
            i += 1
        return Node("quote", children=self.read(own, depth + 1)[0]), i

    def _list(self, lines: list[str], i: int, depth: int) -> tuple[Node, int]:
        first = _ITEM.match(lines[i])
        out = Node("list", level=int(first[3]) if first[3] else -1)
        kind, blank = first[2] or first[4], False
        while i < len(lines):
            m = None if isinstance(lines[i], Lazy) or _RULE.match(lines[i]) else _ITEM.match(lines[i])
            if not m or (m[2] or m[4]) != kind:
                break
            out.loose |= blank
            rest = _expand(" " * m.end() + lines[i][m.end() :])[m.end() :]
            inner = _indent(rest)
            inner = 1 if not rest.strip() or inner > 4 else inner
            offset, own = m.end() + inner, [rest[inner:]]
            i, fenced = i + 1, bool(_FENCE.match(rest[inner:]))
            # An item may begin with one empty line.
            while i < len(lines):
                line = lines[i]
                if not line.strip():
                    if len(own) == 1 and not own[0].strip():
                        break
                    own.append("")
                elif _indent(line) >= offset and not isinstance(line, Lazy):
                    own.append(line[offset:])
                    fenced ^= bool(_FENCE.match(own[-1]))
                elif self._inside(line, own[-1], fenced, depth):
                    own.append(Lazy(line))
                else:
                    break
                i += 1
            blank = not own[-1].strip() and len(own) > 1
            while len(own) > 1 and not own[-1].strip():
                own.pop()
            children, parted = self.read(own, depth + 1)
            out.loose |= parted
            out.children.append(Node("item", children=children))
            # Empty lines that end the item may stand before the next one.
            while i < len(lines) and not lines[i].strip():
                blank, i = True, i + 1
        return out, i

    def _opens_table(self, line: str, below: str) -> bool:
        return "|" in line and not isinstance(below, Lazy) and bool(_DELIMITER.match(below)) and len(_cells(line)) == len(_cells(below))

    def _table(self, lines: list[str], i: int) -> tuple[Node, int]:
        marks = _cells(lines[i + 1])
        sides = {(True, True): "center", (True, False): "left", (False, True): "right", (False, False): ""}
        out = Node("table", rows=[_cells(lines[i])], align=[sides[m.startswith(":"), m.endswith(":")] for m in marks])
        i += 2
        while i < len(lines) and lines[i].strip() and not isinstance(lines[i], Lazy) and _indent(lines[i]) < 4 and not self._starts(lines[i], 0):
            row = _cells(lines[i])[: len(marks)]
            out.rows.append(row + [""] * (len(marks) - len(row)))
            i += 1
        return out, i

    def _paragraph(self, lines: list[str], i: int, depth: int) -> tuple[Node | None, int]:
        own = [lines[i]]
        i += 1
        while i < len(lines) and lines[i].strip():
            if not isinstance(lines[i], Lazy) and (m := _UNDERLINE.match(lines[i])) and (text := self._define(own)):
                return Node("heading", text, 1 if m[1][0] == "=" else 2), i + 1
            if self._starts(lines[i], depth) or (i + 1 < len(lines) and self._opens_table(lines[i], lines[i + 1])):
                break
            own.append(lines[i])
            i += 1
        text = self._define(own)
        return (Node("paragraph", text) if text else None), i

    def _define(self, lines: list[str]) -> str:
        """A paragraph's text without the link definitions that it starts with."""
        at = 0
        while at < len(lines) and (m := _DEFINITION.match(lines[at])):
            target = m[2][1:-1] if m[2].startswith("<") else m[2]
            self.links.setdefault(_label(m[1]), (_plain(target), _plain((m[3] or "  ")[1:-1])))
            at += 1
        return "\n".join(x.lstrip() for x in lines[at:]).rstrip()


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _plain(text: str) -> str:
    """Escapes and character references in a link target, a title or an info string."""
    return unescape(re.sub(r"\\([" + re.escape(PUNCTUATION) + "])", lambda m: "&#%d;" % ord(m[1]), text)) if "\\" in text or "&" in text else text


def _allowed(url: str) -> bool:
    return not re.match(r"(?i)\s*(javascript|vbscript|file|data):", url) or bool(re.match(r"(?i)\s*data:image/(gif|png|jpeg|webp);", url))


@dataclass
class Run:
    """A run of emphasis marks at a place among the pieces."""

    at: int
    char: str
    size: int
    opens: bool
    closes: bool
    whole: int = 0


_CODE = re.compile(r"`+")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>")
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TEXT = re.compile(r"[^\\`<&\n*_~\[\]!]+")
_TARGET = re.compile(r"""\([ \t\n]*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:[ \t\n]+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t\n]*\)""", re.DOTALL)


class Inlines:
    """One block's text as HTML."""

    def __init__(self, links: dict[str, tuple[str, str]]):
        self.links = links

    def html(self, text: str) -> str:
        self.text, self.pieces, self.runs = text, [], []
        self.brackets: list[tuple[int, int, int, bool]] = []  # piece, number of runs, place after it, image
        self.dead = 0
        self.ticks = {len(m[0]): m.start() for m in _CODE.finditer(text)}  # last run of each length
        at = 0
        while at < len(text):
            at = self._step(at)
        self._match(0)
        return "".join(self.pieces)

    def _step(self, at: int) -> int:
        text, c = self.text, self.text[at]
        if m := _TEXT.match(text, at):
            own = m[0]
            if m.end() < len(text) and text[m.end()] == "\n":  # blanks before a line end
                hard = own.endswith("  ")
                self.pieces.append(escape(own.rstrip(" ")))
                return self._line_end(m.end(), hard)
            self.pieces.append(escape(own))
            return m.end()
        if c == "\n":
            return self._line_end(at, False)
        if c == "\\":
            follows = text[at + 1 : at + 2]
            if follows == "\n":
                return self._line_end(at + 1, True)
            escaped = bool(follows) and follows in PUNCTUATION
            self.pieces.append(escape(follows if escaped else "\\"))
            return at + 1 + escaped
        if c == "`":
            return self._code(at)
        if c == "<" and (m := _AUTOLINK.match(text, at)) and _allowed(m[1] or ""):
            self.pieces.append(f'<a href="{_href(m[1] or "mailto:" + m[2])}">{escape(m[1] or m[2])}</a>')
            return m.end()
        if c == "&" and (m := _REFERENCE.match(text, at)) and unescape(m[0]) != m[0]:
            self.pieces.append(escape(unescape(m[0])))
            return m.end()
        if c in "*_~":
            return self._run(at)
        if c == "[" or (c == "!" and text[at + 1 : at + 2] == "["):
            self.brackets.append((len(self.pieces), len(self.runs), at + 1 + (c == "!"), c == "!"))
            self.pieces.append("![" if c == "!" else "[")
            return at + 1 + (c == "!")
        if c == "]":
            return self._link(at)
        self.pieces.append(escape(c))
        return at + 1

    def _line_end(self, at: int, hard: bool) -> int:
        self.pieces.append("<br />\n" if hard else "\n")
        at += 1
        while at < len(self.text) and self.text[at] == " ":
            at += 1
        return at

    def _code(self, at: int) -> int:
        size = len(_CODE.match(self.text, at)[0])
        if self.ticks.get(size, -1) > at:
            close = next(m for m in _CODE.finditer(self.text, at + size) if len(m[0]) == size)
            own = self.text[at + size : close.start()].replace("\n", " ")
            if own.strip(" ") and own[0] == own[-1] == " ":
                own = own[1:-1]
            self.pieces.append(f"<code>{escape(own)}</code>")
            return close.end()
        self.pieces.append("`" * size)
        return at + size

    def _run(self, at: int) -> int:
        text, c, end = self.text, self.text[at], at
        while end < len(text) and text[end] == c:
            end += 1
        before, after = text[at - 1 : at] if at else " ", text[end : end + 1] or " "
        space = lambda x: x.isspace()
        mark = lambda x: x in PUNCTUATION or (not x.isalnum() and not x.isspace() and ord(x) > 127)
        left = not space(after) and (not mark(after) or space(before) or mark(before))
        right = not space(before) and (not mark(before) or space(after) or mark(after))
        opens, closes = left, right
        if c == "_":
            opens, closes = left and (not right or mark(before)), right and (not left or mark(after))
        if c == "~" and end - at != 2:
            opens = closes = False
        self.runs.append(Run(len(self.pieces), c, end - at, opens, closes, end - at))
        self.pieces.append(text[at:end])
        return end

    def _match(self, bottom: int) -> None:
        """Match the runs from ``bottom`` on, and forget them."""
        runs, lowest = self.runs, {}
        opens = {i: [] for i in range(len(runs))}
        closes = {i: [] for i in range(len(runs))}
        stack: list[int] = []
        for i in range(bottom, len(runs)):
            run = runs[i]
            while run.closes and run.size:
                key = run.char, run.opens, run.whole % 3
                found = None
                for s in range(len(stack) - 1, lowest.get(key, -1), -1):
                    other = runs[stack[s]]
                    odd = run.char != "~" and (other.closes or run.opens) and (other.whole + run.whole) % 3 == 0 and (other.whole % 3 or run.whole % 3)
                    if other.char == run.char and not odd:
                        found = s
                        break
                if found is None:
                    lowest[key] = len(stack) - 1
                    break
                other = runs[stack[found]]
                n = 2 if run.size >= 2 and other.size >= 2 else 1
                tag = "s" if run.char == "~" else "strong" if n == 2 else "em"
                opens[stack[found]].insert(0, f"<{tag}>")
                closes[i].append(f"</{tag}>")
                other.size -= n
                run.size -= n
                del stack[found + (1 if other.size else 0) :]
                lowest = {k: min(v, len(stack) - 1) for k, v in lowest.items()}
            if run.opens and run.size:
                stack.append(i)
        for i in range(bottom, len(runs)):
            self.pieces[runs[i].at] = "".join(closes[i]) + runs[i].char * runs[i].size + "".join(opens[i])
        del runs[bottom:]

    def _link(self, at: int) -> int:
        if not self.brackets:
            self.pieces.append("]")
            return at + 1
        piece, runs, begin, image = self.brackets.pop()
        target, end = self._target(at + 1, self.text[begin:at])
        if target is None or (not image and len(self.brackets) < self.dead) or not _allowed(target[0]):
            self.pieces.append("]")
            return at + 1
        self._match(runs)
        inner = "".join(self.pieces[piece + 1 :])
        del self.pieces[piece:]
        title = f' title="{escape(target[1])}"' if target[1] else ""
        if image:
            alt = re.sub(r"<[^<>]*?alt=\"([^\"]*)\"[^<>]*>|<[^<>]*>", lambda m: m[1] or "", inner)
            self.pieces.append(f'<img src="{_href(target[0])}" alt="{alt}"{title} />')
        else:
            self.pieces.append(f'<a href="{_href(target[0])}"{title}>{inner}</a>')
            self.dead = len(self.brackets)  # no link within a link: brackets before this one open none any more
        return end

    def _target(self, at: int, label: str) -> tuple[tuple[str, str] | None, int]:
        """(target and title, place after it) of what follows a closing bracket."""
        if m := _TARGET.match(self.text, at):
            return (_plain(m[1] if m[1] is not None else m[2]), _plain((m[3] or "  ")[1:-1])), m.end()
        if m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(self.text, at):
            named = self.links.get(_label(m[1] or label))
            if named or m[1]:
                return named, m.end()
        return self.links.get(_label(label)), at


def _href(url: str) -> str:
    return escape(quote(url, safe="!#$%&'()*+,/:;=?@[]~_.-", encoding="utf-8"))


def _write(nodes: list[Node], inline: Inlines, tight: bool = False) -> Iterator[str]:
    for node in nodes:
        if node.kind == "paragraph":
            yield inline.html(node.text) + ("" if node is nodes[-1] else "\n") if tight else f"<p>{inline.html(node.text)}</p>\n"
        elif node.kind == "heading":
            yield f"<h{node.level}>{inline.html(node.text)}</h{node.level}>\n"
        elif node.kind == "rule":
            yield "<hr />\n"
        elif node.kind == "code":
            word = f' class="language-{escape(node.info.split()[0])}"' if node.info else ""
            yield f"<pre><code{word}>{escape(node.text)}{chr(10) if node.text else ''}</code></pre>\n"
        elif node.kind == "quote":
            yield "<blockquote>\n" + "".join(_write(node.children, inline)) + "</blockquote>\n"
        elif node.kind == "list":
            tag = "ul" if node.level < 0 else "ol"
            yield f'<{tag}{f" start={chr(34)}{node.level}{chr(34)}" if node.level not in (-1, 1) else ""}>\n'
            for item in node.children:
                inner = "".join(_write(item.children, inline, not node.loose))
                block = bool(item.children) and (node.loose or item.children[0].kind != "paragraph")
                yield f"<li>{chr(10) if block else ''}{inner}</li>\n"
            yield f"</{tag}>\n"
        elif node.kind == "table":
            style = [f' style="text-align:{a}"' if a else "" for a in node.align]
            row = lambda cells, tag: "<tr>\n" + "".join(f"<{tag}{s}>{inline.html(c)}</{tag}>\n" for c, s in zip(cells, style, strict=True)) + "</tr>\n"  # noqa: B023, E731
            body = "".join(row(r, "td") for r in node.rows[1:])
            yield f"<table>\n<thead>\n{row(node.rows[0], 'th')}</thead>\n" + (f"<tbody>\n{body}</tbody>\n" if body else "") + "</table>\n"


def markdown_html(markdown: str) -> str:
    blocks = Blocks()
    lines = [_expand(x) for x in re.split(r"\r\n|\n|\r", markdown.replace("\0", "�"))]
    nodes, _ = blocks.read(lines)
    return "".join(_write(nodes, Inlines(blocks.links)))
