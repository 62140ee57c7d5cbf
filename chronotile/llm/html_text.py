"""Layout-aware text of HTML pages.

A scanner reads a page forwards once. A small tree builder closes elements that HTML lets authors leave open and opens rows that they
leave out; visibility rules drop what a browser would not show; the renderer emits all other text with blocks on lines of their own,
blank lines around paragraphs, list markers with indentation, and table cells padded to columns. Time grows with the length of the
page, whatever its markup: open elements are found by name, not by a walk, and no part of a page is scanned again.
"""

from __future__ import annotations

import html
import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.llm.common import in_batches

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object svg math datalist audio video canvas".split())
RAW = frozenset("script style textarea title noscript iframe".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr form fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article main header footer nav aside li dt dd tr caption thead tbody tfoot td th address details summary "
    "figcaption legend dialog select option optgroup".split()
)
ROWS = frozenset("table thead tbody tfoot".split())
#: A start tag closes the nearest open element of the first set, unless one of the second set is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
BETWEEN = re.compile(r"[\s/]*")
NAME = re.compile(r"[^\s/>][^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
STYLE = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: Parts of style sheets: braces, selectors of one element, and the media that count.
BRACE = re.compile(r"([{}])")
SELECTOR = re.compile(r"(\*|[a-z][\w-]*)?(?:([.#])(-?[a-z_][\w-]*))?", re.I)
SCREEN = re.compile(r"@media\s*(?:only\s+)?(?:$|all\b|screen\b)(?!.*\band\b)", re.I | re.S)
#: Widest indentation of list items; deeper ones keep it. Most columns of a cell, as in the standard.
INDENT, SPAN = 80, 1000


class _Scanner:
    """Tags and texts of a page from left to right."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.nowhere: dict[str, int] = {}
        self.last: dict[str, tuple[int, int]] = {}
        self.plain = False

    def find(self, what: str, at: int) -> int:
        """``page.find``; no part of the page is searched twice for the same, whether it was found there or does not come any more."""
        if at >= self.nowhere.get(what, len(self.page) + 1):
            return -1
        start, found = self.last.get(what, (0, -1))
        if start <= at <= found:
            return found
        found = self.page.find(what, at)
        if found < 0:
            self.nowhere[what] = at
        else:
            self.last[what] = at, found
        return found

    def attributes(self, at: int) -> tuple[int, dict[str, str], bool] | None:
        """The end of the tag, its attributes, and whether it closes itself; None if it never ends."""
        page, out = self.page, {}
        while (at := BETWEEN.match(page, at).end()) < len(page):
            if page[at] == ">":
                return at + 1, out, page[at - 1] == "/"
            name = NAME.match(page, at)
            at, value = name.end(), ""
            if equals := EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") and quote and not self.plain else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            out.setdefault(name[0].lower(), value)
        return None

    def tokens(self) -> Iterator[tuple]:
        """("text", text), ("open", tag, attributes, closed at once, end) and ("close", tag). A caller may send where to go on from."""
        page, at = self.page, 0
        while at < len(page):
            start = self.find("<", at)
            if start != at:
                stop = start if start >= 0 else len(page)
                yield "text", page[at:stop]
                at = stop
                continue
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            end = self.find(">", at)
            if page[at + 1 : at + 2] in ("!", "?") and end >= 0:
                at = end + 1
                continue
            tag = TAG.match(page, at) if end >= 0 else None
            read = self.attributes(tag.end()) if tag else None
            if tag and read is None:
                # All ends of tags from here on lie in quoted values: from now on quotes are letters.
                self.plain = True
                read = self.attributes(tag.end())
            if tag is None or read is None:
                yield "text", "<"
                at += 1
            elif page[at + 1] == "/":
                at = read[0]
                yield "close", tag[1].lower()
            else:
                at = read[0]
                more = yield "open", tag[1].lower(), read[1], read[2], at
                if more is not None:
                    at = more
                    yield "text", ""


class _Sheet:
    """Display and visibility that the style sheets of a page give to elements.

    Rules with one simple selector count: a name, a class or an id, or a name with a class or an id. Each keeps its strongest value, so an
    element looks up a few keys, whatever the number of rules. Sheets for other media than all and screen are left out.
    """

    def __init__(self) -> None:
        self.rules: dict[tuple[str, str, str], tuple[tuple, str]] = {}
        self.order = 0

    def read(self, css: str) -> None:
        first, *others = css.split("/*")
        css = first + " ".join(x.partition("*/")[2] for x in others)
        blocks: list[tuple[str, bool]] = []
        parts = BRACE.split(css)
        for text, brace in zip(parts[::2], parts[1::2], strict=False):
            live = not blocks or blocks[-1][1]
            if brace == "{":
                text = text.rpartition(";")[2].strip()
                if text.startswith("@"):
                    blocks.append(("", live and bool(SCREEN.match(text))))
                else:
                    blocks.append((text or "{", live and not (blocks and blocks[-1][0])))
            elif blocks:
                selectors, live = blocks.pop()
                if selectors and live:
                    self._keep(selectors, text)

    def _keep(self, selectors: str, body: str) -> None:
        found = [(m[1].lower(), m[2].lower(), bool(m[3])) for m in STYLE.finditer(body)]
        for selector in selectors.split(",") if found else ():
            if selector.strip() and (m := SELECTOR.fullmatch(selector.strip())):
                tag, key = "" if m[1] in (None, "*") else m[1].lower(), (m[2] or "") + (m[3] or "")
                self.order += 1
                for name, value, strong in found:
                    rank = (strong, m[2] == "#", m[2] == ".", bool(tag), self.order)
                    place = (tag, key, name)
                    if place not in self.rules or self.rules[place][0] <= rank:
                        self.rules[place] = rank, value

    def values(self, tag: str, attributes: dict[str, str]) -> dict[str, str]:
        """Of display and visibility, what the sheets or the element's own style say, the stronger one."""
        best: dict[str, tuple[tuple, str]] = {}
        if self.rules:
            keys = ["", *(f".{c}" for c in html.unescape(attributes.get("class", "")).split())]
            keys += [f"#{html.unescape(attributes['id'])}"] if "id" in attributes else []
            for key in keys:
                for place in ((tag, key), ("", key)):
                    for name in ("display", "visibility"):
                        if (rule := self.rules.get((*place, name))) and (name not in best or best[name][0] < rule[0]):
                            best[name] = rule
        for m in STYLE.finditer(html.unescape(attributes.get("style", ""))):
            own = ((bool(m[3]), True, True, True, float("inf")), m[2].lower())
            if m[1].lower() not in best or best[m[1].lower()][0] <= own[0]:
                best[m[1].lower()] = own
        return {name: value for name, (_, value) in best.items()}


def _resolve(root: list, sheet: _Sheet) -> None:
    """Put whether a browser shows it in the place of each node's attributes, and take out texts that are there but not seen.

    What is not displayed goes with all in it; what is only invisible keeps its visible parts. Of closed details the summary is shown.
    """
    root[1] = True
    todo = [(root, False, False)]
    while todo:
        node, veiled, folded = todo.pop()
        kept = []
        for x in node[2]:
            if isinstance(x, str):
                if not veiled and not folded:
                    kept.append(x)
                continue
            tag, attributes = x[0], x[1]
            values = sheet.values(tag, attributes)
            off = "hidden" in attributes or tag == "dialog" and "open" not in attributes
            x[1] = tag not in HIDDEN and not (values["display"] == "none" if "display" in values else off) and (not folded or tag == "summary")
            if x[1]:
                seen = values.get("visibility")
                now = seen in ("hidden", "collapse") if seen in ("hidden", "collapse", "visible") else veiled
                if tag == "br" and now:
                    continue
                todo.append((x, now, tag == "details" and "open" not in attributes))
                kept.append(x)
        node[2] = kept


def parse(page: str) -> list:
    """The root node; a node is [tag, visible, children, columns], a child is a node or a text."""
    root: list = ["html", {}, [], 1]
    sheet = _Sheet()
    stack, places = [root], defaultdict(list)

    def push(node: list) -> None:
        stack[-1][2].append(node)
        places[node[0]].append(len(stack))
        stack.append(node)

    def close(names: set[str], limits: set[str]) -> None:
        nearest = max((places[n][-1] for n in names if places[n]), default=0)
        if nearest and nearest > max((places[n][-1] for n in limits if places[n]), default=0):
            while len(stack) > nearest:
                places[stack.pop()[0]].pop()

    scanner = _Scanner(page)
    tokens = scanner.tokens()
    for token in tokens:
        if token[0] == "text":
            if token[1]:
                stack[-1][2].append(html.unescape(token[1]))
            continue
        tag = token[1]
        if token[0] == "close":
            if tag == "br":
                stack[-1][2].append(["br", {}, [], 1])
            elif tag not in VOID:
                outer = tag in ROWS or tag in ("tr", "body", "html")
                close({tag}, set() if outer else {"td", "th", "table"} - {tag})
            continue
        _, _, attributes, at_once, end = token
        if tag in BLOCK and tag not in ("option", "optgroup", "select"):
            close({"p"}, {"table", "td", "th", "li", "div", "body"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        span = attributes.get("colspan", "1")
        node = [tag, attributes, [], min(SPAN, max(1, int(span))) if span.isascii() and span.isdigit() and len(span) < 6 else 1]
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, end)
            raw = page[end : stop.start() if stop else len(page)]
            if tag == "textarea":
                node[2].append(html.unescape(raw))
                stack[-1][2].append(node)
            elif tag == "style" and SCREEN.match("@media " + html.unescape(attributes.get("media", ""))):
                sheet.read(raw)
            tokens.send(stop.start() if stop else len(page))
        elif tag != "html":
            if tag in ("td", "th") and stack[-1][0] in ROWS:
                push(["tr", {}, [], 1])
            if tag in VOID or at_once:
                stack[-1][2].append(node)
            else:
                push(node)
                if 4 * len(stack) + 1000 > sys.getrecursionlimit():
                    sys.setrecursionlimit(8 * len(stack) + 1000)  # the renderer recurses, three calls at most for an element
    _resolve(root, sheet)
    return root


class _Lines:
    """Lines so far; text is collapsed on the way in, and at most one blank line separates blocks, none within list items."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.first = self.rest = ""
        self.items = 0

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.split("\n")
            self.now.append(first)
            for line in rest:
                self.end(True)
                self.now.append(line)
        else:
            self.now.append(" ".join(x if x.strip() or not x else "" for x in re.split(r"[ \t\n\r\f]+", text)))

    def end(self, keep: bool = False) -> None:
        line = "".join(self.now)
        line = line.rstrip() if keep else re.sub(" {2,}", " ", line).strip(" ")
        self.now = []
        if line or keep and not self.items:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.append(self.first + line)
            self.first = self.rest

    def space(self) -> None:
        self.end()
        self.gap = not self.items

    def item(self, mark: str) -> tuple[str, str]:
        """Begin a list item; what is returned ends it."""
        self.end()
        before = self.first, self.rest
        self.first += mark if len(self.first) < INDENT else ""
        self.rest = (self.rest + " " * len(mark))[:INDENT]
        self.items += 1
        return before

    def item_end(self, before: tuple[str, str], lines: int) -> None:
        self.end()
        self.items -= 1
        self.first, self.rest = before if len(self.done) == lines else (before[1], before[1])


def _table(node: list) -> list[str]:
    """Rows of a table with cells padded to columns; lines of a cell are joined by blanks."""
    rows, todo = [], list(reversed(node[2]))
    before = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                before.append(" ".join(x.split()))
        elif x[1] and x[0] == "tr":
            before += [" ".join(c.split()) for c in x[2] if isinstance(c, str) and c.strip()]
            rows.append([(" ".join([y for y in render_lines(c) if y]), c[3]) for c in x[2] if not isinstance(c, str) and c[1]])
        elif x[1] and x[0] in ROWS - {"table"}:
            todo += reversed(x[2])
        elif x[1]:
            before += [y for y in render_lines(x) if y]
    rows = [r for r in rows if any(text for text, _ in r)]
    width: dict[int, int] = {}
    for r in rows:
        column = 0
        for text, span in r:
            width[column] = max(width.get(column, 0), len(text) if span == 1 else 0)
            column += span
    lines = []
    for r in rows:
        column, cells = 0, []
        for text, span in r:
            cells.append(text.ljust(sum(width.get(k, 0) for k in range(column, column + span)) + 2 * (span - 1)))
            column += span
        lines.append("  ".join(cells).rstrip())
    return before + lines


def render_lines(node: list) -> list[str]:
    """Visible lines of a node's content."""
    out = _Lines()
    _render(node, out, False)
    out.end()
    return out.done


def _render(node: list, out: _Lines, keep: bool) -> None:
    number = 0
    for x in node[2]:
        if isinstance(x, str):
            out.text(x, keep)
            continue
        tag = x[0]
        if not x[1]:
            continue
        if tag == "br":
            out.end(True)
        elif tag == "li":
            number += 1
            before, lines = out.item(f"{number}. " if node[0] == "ol" else "- "), len(out.done)
            _render(x, out, False)
            out.item_end(before, lines)
        elif tag == "table":
            out.space()
            for line in _table(x):
                out.now = [line]
                out.end(True)
            out.space()
        elif tag in BLOCK:
            (out.space if tag in SPACED else out.end)()
            _render(x, out, keep or tag == "pre")
            (out.space if tag in SPACED else out.end)()
        else:
            _render(x, out, keep)


def visible_text(page: str | None) -> str:
    """All visible text of a page; empty for null."""
    return "\n".join(render_lines(parse(page or ""))).strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id and text of every row of ``pages`` (page_id, html).

    Rows are rendered alone, so repeated rows, null ids and extra columns change nothing; a null page has an empty text, an empty table an
    empty result, and a very long page is rendered whole, in time that grows with its length. Elements are
    hidden by their names and attributes and by style sheets within the page (``_Sheet`` says which rules count).
    """

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "text": [visible_text(x) for x in batch["html"]]})

    return in_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(extracted, "page_id long, text string")
