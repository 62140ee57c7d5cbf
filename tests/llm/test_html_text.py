import re
import time
from html.parser import HTMLParser

import pytest

from chronotile.llm import html_text
from chronotile.llm.html_text import visible_text


def test_blocks_and_inline():
    assert visible_text("<p>One  <b>two</b>\n three<p>Four<br>five</p><div>six</div><div>seven</div>tail") == "One two three\n\nFour\nfive\n\nsix\nseven\ntail"
    assert visible_text("<h1>A &amp; B</h1>x&nbsp;y") == "A & B\n\nx y"


def test_hidden():
    page = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>a<script>var t="</p>";</script><!-- c --><p hidden>b</p><span style="display: none">c</span><input type=text value=v><template>z</template>d'
    assert visible_text(page) == "ad"


def test_lists():
    assert visible_text("<ul><li>a<li>b<ol><li>c</li><li>d</ol></ul>e") == "- a\n- b\n  1. c\n  2. d\n\ne"


def test_table():
    page = "<table><caption>Cap</caption><thead><tr><th>Name<th>No<tbody><tr><td>long name<td>1<tr><td>x<td>22</table>after"
    assert visible_text(page) == "Cap\nName       No\nlong name  1\nx          22\n\nafter"


def test_pre_and_broken():
    assert visible_text("<pre>a\n  b\n\nc</pre>") == "a\n  b\n\nc"
    assert visible_text("a < b <i>c</b></i> <unclosed") == "a < b c <unclosed"
    assert visible_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert visible_text(None) == visible_text("") == ""


def test_table_of_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "c"), (1, "u", "<p>x", "c"), (None, "u", None, "c")], "page_id long, url string, html string, text string")
    assert sorted(map(str, html_text.extract_text(df).collect())) == ["Row(page_id=1, text='x')"] * 2 + ["Row(page_id=None, text='')"]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = html_text.extract_text(pages).collect()
    assert len(rows) == pages.count() and all("<" not in r.text and "track(" not in r.text for r in rows)


UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Words(HTMLParser):
    """Visible words of a page in order, by Python's own parser and no layout."""

    def __init__(self):
        super().__init__()
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        shown = tag not in html_text.HIDDEN and "hidden" not in at and not UNSEEN.search(at.get("style") or "")
        if tag in ("p", "li", "td", "th", "tr") and any(t == tag for t, _ in self.open[-1:]):
            self.open.pop()
        if tag not in html_text.VOID:
            self.open.append((tag, shown))
        if tag in html_text.BLOCK or tag == "br":
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass
        if tag in html_text.BLOCK:
            self.words.append(" ")

    def handle_data(self, data):
        if all(shown for _, shown in self.open):
            self.words.append(data)


def test_words_match_a_plain_parser(spark):
    marks = {"-"} | {f"{k}." for k in range(200)}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = Words()
        plain.feed(r.html or "")
        plain.close()
        want = [w for w in "".join(plain.words).split() if w not in marks]
        assert [w for w in visible_text(r.html).split() if w not in marks] == want, r.page_id


def test_broken_pages_take_time_in_proportion():
    start = time.time()
    for page in ("<a ", '<a href="', "<a x='>\"", '<a ">"', '<a x=">" ', "<!", "<!--", "</", "<b>", "<hr><i>", "<td>", "<li><b></td>", "<ul><li>"):
        visible_text(page * (100_000 // len(page)))
        visible_text(page * (100_000 // len(page)) + ">")
    assert time.time() - start < 40


def test_rules_of_visibility():
    assert visible_text("<p style=display:none>a</p><dialog>b</dialog><dialog open>c</dialog>d") == "c\nd"
    assert visible_text("<select><option>one<option selected>two</select>") == "one\ntwo"
    assert visible_text("<p title=it's>text</p><a href='x>y'>z</a> it's <b class=\"w>v\">more</b>") == "text\n\nz it's more"
    assert visible_text("a<p title=\"never closed>b</p>c") == "a\n\nb\n\nc"


def test_rows_that_are_left_out():
    assert visible_text("<table><td>a<td>b<tr><td>long<td>d</table>") == "a     b\nlong  d"
    assert visible_text("<table><tr><td colspan=2>both columns<tr><td>a<td>b</table>") == "both columns\na  b"


def test_deep_lists():
    assert visible_text("<ul><li><ul><li>x</ul><li><p>y<p>z</ul>w") == "- - x\n- y\n  z\n\nw"
    assert visible_text("<ul><li>a" * 3000).count("a") == 3000


def test_visible_text_is_not_lost():
    assert visible_text('<p title="the hidden cost">text</p><div class="menu hidden wide">more</div>') == "text\n\nmore"
    assert visible_text("<p class=a hidden>b</p><p style=\"color: red; display : none\">c</p><p style='backface-visibility: hidden'>d</p>") == "d"
    assert visible_text("<table><tr>Total<td>5</td></tr></table>") == "Total\n5"
    deep = "<div>" * 2000
    assert visible_text(deep + "<table><tr><td>a<td>b</table><p hidden>no</p>c") == "a  b\n\nc"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<style>.x{display:none}</style><p class='a x'>gone</p><p class=y>here</p>", "here"),
        ("<p class=x>gone</p><p>here</p><style>/* late */ .x , b.y#z {color:red; Display : NONE !important}</style>", "here"),
        ("<style>#a{display:none} p.b{visibility:hidden} i{display:none}</style><p id=a>1</p><p class=b>2</p><b class=b>3</b><i>4</i>", "3"),
        ("<style>.x{display:none} p.x{display:block} #k{display:none}</style><p class=x>a</p><div class=x>b</div><p class=x id=k>c</p>", "a"),
        ("<style>.x{display:none}.x{display:block}</style><p class=x>a</p>", "a"),
        ("<style>.x{display:none!important}</style><p class=x style='display:block'>a</p><p style='display:none'>b</p>", ""),
        ("<style media=print>p{display:none}</style><style>@media print{p{display:none}} @media screen{.x{display:none}} @import 'a'; .y{display:none}</style><p>a</p><p class=x>b</p><p class=y>c</p>", "a"),
        ("<style>ul li{display:none} a:hover{display:none} [x]{display:none} , {display:none}</style><ul><li><a x>a</a></ul>", "- a"),
        ("<div style='visibility:hidden'>a<p style='visibility: visible'>b<i style='visibility:collapse'>c</i></p>d</div>", "b"),
        ("<div style='display:none'><p style='visibility:visible;display:block'>b</p></div>c", "c"),
        ("<details><summary>s</summary>a<p>b</p></details><details open><summary>t</summary>c</details>", "s\nt\nc"),
        ("<div hidden>a</div><div hidden style='display:block'>b</div><textarea hidden>c</textarea><textarea>d</textarea>", "b\nd"),
        ("<style>{}}}{{{ p{display:none}</style><p>a</p>", "a"),
    ],
)
def test_visibility_rules(page, want):
    assert html_text.visible_text(page) == want


@pytest.mark.parametrize("page", ["<" * 300_000 + ">", "<ul><li>" * 20_000, "<style>" + "a{" * 300_000, "<style>" + "/*" * 300_000, "<style>a{" + "display:none;" * 60_000 + "}</style>", "</p>" * 200_000, "<a b='" * 50_000])
def test_time_grows_with_the_page(page):
    """Twice the page takes less than four times as long, with room for the machine."""

    def took(text):
        start = time.perf_counter()
        html_text.visible_text(text)
        return time.perf_counter() - start

    assert took(page) < 3.2 * took(page[: len(page) // 2]) + 1.0


def test_empty_table_and_repeats(spark):
    pages = spark.createDataFrame([(1, "<p>a", "c"), (1, "<p>a", "c"), (None, None, "c")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract_text(pages).collect()), key=str) == [(1, "a"), (1, "a"), (None, "")]
    assert html_text.extract_text(pages.limit(0)).count() == 0
