from __future__ import annotations

import random
import re
import time

import pytest

from rowferry.llm import html_text

CASES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<b>a</b> <i>b</i>c", "a bc"),
    ("  a \n\t b&amp;c&nbsp;d  ", "a b&c\xa0d"),
    ("<ul><li>a<li>b<ol start=4><li>c<li>d</ol></ul>", "- a\n- b\n\n  4. c\n  5. d"),
    ("<table><tr><th>Name<th>Age<tr><td>Al<td>7<tr><td>Barbara<td>10</table>", "Name     Age\nAl       7\nBarbara  10"),
    ("<table><caption>C</caption><tbody><tr><td>a<br>b</td><td>c</td></tr></table>", "C\na  c\nb"),
    ("<pre>\n a\n   b</pre>", " a\n   b"),
    ("<head><title>t</title></head><script>if (a<b) '<p>'</script><style>p{}</style>x", "x"),
    ("<div hidden>a</div><p style='color:red; DISPLAY : none'>b</p><p style=\"visibility:hidden\">c</p>d", "d"),
    ("<template>a</template><noscript>b</noscript><dialog>c</dialog><dialog open>d</dialog>", "d"),
    ("a<!-- b --><!DOCTYPE html>c", "ac"),
    ("<p title=it's>y</p><a href='x>y'>z</a>", "y\n\nz"),
    ("a</div></p>b<unknown>c</unknown>", "abc"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<script>never closed", ""),
    ("1 < 2 and a<3", "1 < 2 and a<3"),
    ("", ""),
    (None, None),
]


OPEN_HEADS = [
    ("<head><title>T</title><body><p>Hello", "Hello"),
    ("<html><head><title>T</title>\n<meta charset=x><script>s</script><p>Hello</p>", "Hello"),
    ("<head><link rel=x><style>p{}</style> Hello <b>you</b></head> there", "Hello you there"),
    ("<head><noscript><p>n</noscript><template>t</template><title>T</title><div>Hello</div>", "Hello"),
    ("<head><head><title>T</title><body>Hello", "Hello"),
    ("<head><title>T</title>&nbsp;<i>x</i>", "\xa0x"),
    ("<head><body class=x><ul><li>a</ul>", "- a"),
    ("<head> <!-- c --> <title>T</title> </head> ", ""),
]


@pytest.mark.parametrize("page,text", OPEN_HEADS)
def test_heads_without_end(page, text):
    assert html_text.page_text(page) == text


TABLES = [
    ("<table><tr><td>a</td></tr>Foo</table>", "Foo\na"),
    ("<table><tr><td>a</td></tr><caption>C</caption><tr><td>b</td></tr></table>", "C\na\nb"),
    ("<table><tbody><tr><td>a</td></tr><div>x <b>y</b></div></tbody><tfoot>z<tr><td>c</table>", "x y\nz\na\nc"),
    ("<table><thead>h<tr><td>a</thead><tbody hidden>no<tr><td>no</table>", "h\na"),
    ("<table><tr><td>a<td>b</tr><form><tr><td>ccc</td><td>d</td></tr></form></table>e", "a    b\nccc  d\n\ne"),
    ("<table><form><tr><td>a<td>b<tr><td>ccc<td>d</form></table>", "a    b\nccc  d"),
    ("<table><tr><td>a</td></tr><div>x<tr><td>b</table>", "x\na\nb"),
    ("<table><colgroup><col><col><tr><td>a<td>b<tr><td>ccc<td>d</table>", "a    b\nccc  d"),
    ("<table><colgroup>Foo<tr><td>a</table>", "Foo\na"),
    ("<table><tr><td><form>a</form><td>b</table>", "a  b"),
    ("<table><tr><td><table><tr><td>a</td></tr>Foo</table></td></tr>Bar</table>", "Bar\nFoo\na"),
    ("<table><tr><td>a</td></tr><template><tr><td>t</template><tr><td>b</table>", "a\nb"),
]


@pytest.mark.parametrize("page,text", TABLES)
def test_text_between_rows(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize("page,text", CASES)
def test_rendering(page, text):
    found = html_text.page_text(page)
    assert (found.lstrip("\n") if found and "<pre>" not in page else found) == text


def test_deep_and_long_pages():
    assert html_text.page_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html_text.page_text("<ul><li>" * 5_000 + "x").endswith("x")
    assert len(html_text.page_text("<p>" + "word " * 200_000)) == 999_999


@pytest.mark.parametrize("depth", [10, 200, 5_000])
@pytest.mark.parametrize("opened", ["<div>", "<b>", "<font size=2>", "<section><i>"])
def test_deep_elements_are_elements(opened, depth):
    deep = opened * depth
    assert html_text.page_text(deep + "a<script>s</script><style>p{}</style><template>t</template>b") == "ab"
    assert html_text.page_text(f"{deep}<span hidden>no<u>no</u></span>yes") == "yes"
    assert html_text.page_text(f"<div hidden>{deep}<div>no</div>no</div>") == ""
    assert html_text.page_text(f"{deep}<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "- a\n- b\n\nc  d"
    assert html_text.page_text(f"{deep}<pre>{deep}x\n y</pre>z") == "x\n y\n\nz"


def test_many_open_elements_take_no_long_search():
    page = "<p><td>" + "<i>" * 50_000 + "<div>x</div></b>" * 50_000
    assert html_text.page_text(page) == "\n".join(["x"] * 50_000)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>a<!-->b</p><p>c</p>", "ab\n\nc"),
        ("<p>a<!--->b</p>", "ab"),
        ("<p>a<!-- x --!>b<!-- y -->c", "abc"),
        ("<p>a<!-- never ended <b>c", "a"),
        ("<p>a<!--x>b-->c", "ac"),
    ],
)
def test_ends_of_comments(page, text):
    assert html_text.page_text(page) == text


def test_long_blank_pages():
    start = time.perf_counter()
    assert html_text.page_text("<br>" * 200_000) == ""
    assert html_text.page_text("<br>" * 100_000 + "x" + "<p> " * 100_000) == "x"
    assert time.perf_counter() - start < 10


def test_spans_shift_other_cells():
    table = "<table><tr><th colspan=2>A<th>B<tr><td>x1<td>x2<td>x3<tr><td rowspan=2>y1<td>y2<td>y3<tr><td>z2<td>z3</table>"
    assert html_text.page_text(table) == "A       B\nx1  x2  x3\ny1  y2  y3\n    z2  z3"
    wide = "<table><tr><td colspan=2>a long heading<td>n<tr><td>1<td>2<td>3</table>"
    assert html_text.page_text(wide) == "a long heading  n\n1  2            3"
    assert html_text.page_text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == "a  b\n   c\n   d"
    assert html_text.page_text("<table><tr><td colspan=x rowspan=-1>a<td colspan=0>b</table>") == "a  b"


def slots(rows):
    """label -> column, by marking every slot of the grid."""
    taken, found = set(), {}
    for r, cells in enumerate(rows):
        column = 0
        for label, columns, spanned in cells:
            while (r, column) in taken:
                column += 1
            found[label] = column
            taken |= {(y, x) for y in range(r, min(len(rows), r + (spanned or len(rows)))) for x in range(column, column + columns)}
            column += columns
    return found


def test_aligned_cells_against_a_marked_grid():
    choice = random.Random(2)
    for _ in range(400):
        rows, number = [], 0
        for _ in range(choice.randint(1, 6)):
            cells = []
            for _ in range(choice.randint(2, 5)):
                number += 1
                cells.append((f"c{number}" + "w" * choice.randint(0, 6) + ";", choice.choice([1, 1, 1, 2, 3]), choice.choice([1, 1, 1, 2, 3, 0])))
            rows.append(cells)
        page = "".join("<tr>" + "".join(f"<td colspan={c} rowspan={r}>{label}</td>" for label, c, r in cells) for cells in rows)
        lines = html_text.page_text(f"<table>{page}</table>").split("\n")
        assert [re.findall(r"\S+", line) for line in lines] == [[label for label, _, _ in cells] for cells in rows]
        at: dict[int, set[int]] = {}
        for label, column in slots(rows).items():
            at.setdefault(column, set()).add(next(line.index(label) for line in lines if label in line))
        places = [at[column] for column in sorted(at)]
        assert all(len(p) == 1 for p in places) and places == sorted(places, key=min) and len(set().union(*places)) == len(places)


def test_many_spans_take_no_long_search():
    start = time.perf_counter()
    page = "<table>" + "<tr><td rowspan=65534>a<td colspan=1000>b" * 5_000 + "</table>"
    assert html_text.page_text(page).count("b") == 5_000
    assert time.perf_counter() - start < 30


def test_table(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    found = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert found == {ident: html_text.page_text(page) for ident, page in html.items()}
    assert not any("<p>" in text or "margin:0" in text or "track(" in text for text in found.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "<p>x", "b"), (1, "", "c")], "page_id bigint, html string, text string")
    found = [tuple(r) for r in html_text.extract_text(df).collect()]
    assert sorted(found, key=str) == sorted([(1, None), (None, "x"), (1, "")], key=str)
    assert html_text.extract_text(df.limit(0)).count() == 0
