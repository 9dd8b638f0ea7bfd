"""HTML extraction against texts written by hand, and against a plain tag strip on real pages."""

import html
import re
import time

import pytest

from siftwell.llm.html import extract_html, visible_text

CASES = {
    "": "",
    "just text &amp; more": "just text & more",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b <b>c</b>  d</div>": "a\nb c d",
    "<h1>T</h1><div>x<br>y</div>": "T\n\nx\ny",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>end": "- a\n- b\n  - c\n- d\n\nend",
    "<ol start=9><li>a</li><li>b</li></ol>": "9. a\n10. b",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><tr><td colspan=2>wide cell<tr><td>x<td>y</table>": "wide cell\nx  y",
    "<p hidden>no</p><p style='DISPLAY : none'>no</p><p style='display:none-such'>yes</p>": "yes",
    "<head><title>t</title></head><body>b<script>var x='</p>'</script><style>p{}</style><!-- c --></body>": "b",
    "<pre> a\n   b</pre>": " a\n   b",
    "<dl><dt>k<dd>v<dt>k2<dd>v2</dl>": "k\n  v\nk2\n  v2",
    "a</p>b": "a\n\nb",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in  out",
    "<td>stray</td>": "stray",
    "<p>unclosed <b>bold": "unclosed bold",
    "<p>a <svg class=i /> b</p><p>c": "a b\n\nc",
    "<body><math/>all <svg/>the <i>page</i>": "all the page",
    "<head><title>t</title>Hello <a>x</a> <b>y</b>": "Hello x y",
    "<head><meta charset=x><script>s</script><span>a</span> b<p>c": "a b\n\nc",
    "<head><title>t</title><template><div>no</div></template></head>a<head>b": "ab",
    "a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b": "a x=2 b",
    "a<svg>no<title>no</title><desc>no</desc><g><path/><text>l<tspan>m</tspan></text><text>n</text></g></svg>b": "a\nlm\nn\nb",
    "a<svg><defs><text>no</text></defs><foreignObject><p>in<br/>side</p></foreignObject></svg>b": "a\n\nin\nside\n\nb",
    "<svg><g><p>out</p> of it": "out\n\nof it",
    "<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td>c<td>d</table>": "A  b1\n   b2\nc  d",
    "<table><tr><td>x<td rowspan=2 colspan=2>big<td>y<tr><td>z<td>w</table>": "x  big  y\nz       w",
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>z": "yes\nz",
    "a<details>no<summary>s</summary><p>no</p></details><details open><summary>t</summary>in</details>": "a\ns\nt\nin",
    "<dialog>no</dialog><dialog open>yes</dialog>": "yes",
    "<ol><li value=5>a<li>b</ol>": "5. a\n6. b",
    "a<!-->b<!--->c<!-- x --!>d<!-- > -- ->e-->f": "abcdf",
    "a <!-- never closed <p>b": "a",
    "<script>x = '<!--'</script>b <i title='<!--'>c</i><!-- d -->": "b c",
    "<p don't>it's <b a=\"x>y\">so</b>": "it's so",
    "a <b title=\"cut off": "a",
    "<textarea><!-- kept --></textarea>": "<!-- kept -->",
    "a<![CDATA[ b > c ]]>d<![if x]>e<![CDATA[ cut off": "a c ]]>de",
    "<pre>\n a\n\nb</pre>": " a\n\nb",
    "<ol reversed><li>a<li>b<li>c</ol>": "3. a\n2. b\n1. c",
    "<ol type=a start=26><li>x<li>y</ol><ol type=I><li>p<li value=1994>q</ol>": "z. x\naa. y\n\nI. p\nMCMXCIV. q",
    "<select><optgroup label='G 1'><option>a<option>b</optgroup></select>": "G 1\na\nb",
}


@pytest.mark.parametrize("page", CASES)
def test_case(page):
    assert visible_text(page) == CASES[page]


@pytest.mark.parametrize("part", ["<!--", "<a ", "<a b='", "<", "</", "<?", "<!x", "<![CDATA[", "<![CDATA[>", "&a", "<b>", "<li>", "<p><b>", "<table><td>", "<script>", "<svg>", "<ul><li>", "<b></i>", "<td rowspan=9999 colspan=1000>x"])
def test_long_broken_pages_take_no_longer(part):
    def seconds(n):
        began = time.perf_counter()
        visible_text("<table><td>" + part * n)
        return time.perf_counter() - began

    least = min(seconds(2000) for _ in range(3))
    assert seconds(16000) < 8 * 3 * least + 0.3


def test_deep_nesting():
    assert visible_text("<div>" * 20000 + "x") == "x"


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    pages = pages.union(spark.createDataFrame([(None, None), (-1, ""), (-2, "<p>a</p>"), (-2, "<p>a</p>")], "page_id long, html string"))
    found = extract_html(pages, ["page_id"]).collect()
    assert len(found) == pages.count()
    texts = {r.page_id: r.text for r in found}
    assert texts[None] == "" and texts[-1] == "" and texts[-2] == "a"

    def letters(s):
        return sorted(re.sub(r"\s|\d+\. |- ", "", s))

    for r in pages.where("page_id >= 0").collect():
        body = re.sub(r"(?s)<(script|style|head|title|noscript|template)\b.*?</\1>|<!--.*?-->", " ", r.html)
        if "hidden" not in body and "display" not in body and "<svg" not in body:
            assert letters(texts[r.page_id]) == letters(html.unescape(re.sub("<[^>]*>", "", body))), r.page_id


def test_empty_table(spark):
    assert not extract_html(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).collect()


@pytest.mark.parametrize(("page", "letters"), [
    ("<table><tr><td>" + "x" * 20_000 + "<tr><td>a<td>b" * 5000, 30_000),
    ("<table><tr><td rowspan=1000 colspan=1000>q" + "<tr><td>r" * 2000, 2001),
    ("<table><tr>" + "<td colspan=1000>c" * 300, 300),
    ("<table>" + "<tr><td rowspan=1000 colspan=1000>c" * 300, 300),
    ("<table><tr><td>" + "y" * 79 + "<tr><td><td>z" * 3000, 3079),
    ("<table><tr>" + "<td>" + "<tr><td><td><td>w<td rowspan=3>v" * 2000, 4000),
    ("<table><tr><td>" + ("l<br>" * 3000) + "<td>" + "m" * 500 + "<td>n", 3501),
])
def test_padding_is_bounded_and_loses_no_letter(page, letters):
    began = time.monotonic()
    text = visible_text(page)
    assert sum(c.isalpha() for c in text) == letters and len(text) < 10 * len(page) and time.monotonic() - began < 5


def test_simple_tables_and_lists_equal_a_plain_renderer():
    """Columns two spaces apart, as wide as their widest cell; lists with their marks."""
    import random

    rng = random.Random(7)
    for _ in range(40):
        n = rng.randrange(1, 5)
        cells = [["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(n)] for _ in range(rng.randrange(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells) + "</table>"
        wide = [max(len(row[i]) for row in cells) for i in range(n)]
        assert visible_text(page) == "\n".join("  ".join(c.ljust(w) for c, w in zip(row, wide, strict=True)).rstrip() for row in cells)
        items = ["".join(rng.choices("abc", k=3)) for _ in range(rng.randrange(1, 12))]
        tag = rng.choice(("ol", "ul"))
        assert visible_text(f"<{tag}>" + "".join(f"<li>{x}" for x in items) + f"</{tag}>") == "\n".join((f"{i}. " if tag == "ol" else "- ") + x for i, x in enumerate(items, 1))
