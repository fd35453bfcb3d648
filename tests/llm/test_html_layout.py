import pytest
from pyspark.sql import functions as F

from tagloom.llm.html_layout import events, extract_text, visible_text

CASES = [
    ("", ""), ("plain &lt;b&gt; &eacute;", "plain <b> é"), ("<p>one<p>two", "one\n\ntwo"), ("a<div>b</div>c", "a\nb\nc"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("x <b> y</b>z  \n w", "x yz w"), ("<h1>T</h1>text", "T\n\ntext"), ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
    ("<ul><li><p>a</p></ul>", "- a"), ("<table><tr><th>Name<th>N<tr><td>Bo<td>7<tr><td>Alexa<td>12</table>", "Name   N\nBo     7\nAlexa  12"),
    ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide     x\na     b  c"), ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本   x\nabcde  y"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a in  ner  b"), ("<td>loose</td>", "loose"),
    ("<div style='color:red; Display : NONE'>no</div><p hidden>no<p>yes", "yes"), ("<span style=visibility:hidden>no <b>no</b></span>yes", "yes"),
    ("<head><title>t</title></head><script>if (a<b) '</p>'</script><style>p{}</style><noscript>n</noscript>yes", "yes"),
    ("<details><summary>s</summary>no<p>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"), ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("a<!-- <p>no -->b<!-- open", "ab"), ("1 < 2 and 3 <4", "1 < 2 and 3 <4"),
    ("<p title='a>b' data-x=\"<i>\">t</p>", "t"), ("<a title=\"never ends>x<p>y", "x\n\ny"), ("<b", "<b"), ("</p></table></li>x", "x"), ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
]


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>T</title><p>Hello</html>", "Hello"), ("<head><meta charset=utf-8><title>T</title>\n Hello <b>you</b>", "Hello you"),
    ("<head><script>x</script><style>y</style><template><p>no</template><noscript><img>no</noscript><link rel=a>\n<div>yes", "yes"),
    ("<html><head><title>T</title></head>Hello", "Hello"), ("<head><head><title>T</title><h1>a</h1>b", "a\n\nb"), ("<head>1 < 2", "1 < 2"), ("<head></br>a", "\na"), ("<head>&amp;", "&"),
])
def test_head_without_end(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding=tex>x=2</annotation></semantics></math> holds", "so x=2 holds"),
    ("<p>a<svg viewBox='0 0 9 9'><title>no</title><desc>no</desc><style/><defs><text>no</text></defs>no<g><text x=1>North</text><path d=''/><text>So<tspan>uth</tspan></text>"
     "<text display=none>no</text></g><foreignObject><p>in</p></foreignObject></svg>b", "a North South\n\nin\n\nb"),
    ("<svg><path><p>out", "out"), ("a <svg><text>b</text><svg>no</svg></svg> c", "a b c"),
    ("<p>a<textarea rows=2>\nx &lt;b&gt;\n  y</textarea>b", "a x <b>\n  y b"), ("<textarea>open", "open"),
    ("say <select><option>a<option selected>b <i>c</i><option>d</select>.", "say b c ."), ("<select><option disabled>no<option>yes<option>no</select>", "yes"),
    ("<select><optgroup label=g disabled><option>no</optgroup><option label=L>no</select>x", "L x"),
    ("<select multiple><optgroup label=g><option>a<option>b</select>", "g a b"), ("<select size=2><option>a<option hidden>no<option>b</select>", "a b"),
    ("<select hidden><option>no</select><datalist><option>no</datalist><textarea style='display:none'>no</textarea><select></select>x", "x"),
])
def test_shown_elements(html, text):
    assert visible_text(html) == text
    opened = [k for k, _, _ in events(html)]
    assert opened.count("open") == opened.count("close")


@pytest.mark.parametrize("html, text", CASES)
def test_layout(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html", [h for h, _ in CASES] + ["<p><table><li></p><td></ul></b><i>"])
def test_events_are_balanced(html):
    stack = []
    for kind, name, _ in events(html):
        if kind == "open":
            stack.append(name)
        elif kind == "close":
            assert stack.pop() == name
    assert not stack


def test_deep_and_long_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert visible_text("<ul><li>" * 300 + "x").endswith("- x")
    assert visible_text("<p>" * 20_000 + "<" * 20_000 + 'a "' * 5_000).startswith("<<<")
    assert len(visible_text("word " * 400_000)) == 5 * 400_000 - 1


def test_rows(spark):
    rows = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None), (2, "")], "page_id long, html string").withColumn("text", F.lit("clash"))
    assert sorted([(r.page_id, r.text) for r in extract_text(rows).collect()], key=repr) == sorted([(1, "a"), (1, "a"), (None, None), (2, "")], key=repr)
    assert extract_text(rows.limit(0)).collect() == [] and extract_text(rows.select("html")).columns == ["text"]


def test_query_leaves_no_markup(spark):
    from tagloom.llm.queries import QUERIES

    out = QUERIES["op7_html_text"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 50 and all(r.text and "<p>" not in r.text and "track(" not in r.text and "margin:0" not in r.text for r in out)
