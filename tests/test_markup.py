"""The page parser: against the standard library's parser on stored and generated pages, and its own closing rules."""

import html.parser

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.functions import markup as M
from pagelens.operators import blocks, links, media, meta
from pagelens.operators.parse import parsed


class Events(html.parser.HTMLParser):
    """Start tags (name, attributes with the last duplicate) and end tags, in order."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.seen, self.said = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag, {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        self.seen.append(("end", tag, None))

    def handle_data(self, data):
        if self.seen and self.seen[-1][0] == "start" and self.seen[-1][1] in ("script", "style"):
            return
        if data.strip():
            self.said.append(data.strip())


def ours(page):
    seen = []
    for kind, name, raw in M.tokens(page):
        if kind == "start":
            seen.append((kind, name, M.attributes(M._open_tag(raw))))
            if name in dims.RAW_TEXT_ELEMENTS and raw.lower().rstrip("> \n").endswith("</" + name):
                seen.append(("end", name, None))
        elif kind == "end":
            seen.append((kind, name, None))
    return seen


def test_stored_pages_against_the_standard_parser():
    n = 0
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet'").fetchall():
        want = Events(page)
        assert ours(page) == want.seen
        assert "".join("".join(M.parse(page)[2]).split()) == "".join("".join(want.said).split())
        n += len(want.seen)
    assert n > 100_000


PIECES = st.sampled_from(["<p>", "</p>", "<div class=a>", "</div>", "<b>", "</b>", "<i x='1' y=\"&lt;2\">", "</i>", "<br>", "<br/>", "<ul>", "<li>", "</li>", "</ul>", "<a href=/x?a=1&amp;b=2>",
                          "</a>", "<table>", "<tr>", "<td>", "</td>", "</tr>", "</table>", "text", " a &amp; b ", "1 < 2", "<!-- <p> -->", "<script>if (a<b) {'</p>'}</script>", "<style>p{}</style>",
                          "<h1>", "</h1>", "<h2>", "<option>", "<select>", "</select>", "<dl>", "<dt>", "<dd>", "</dl>", "&eacute;", "&#8364;", "\n", "<IMG SRC=a.png ALT='x > y'>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40))
def test_generated_pages(parts):
    page = "".join(parts)
    assert ours(page) == Events(page).seen
    assert "".join(t[2] for t in M.tokens(page)) == page
    n, _, texts, els = M.parse(page)
    for i, end, k, inside, t0, t1, name, _, body in els:
        assert i <= end <= n and 0 <= t0 <= t1 <= len(texts)
        # nested sets: the n elements that follow, and no others, lie inside
        assert [x[2] for x in els if i < x[0] < end] == list(range(k + 1, k + 1 + inside))
        for x in els[k + 1:k + 1 + inside]:
            assert x[1] <= end and t0 <= x[4] and x[5] <= t1


def structure(page):
    """Names with what they hold, as nested lists."""
    els = M.parse(page)[3]

    def of(k, n):
        out, at = [], k
        while at < k + n:
            out.append([els[at][6], *of(at + 1, els[at][3])])
            at += els[at][3] + 1
        return out

    return of(0, len(els))


@pytest.mark.parametrize("page,want", [
    ("<p>a<p>b<div>c</div>", [["p"], ["p"], ["div"]]),
    ("<p><b>a<br><p>c</b>", [["p", ["b", ["br"]]], ["p"]]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", [["ul", ["li", ["ul", ["li"], ["li"]]], ["li"]]]),
    ("<dl><dt>a<dd>b<dt>c</dl>", [["dl", ["dt"], ["dd"], ["dt"]]]),
    ("<select><option>a<option>b<optgroup><option>c</select>", [["select", ["option"], ["option"], ["optgroup", ["option"]]]]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", [["table", ["tr", ["td"], ["td"]], ["tr", ["td"]]]]),
    ("<table><tr><td><table><tr><td>n</table><td>x</table>", [["table", ["tr", ["td", ["table", ["tr", ["td"]]]], ["td"]]]]),
    ("<table><thead><tr><th>a<tbody><tr><td>b</table>", [["table", ["thead", ["tr", ["th"]]], ["tbody", ["tr", ["td"]]]]]),
    ("<a href=1>x<a href=2>y</a>", [["a"], ["a"]]),
    ("<h1>a<h2>b</h2>", [["h1"], ["h2"]]),
    ("<div><p>t</div><span>", [["div", ["p"]], ["span"]]),
    ("</b><form><form></form></form></form>", [["form", ["form"]]]),
    ("<p>a<table><tr><td><p>in</td></tr></table>", [["p"], ["table", ["tr", ["td", ["p"]]]]]),
])
def test_implied_and_outer_ends(page, want):
    assert structure(page) == want


def page_of(spark, text, *cols):
    df = spark.createDataFrame([("https://site.example.com/a/b", text)], "final_url string, html string")
    return parsed(df).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_text_that_is_no_markup(spark):
    page = ('<title>t</title><textarea name=x><a href="/no">no</a> &amp; y</textarea><xmp><a href="/no2"></xmp><![CDATA[ <a href="/no3"> ]]>'
            '<noscript>off <a href="/in">n</a></noscript><template>tpl</template>1<2<a href="/yes">yes</a><script>var s = "<a href=/no4>"; secret')
    r = page_of(spark, page, links.page_links(links.anchors()), F.col("text"), media.scripts_styles())
    assert [x.url for x in r.c0] == ["https://site.example.com/in", "https://site.example.com/yes"]
    assert r.c1 == 't <a href="/no">no</a> & y 1<2 yes'
    assert r.c2.inline_script_count == 1


def test_containment_is_linear_in_nesting(spark):
    rows = "".join(f"<tr><td>{i}<td><form><input name=a{i}><select><option>1</select></form>" for i in range(300))
    page = f"<table>{rows}</table><video src=v.mp4><source src=s1.mp4><p><source src=s2.mp4></video><source src=no.mp4>"
    r = page_of(spark, page, blocks.tables(), blocks.forms(), media.videos(), meta.headings())
    assert [(t.rows, t.columns_approx) for t in r.c0] == [(300, 2)]
    assert len(r.c1) == 300 and [[x.name for x in f.inputs] for f in r.c1[:2]] == [["a0", None], ["a1", None]]
    assert r.c2 == [f"https://site.example.com/a/{v}.mp4" for v in ("s1", "s2", "v")]


def test_empty_and_long_pages(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "<p>" * 20_000), (3, "<i>x</i>" * 20_000)], "page_id int, html string")
    got = {r.page_id: (r.ntok, len(r.els), len(r.texts)) for r in parsed(df).select("page_id", "ntok", "els", "texts").collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 2: (20_000, 20_000, 0), 3: (60_000, 20_000, 20_000)}


def test_every_page_is_parsed_once(spark):
    from pagelens.catalog import QUERIES

    for name in ("page_report", "seo_checks", "page_links", "forms"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name
    optimized = QUERIES["seo_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(optimized) < 400_000
