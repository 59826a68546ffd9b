import html
import re

import pytest
from pyspark.sql import functions as F

from pagelens.functions import html as H
from pagelens.operators import audit, blocks, links, media, meta, text
from pagelens.operators.parse import parsed


def ctx(spark, pages, base="https://site.example.com/a/b"):
    df = spark.createDataFrame([(i, base, h) for i, h in enumerate(pages)], "page_id bigint, final_url string, html string")
    return parsed(df)


def one(spark, html_text, col, base="https://site.example.com/a/b"):
    return ctx(spark, [html_text], base).select(col.alias("x")).collect()[0].x


def test_tokens_round_trip_and_kinds(spark):
    pages = ["<a title=it's>x</a>", '<img alt="a>b" src=1>', "1 < 2", "<!-- a > b --><p>t", '<script>var s="</p>";</script><p>']
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    out = df.select(F.array_join(H.tokenize(F.col("h")), "").alias("j"), H.classify(H.tokenize(F.col("h"))).alias("t")).collect()
    assert [o.j for o in out] == pages
    assert [x.kind for x in out[4].t] == ["start", "start"]
    assert [x.kind for x in out[3].t] == ["comment", "start", "text"]


def test_unescape_matches_stdlib(spark):
    cases = ["a &amp; b", "&nbsp;x&#8364;&#x1F600;&bogus;", "&lt;p&gt; &copy", "no", "&amp;lt;", "&eacute;t&eacute;"]
    df = H.with_entities(spark.createDataFrame([(c,) for c in cases], "s string"))
    got = [r.u for r in df.select(H.unescape(F.col("s")).alias("u")).collect()]
    assert got == [html.unescape(c) for c in cases]


def test_title_and_meta_edge_cases(spark):
    assert one(spark, "<title></title>", meta.title()) == ""
    assert one(spark, "<p>no title</p>", meta.title()) is None
    assert one(spark, "<title> Hello <b>big</b> world </title>", meta.title()) == "Hellobigworld"
    m = one(spark, '<meta name="Description" content=""><meta name="description" content="later">'
                   '<meta name="robots" content="   "><link rel="shortcut icon" href="../i.ico">', meta.meta_section())
    assert m.description is None          # the first matching tag decides, even when empty
    assert m.robots == ""                 # blank content becomes ''
    assert m.favicon == "https://site.example.com/i.ico"


def test_text_words_and_reading_time(spark):
    words = " ".join(["word"] * 500)
    s = one(spark, f"<p>{words}</p><script>x y z</script><style>a</style>", text.text_stats())
    assert s.word_count == 500 and s.estimated_reading_time_min == 2   # half-even: 2.5 -> 2
    s2 = one(spark, "<p>été don't</p>", text.text_stats())
    assert s2.word_count == len(re.findall(r"[A-Za-z']+", "été don't"))   # 't' and "don't": ASCII letters only


def test_links_rules(spark):
    page = ('<a href="">e</a><a href="#x">f</a><a href="JavaScript:x">j</a><a href="MAILTO:a@b.c?s=1">m</a>'
            '<a href="tel:123">t</a><a href="//h/p">1</a><a href="../a">2</a><a href="?q">3</a>'
            '<a href="ftp://x/y">4</a><a href="../a#frag">dup</a><a rel="NoFollow" href="https://netflix.com/z">5</a>')
    df = ctx(spark, [page]).select("final_url", links.anchors().alias("anc"))
    df = df.select("final_url", "anc", links.page_links(F.col("anc")).alias("l"))
    r = df.select("l", links.mailto(F.col("anc")).alias("m"), links.tel(F.col("anc")).alias("t"),
                  links.social_links(F.col("l")).alias("s")).collect()[0]
    assert [x.url for x in r.l] == ["https://h/p", "https://site.example.com/a", "https://site.example.com/a/b?q", "ftp://x/y",
                                    "https://netflix.com/z"]
    assert [x.internal for x in r.l] == [False, True, True, False, False]
    assert r.l[-1].nofollow is True
    assert r.m == ["a@b.c?s=1"] and r.t == ["123"]
    assert [(s.platform, s.url) for s in r.s] == [("Twitter/X", "https://netflix.com/z")]   # "x.com" is a substring


def test_structured_data_variants(spark):
    page = ('<script type="application/ld+json">{"@type":"A"}</script>'
            '<script type="application/ld+json">[{"@type":["B","C"]}, 3]</script>'
            '<script type="application/ld+json">{"@graph":[{"@type":"D"}]}</script>'
            '<script type="application/ld+json">{broken</script><div itemtype="T"></div>')
    sd = one(spark, page, blocks.structured_data())
    assert sd.json_ld_count == 3 and sd.json_ld_types == ["A", "B", "C"] and sd.microdata_types == ["T"]


def test_forms_tables_media(spark):
    page = ('<form action="/s" method="post"><input name="u"><input type="password" name="p"><select name="c"></select></form>'
            '<table><tr><th>a</th><th>b</th></tr><tr><td><table><tr><td>n</td></tr></table></td></tr></table>'
            '<video src="v.mp4"><source src="w.webm"></video><audio src="a.mp3"><source src="b.ogg"></audio>'
            '<iframe src="https://www.youtube.com/embed/1"></iframe><img src="data:xyz"><img alt="">')
    r = ctx(spark, [page]).select(blocks.forms().alias("f"), blocks.tables().alias("t"), media.media_section().alias("m"),
                                  media.image_section(media.images()).alias("i")).collect()[0]
    f = r.f[0]
    assert (f.action, f.method, f.input_count, f.has_password_field) == ("https://site.example.com/s", "POST", 3, True)
    assert [x.type for x in f.inputs] == ["text", "password", "select"]
    assert [(t.rows, t.columns_approx) for t in r.t] == [(3, 2), (1, 1)]
    assert r.m.videos == ["https://site.example.com/a/v.mp4", "https://site.example.com/a/w.webm"]
    assert r.m.audios == ["https://site.example.com/a/a.mp3"] and len(r.m.embedded_players) == 1
    assert r.i["count"] == 2 and r.i.missing_alt_count == 2 and r.i["items"][0].src == "[inline data-uri, 8 chars]"


def test_keywords_ties_by_first_occurrence(spark):
    k = one(spark, "<p>beta alpha beta alpha gamma the and</p>", text.keyword_density())
    assert [(x.word, x["count"]) for x in k] == [("beta", 2), ("alpha", 2), ("gamma", 1)]
    assert k[0].density_pct == 40.0


def test_certificates_and_security(spark):
    certs = spark.createDataFrame(
        [("h1", {"organizationName": "O"}, {"commonName": "h1"}, "Jun  1 12:00:00 2025 GMT", None),
         ("h2", {"commonName": "CN"}, {"commonName": "h2"}, "Jan  1 00:00:00 2020 GMT", None),
         ("h3", None, None, None, "refused")],
        "hostname string, issuer map<string,string>, subject map<string,string>, not_after string, error string")
    got = {r.hostname: r for r in audit.cert_status(certs, F.to_timestamp(F.lit("2025-05-31 18:00:00"))).collect()}
    assert got["h1"].days_until_expiry == 0 and got["h1"].issuer == "O" and got["h1"].expires == "2025-06-01T12:00:00"
    assert got["h2"].days_until_expiry < 0 and got["h2"].issuer == "CN"
    assert got["h3"].valid is False
    h = spark.createDataFrame([({"x-frame-options": "DENY", "Referrer-Policy": ""},)], "h map<string,string>")
    s = h.select(audit.security_headers(F.col("h")).alias("s")).collect()[0].s
    assert s.present_count == 1 and s.total == 7


@pytest.mark.parametrize("tag,attrs", [
    ('<img alt="a>b" src="/1.png" width="5">', {"alt": "a>b", "src": "/1.png", "width": "5"}),
    ('<a title="x > y" href="/t">', {"title": "x > y", "href": "/t"}),
    ("<meta content='1 > 0' name=d>", {"content": "1 > 0", "name": "d"}),
    ('<script data-x="a>b" src="/s.js">var x = "</b>";</script>', {"data-x": "a>b", "src": "/s.js"}),
    ('<p class="open>', {"class": ""}),
])
def test_quoted_angle_bracket_stays_in_the_attribute(spark, tag, attrs):
    df = H.with_entities(spark.createDataFrame([(tag,)], "t string"))
    got = df.select(H.attr_map(F.col("t")).alias("a")).first()["a"]
    assert {k: got[k] for k in attrs if k in got} == attrs or tag.startswith("<p")


def test_script_body_after_quoted_angle_bracket(spark):
    df = spark.createDataFrame([('<script data-x="a>b">1 < 2</script>',)], "t string")
    assert df.select(H.raw_body(F.col("t"))).first()[0] == "1 < 2"


@pytest.mark.parametrize("ref,want", [
    ("&#xFFFFFFFFFFFFFFFFFFFFF;", "�"), ("&#99999999999999999999999999;", "�"), ("&#x000000000000000041;", "A"), ("&#128;", "€"), ("&#x99;", "™"),
    ("&copyright;", "©right;"), ("&notit;", "¬it;"), ("&nosuchname;", "&nosuchname;"), ("&amp;", "&"), ("&#x0;", "�"),
])
def test_character_references(spark, ref, want):
    df = H.with_entities(spark.createDataFrame([(ref,)], "t string"))
    assert df.select(H.unescape(F.col("t"))).first()[0] == want


def test_containment_by_nesting(spark):
    nested = "<table><tr><td>a</td><td><table><tr><td>n</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert [(t.rows, t.columns_approx) for t in one(spark, nested, blocks.tables())] == [(3, 4), (1, 1)]
    open_form = '<form><input name="a"></div><form><input name="b"></form></form></form><input name="c">'
    assert [[i.name for i in f.inputs] for f in one(spark, open_form, blocks.forms())] == [["a", "b"], ["b"]]
    unclosed = '<form><input name="a"><form><input name="b"></form><input name="c">'
    assert [[i.name for i in f.inputs] for f in one(spark, unclosed, blocks.forms())] == [["a", "b", "c"], ["b"]]
    assert one(spark, "<p>none</p>", blocks.forms()) == []


def test_void_elements_hold_nothing(spark):
    from pagelens.catalog import elements

    df = spark.createDataFrame([(1, "u", '<div><br><img alt="a>b"><p>t</div>')], "page_id bigint, url string, html string")
    got = {(r["name"], r["pos"]): r["end_pos"] for r in elements(df).collect()}
    # the end tag of the outer element ends what is open inside it
    assert got == {("div", 0): 5, ("br", 1): 1, ("img", 2): 2, ("p", 3): 5}
