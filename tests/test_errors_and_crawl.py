"""Errors kept to their section, unreadable URLs against the standard library, and crawls over an indexed corpus."""

import urllib.parse
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagelens.functions.urls import resolve_each, url_error
from pagelens.operators import crawl
from pagelens.plans import report as R
from pagelens.sources.pages import with_envelope

REFS = ["http://[bad/i", "http://[::1]/x", "http://[::1]:80/x?y=[z]", "//x]/f", "//[zz]/s", "/a[1]", "?q=[", "#[", "http://u:p@[::1]/", "a/b", "", "http://h]/", "https://[fe80::1%25en0]/", "x:[y"]


def test_url_errors_match_stdlib(spark):
    df = spark.createDataFrame([(r,) for r in REFS], "r string").select("r", url_error(F.col("r")).alias("e"))
    for r in df.collect():
        try:
            urllib.parse.urljoin("https://site.example.com/a", r.r)
            assert r.e is None, r
        except ValueError as said:
            assert r.e == str(said), r


def test_each_reference_resolved(spark):
    refs = ["../x", "b?q", "//o/p", "https://z/", "", None, "#f"]
    df = spark.createDataFrame([("https://site.example.com/a/b", refs), (None, ["x"]), ("http://[bad/", ["x", ""])], "base string, refs array<string>")
    got = [r.u for r in df.select(resolve_each(F.col("base"), F.col("refs"), lambda x: x, lambda x, u, e: F.struct(u.alias("u"), e.alias("e"))).alias("u")).collect()]
    assert [x.u for x in got[0]] == [None if x is None else urllib.parse.urljoin("https://site.example.com/a/b", x) for x in refs]
    assert [x.e for x in got[0]] == [None] * len(refs)
    assert [x.u for x in got[1]] == ["x"]
    assert [x.e for x in got[2]] == ["Invalid IPv6 URL", None]


def test_one_bad_url_costs_one_section(spark):
    good = '<title>T</title><link rel=icon href=/i.ico><h1>H</h1><a href=/a>a</a><img src=/b.png alt=b><form action=/f></form><script src=/s.js></script><video src=/v></video>'
    bad = {"meta": "<link rel=icon href='http://[x'>", "links": "<a href='http://x]'>l</a>", "images": "<img src='//[x'>", "media": "<audio src='//[x'>",
           "scripts_styles": "<script src='//[x'></script>", "forms": "<form action='//[x'></form>"}
    pages = [("none", good)] + [(k, v + good) for k, v in bad.items()] + [("all", "".join(bad.values()) + good)]
    df = spark.createDataFrame([(i, f"https://site.example.com/{k}", h) for i, (k, h) in enumerate(pages)], "page_id bigint, url string, html string")
    rows = {r.url.rsplit("/", 1)[1]: r for r in R.analyze(with_envelope(df)).collect()}
    whole = rows["none"].asDict(recursive=True)
    assert rows["none"]["_errors"] == [] and whole["links"]["total"] == 1 and whole["meta"]["favicon"] == "https://site.example.com/i.ico"
    for k in bad:
        r = rows[k].asDict(recursive=True)
        assert r["_errors"] == [f"{k}: Invalid IPv6 URL"]
        for other in ("headings", "tables", "structured_data", "keyword_density"):
            assert r[other] == whole[other] or other == "keyword_density"
        for other in ("meta", "links", "images", "media", "scripts_styles", "forms"):
            if other != k:
                assert r[other] == whole[other], (k, other)
    assert rows["meta"].meta is None and rows["links"].links.total == 0 and rows["images"].images["count"] == 0 and rows["forms"].forms == []
    assert rows["media"].media.videos == [] and rows["scripts_styles"].scripts_styles.external_scripts == []
    assert [e.split(":")[0] for e in rows["all"]["_errors"]] == list(bad)
    assert rows["all"].headings.h1 == ["H"] and rows["all"].seo.total > 0


@pytest.mark.parametrize("budget,depth", [(7, 5), (100, 2), (1, 3), (40, 9)])
def test_crawl_over_index(spark, tmp_path, budget, depth):
    n = 60
    links = {i: [(3 * i + 1) % n, (5 * i + 2) % n, i, (i + 7) % n] for i in range(n)}
    url = "https://g.example.com/p/{}".format
    rows = [(i, url(i), None if i % 11 == 10 else "".join(f'<a href="/p/{j}#x">l</a>' for j in links[i]) + "<a href=https://o.example.com/>o</a>",
             None if i % 11 == 10 else 200, "application/pdf" if i % 13 == 12 else "text/html", "refused" if i % 11 == 10 else None) for i in range(n) if i != 17]
    pages = with_envelope(spark.createDataFrame(rows, "page_id bigint, url string, html string, status_code int, content_type string, error string"))
    index = crawl.index_corpus(pages, str(tmp_path / "index"), buckets=8)
    recs, _ = crawl.crawl(spark, None, None, url(0) + "#top", depth, budget, index=index)
    kind = {i: "error" if i % 11 == 10 or i == 17 else "skipped" if i % 13 == 12 else "ok" for i in range(n)}
    want, seen, queue = [], set(), deque([(0, 0)])
    while queue and len(want) < budget:
        i, d = queue.popleft()
        if i in seen:
            continue
        seen.add(i)
        want.append((len(want) + 1, url(i), d, kind[i]))
        if kind[i] == "ok" and d < depth:
            queue.extend((j, d + 1) for j in dict.fromkeys(links[i]))
    assert sorted((r.seq, r.url, r.depth, r.outcome) for r in recs.collect()) == want
    plan = crawl.read_index(spark, index, spark.createDataFrame([(url(0),)], "url string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]
