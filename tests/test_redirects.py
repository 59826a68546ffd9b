"""Redirect hops followed by doubling equal a walk hop by hop; many robots rules; references by bucket; streams of element sections."""

import html
import html.entities
import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pagelens.functions import html as H
from pagelens.operators import robots
from pagelens.session import scratch_path
from pagelens.sources import fixtures as FX
from pagelens.sources.pages import classify, with_envelope
from pagelens.sources.redirects import follow, with_redirects
from pagelens.streaming import stream as S

SF = "/root/testdata/sf0.001"


def walk(url, hop, most):
    chain = []
    while url in hop:
        chain.append(url)
        if len(chain) > most:
            return chain[0], [], f"Exceeded {most} redirects."
        url = hop[url]
    return url, chain, None


@pytest.mark.parametrize("most", [30, 3, 0])
def test_follow_equals_a_walk(spark, most):
    draw = random.Random(1)
    u = lambda k: f"https://h.example/{k}"
    hop = {u(k): u(k + 1) for k in range(100, 140)}  # chains of up to 40 hops
    hop |= {u(1): u(2), u(2): u(1), u(3): u(3), u(4): u(1)}  # loops, and a way into one
    hop |= {u(k): u("login") for k in range(200, 260)}  # a target of many
    hop |= {u(k): u(draw.randrange(300, 420)) for k in range(300, 400)}
    log = spark.createDataFrame([*hop.items(), (None, "x"), (u("none"), None)], "url string, location string")
    got = {r.url: (r.final_url, r.redirect_chain, r.error) for r in follow(log, most).collect()}
    assert got == {k: walk(k, hop, most) for k in hop}


def test_pages_take_their_redirects(spark):
    log = spark.createDataFrame([("https://h.example/a", "b"), ("https://h.example/l", "/l")], "url string, location string")
    pages = spark.createDataFrame([(k, f"https://h.example/{p}", "<p>x") for k, p in enumerate("abl")], "page_id int, url string, html string")
    got = {r.page_id: r for r in classify(with_envelope(with_redirects(pages, log))).collect()}
    assert (got[0].final_url, got[0].redirect_chain, got[0].redirected) == ("https://h.example/b", ["https://h.example/a"], True)
    assert (got[1].final_url, got[1].redirect_chain, got[1].redirected) == ("https://h.example/b", [], False)
    assert (got[2].outcome, got[2].outcome_reason) == ("error", "Exceeded 30 redirects.")
    assert follow(log.limit(0)).count() == 0


def test_many_rules_on_a_host(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("ab/") for _ in range(draw.randint(1, 7)))
    lines = [f"{draw.choice(['Allow', 'Disallow'])}: /{word()}" for _ in range(3000)] + ["Disallow: /é", "Allow: /%C3%A9/x"]
    body = "User-agent: *\n" + "\n".join(lines) + "\n"
    few = "User-agent: *\n" + "\n".join(lines[:5]) + "\n"
    rob = spark.createDataFrame([("many.example", 200, body), ("few.example", 200, few)], "host string, status_code int, body string")
    paths = ["/" + word() + word() for _ in range(300)] + ["/é/x", "/%C3%A9", "", "/"]
    urls = [f"https://{h}.example{p}" for h in ("many", "few") for p in paths]
    got = {r.url: r.allowed for r in robots.can_fetch(spark.createDataFrame([(u,) for u in urls], "url string"), robots.robots_rules(rob), "bot").collect()}
    for h, b in (("many", body), ("few", few)):
        rp = RobotFileParser()
        rp.parse(b.splitlines())
        assert {p: got[f"https://{h}.example{p}"] for p in paths} == {p: rp.can_fetch("bot", f"https://{h}.example{p}") for p in paths}


def test_every_named_reference(spark):
    names = sorted(html.entities.html5)
    cases = ["&" + n for n in names] + ["&" + n + "x" for n in names] + ["&copy", "&copyright", "&copy=1", "&notit;", "&notin;", "&nosuch;", "&ampamp;", "& &;"]
    df = H.with_entities(spark.createDataFrame([(c,) for c in cases], "s string"))
    got = {r.s: r.u for r in df.select("s", H.unescape(F.col("s")).alias("u")).collect()}
    assert got == {c: html.unescape(c) for c in cases}


def test_streamed_sections_equal_batch_after_a_restart(spark):
    pages, out, ck = (scratch_path(spark, f"t-sections-{n}") for n in ("in", "out", "ck"))
    whole = FX.block_pages(spark, SF)
    first, second = whole.filter("page_id % 2 = 0"), whole.filter("page_id % 2 = 1")
    first.repartition(3).write.parquet(pages)
    S.stream_sections(spark, pages, out, ck, files_per_batch=2)
    before = S.running_totals(spark, out).orderBy("batch").collect()
    assert len(before) == 2
    # the last batch is run again, as after a failure before it was noted as done: it replaces what it wrote
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ck}/commits/1")
    fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(fs, False)
    S.stream_sections(spark, pages, out, ck, files_per_batch=2)
    assert S.running_totals(spark, out).orderBy("batch").collect() == before
    second.repartition(2).write.mode("append").parquet(pages)
    S.stream_sections(spark, pages, out, ck, files_per_batch=2)
    want = S.element_sections(whole.select("page_id", "url", "html"))
    key = lambda df: sorted(repr(r) for r in df.select("page_id", "url", "words", "images", "forms", "tables", "links").collect())
    assert key(spark.read.parquet(f"{out}/sections")) == key(want)
    last = S.running_totals(spark, out).orderBy(F.desc("batch")).first()
    sums = want.agg(F.count(F.lit(1)), F.sum("words"), F.sum("images"), F.sum("links.internal_count"), F.sum("links.external_count"), F.sum(F.size("forms")), F.sum(F.size("tables"))).first()
    assert tuple(last)[1:] == tuple(sums)
