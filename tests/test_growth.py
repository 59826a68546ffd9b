"""What grows with the tables: tasks, and not the rows of a task, the objects of a batch or the steps of a plain URL."""

import random
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import functions as F

from pagelens import session
from pagelens.functions import markup as M
from pagelens.functions import urls as U
from pagelens.operators import robots

PIECES = ["<p>", "</p>", "<b x='1'>", "</b>", "<ul>", "<li>", "</ul>", "<script a='>'>", "</script >", "<textarea>", "</TEXTAREA>", "<title>", "</title>", "a &amp; b", "<", ">", "'", "<!-- c -->",
          "<![CDATA[x]]>", "<!doctype html>", " ", "<noscript>", "</noscript>", "<tr>", "<td>", "<table>", "</table>", "<br/>", "<a href=/x>", "<a b=\"", "é"]


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    df = session.read_table(spark, str(tmp_path), "t")
    assert df.rdd.getNumPartitions() == 100
    assert sorted(r.id for r in df.collect()) == list(range(1000))


def test_a_batch_is_worked_off_in_slices(monkeypatch):
    r = random.Random(3)
    pages = pa.array(["".join(r.choice(PIECES) for _ in range(r.randint(0, 20))) for _ in range(300)] + [None, ""])
    whole, toks, held, one = M._parsed(pages), M._tokenized(pages), [], M._parsed_slice
    monkeypatch.setattr(M, "SLICE_CHARS", 500)
    monkeypatch.setattr(M, "_parsed_slice", lambda part: held.append(sum(map(len, part))) or one(part))
    assert M._parsed(pages).equals(whole) and M._tokenized(pages).equals(toks)
    assert len(held) > 10 and max(held) <= 500
    assert M._parsed(pa.array([], pa.string())).type == whole.type


def test_rows_of_a_batch_are_few(spark):
    session.ensure_conf(spark)
    seen = F.arrow_udf(lambda c: pa.array([len(c)] * len(c), pa.int32()), "int")
    assert spark.range(3000).coalesce(1).select(seen("id").alias("n")).agg(F.max("n")).first()[0] <= 500


def test_one_pass_reads_the_same_tokens():
    r = random.Random(4)
    for _ in range(3000):
        page = "".join(r.choice(PIECES) for _ in range(r.randint(0, 20)))
        toks, (n, _, _, els) = M.tokens(page), M.parse(page)
        assert n == len(toks)
        assert [(e[0], e[6]) for e in els] == [(i, name) for i, (kind, name, _) in enumerate(toks) if kind == "start"]


def test_short_ways_of_resolution_match_urljoin(spark):
    bases = ["https://h.example/a/b?x#y", "http://u@h.example:80", "HTTP://H.example/x/", "/only/path", "ftp://h.example/a/"]
    refs = ["/p/1", "/p/1#x", "/p?q=1", "/", "//other/x", "/a/../b", "/a/./b", "/.w", "/a//b", "/a?", "/a#", "/a:b;c", "https://x.example", "https://x.example/", "https://x.example?", "https://x.example/a/../b?q#f",
            "http://x.example/a#", "HTTPS://x.example/a", "x/y", "?q", "#f", "../z", "mailto:a@b", "/t\tu", "https://x.example/a\nb"]
    rows = [(b, [{"r": r} for r in refs]) for b in bases]
    df = spark.createDataFrame(rows, "base string, items array<struct<r:string>>")
    got = df.select("base", U.resolve_each(F.col("base"), F.col("items"), lambda x: x["r"], lambda x, url, bad: url).alias("urls"))
    slow = df.select("base", F.transform("items", lambda x: U.resolve(F.col("base"), x["r"])).alias("urls"))
    assert got.collect() == slow.collect()
    for r in got.filter("base LIKE 'http%'").collect():
        for ref, url in zip(refs, r.urls):
            assert url == urljoin(r.base, ref), (r.base, ref)


def test_quoted_signs_and_first_rules(spark):
    texts = ["/a b+c*d~e", "/é?x=1#f", "(!')$&,;:@=", "\U0001f600/%", "", "/\x00\x7f\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(robots.pct_quote(F.col("t"))).collect()] == [quote(t) for t in texts]
    rules = [(5, "/b", False), (2, "/a", True), (3, "*", False), (4, "/a/b", False)]
    table = spark.createDataFrame([("h", k, ["*"], True, n, allow, path) for k, (n, path, allow) in enumerate(rules) for k in [1]],
                                  "host string, entry int, agents array<string>, is_default boolean, rule_no int, allow boolean, path string")
    urls = spark.createDataFrame([(f"https://H{p}",) for p in ("/a/b", "/b", "/c")], "url string")
    assert {r.url[-4:].lstrip("/H:"): r.allowed for r in robots.can_fetch(urls, table, "x").collect()} == {"a/b": True, "b": False, "c": False}
