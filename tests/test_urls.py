from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagelens.functions import urls as U

BASES = ["https://a.example.com/b/c/d;p?q#f", "http://h.com", "https://h.com/", "http://h.com/dir/", "https://X.org/a/b.html?x=1"]
REFS = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g",
        "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h",
        "g/../h", "http:g", "https:g", "ftp://x/y#z", "mailto:a@b", "HTTPS://Other.com/p?", "//h2/p/../q", "a//b/../c", "///p", "?", "#"]


def test_resolve_matches_urljoin(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(rows, "b string, r string")
    out = df.select("b", "r", U.resolve(F.col("b"), F.col("r")).alias("x")).collect()
    bad = [(o.b, o.r, o.x, urljoin(o.b, o.r)) for o in out if o.x != urljoin(o.b, o.r)]
    assert bad == []
    assert len(out) == len(BASES) * len(REFS)


def test_seed_normalisation_and_parts(spark):
    df = spark.createDataFrame([("  example.com/x ",), ("ftp://h:21/p",), ("HTTP://User@Host.COM:80/p",)], "u string")
    got = df.select(U.normalize_url(F.col("u")).alias("n"), U.netloc(F.col("u")).alias("net"),
                    U.hostname(U.normalize_url(F.col("u"))).alias("host")).collect()
    assert [g.n for g in got] == ["https://example.com/x", "ftp://h:21/p", "HTTP://User@Host.COM:80/p"]
    assert got[1].net == "h:21" and got[2].host == "host.com" and got[0].net == ""
