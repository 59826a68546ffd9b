"""Input tables derived from the driver's relational tables.

The driver ships stored pages, but they hold few element kinds; the other inputs (pages with
images/forms/tables/structured data, fetch and probe logs, robots files, certificates, a link
graph) are rendered here with Spark expressions — one output row per source row (or per order
with its bounded line items), so every fixture grows with its source table and no group is
collected beyond a single order. The oracle side reads the source tables directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.session import read_table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def _if(cond: Column, s: Column | str) -> Column:
    return F.when(cond, s if isinstance(s, Column) else F.lit(s)).otherwise(F.lit(""))


def _fmt(fmt: str, *cols) -> Column:
    return F.format_string(fmt, *cols)


# --------------------------------------------------------------------------- pages


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per customer: meta tags, Open Graph / Twitter, canonical, favicon, links of every
    kind, social profiles, contact addresses and one technology snippet."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.col("c_name")
    tech_snippets = [
        '<link rel="stylesheet" href="/wp-content/themes/a.css">', '<script src="https://cdn.shopify.com/s.js"></script>',
        '<img src="https://static.wixstatic.com/i.png" alt="w">', '<a href="https://www.squarespace.com/">sq</a>',
        "<script>Drupal.settings = {};</script>", '<meta name="generator" content="Joomla! 4">',
        '<div data-reactroot=""></div>', '<div data-v-1a2b="">v</div>', '<div ng-app="x"></div>',
        '<script src="/js/jquery-3.6.0.min.js"></script>', '<link rel="stylesheet" href="/css/bootstrap.min.css">',
        "<script>gtag('config', 'G-1');</script>", '<script src="https://www.googletagmanager.com/gtm.js"></script>',
        '<script src="https://cdnjs.cloudflare.com/x.js"></script>', '<link rel="stylesheet" href="/fontawesome.css">',
        '<script id="__NEXT_DATA__">{}</script>', '<form action="/index.php?x=1"></form>',
    ]
    snippet = F.element_at(F.array(*[F.lit(s) for s in tech_snippets]), (k % 17 + 1).cast("int"))
    head = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>'), name, F.lit("</title>"),
        _if(k % 3 == 0, _fmt('<meta name="Description" content="Account %s in segment %s with a balance of %.2f">', name, F.col("c_mktsegment"), F.col("c_acctbal"))),
        _if(k % 3 == 1, '<meta name="description" content=""><meta name="description" content="late">'),
        _if(k % 4 == 0, '<meta name="robots" content="noindex, nofollow">'),
        _if(k % 4 == 1, '<meta name="robots" content="  index  ">'),
        _if(k % 2 == 0, '<meta name="viewport" content="width=device-width">'),
        _fmt('<meta property="og:title" content="%s">', name),
        _if(k % 5 == 0, _fmt('<meta property="og:type" content="seg-%s"><meta property="og:title" content="last">', F.col("c_mktsegment"))),
        F.lit('<meta name="twitter:card" content="summary">'),
        _if(k % 6 == 0, _fmt('<link rel="canonical" href="https://shop.example.com/c/%d">', k)),
        _if(k % 7 == 0, _fmt('<link rel="shortcut icon" href="/favicon-%d.ico">', k)),
        F.lit("</head>"),
    )
    body = F.concat(
        F.lit("<body><h1>"), name, F.lit("</h1>"),
        _fmt('<a href="/c/%d">self</a><a href="/c/%d#top">again</a>', k, k),
        _fmt('<a href="https://partner%d.example.org/x">partner</a>', k % 10),
        _if(k % 3 == 0, _fmt('<a rel="nofollow" href="https://ads.example.net/%d">ad</a>', k)),
        _fmt('<a href="MAILTO:%s@example.com?subject=hi">mail</a>', F.lower(F.regexp_replace(name, "#", ""))),
        _if(k % 2 == 1, _fmt('<a href="tel:+1-555-%04d">call</a>', k % 10000)),
        _if(k % 8 == 0, _fmt('<a href="https://www.facebook.com/c%d">fb</a>', k)),
        _if(k % 9 == 0, _fmt('<a href="https://github.com/c%d">gh</a><a href="https://netflix.com/c%d">nf</a>', k, k)),
        F.lit('<a href="#main">skip</a><a href="JavaScript:void(0)">js</a><a href="">empty</a>'),
        _fmt("<p>Write to c%d@mail.example.com or icon%d@img.example.com.png today</p>", k, k),
        _fmt("<p>Segment %s balance %.2f</p>", F.col("c_mktsegment"), F.col("c_acctbal")),
        snippet, F.lit("</body></html>"),
    )
    return c.select(
        k.alias("page_id"), _fmt("https://shop.example.com/c/%d", k).alias("url"), F.concat(head, body).alias("html"),
    )


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part: images, video/audio/iframes, scripts and styles, JSON-LD and microdata."""
    p = read(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    alt = F.when(size % 5 == 0, F.lit("")).when(size % 7 == 0, F.lit(' alt=""')).otherwise(_fmt(' alt="%s"', F.col("p_name")))
    head = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), F.lit("</title>"),
        _fmt('<script type="application/ld+json">{"@context":"https://schema.org","@type":"%s","name":"%s"}</script>', F.col("p_type"), F.col("p_name")),
        _if(k % 4 == 0, _fmt('<script type="application/ld+json">[{"@type":"Brand"},{"@type":["Product","%s"]},"x"]</script>', F.col("p_brand"))),
        _if(k % 6 == 0, '<script type="application/ld+json">{broken</script>'),
        _if(k % 5 == 0, _fmt('<script src="/js/app-%d.js"></script>', k)),
        _if(k % 7 == 0, '<script src=""></script>'),
        _fmt("<script>var p=%d;</script>", k),
        _if(k % 3 == 0, '<link rel="stylesheet" href="/css/site.css"><link rel="alternate stylesheet" href="/css/alt.css">'),
        _fmt("<style>.p%d{color:red}</style></head>", k),
    )
    body = F.concat(
        _fmt('<body itemscope itemtype="https://schema.org/%s">', F.regexp_replace(F.col("p_brand"), "#", "")),
        _fmt('<img src="/img/%d.png"%s width="%d">', k, alt, size),
        _if(k % 11 == 0, _fmt('<img src="data:image/png;base64,AAAA%d">', k)),
        _if(k % 13 == 0, _fmt('<img data-src="/lazy/%d.jpg" alt="lazy">', k)),
        _if(k % 2 == 0, _fmt('<video src="/v/%d.mp4"></video>', k)),
        _if(k % 3 == 0, _fmt('<video controls><source src="/v/%d.webm"><source src="../v/%d.ogv"></video>', k, k)),
        _if(k % 4 == 0, _fmt('<audio src="/a/%d.mp3"><source src="/a/%d.ogg"></audio>', k, k)),
        _if(k % 2 == 0, _fmt('<iframe src="https://www.youtube.com/embed/%d"></iframe>', k)),
        _if(k % 5 == 0, _fmt('<iframe src="//player.vimeo.com/video/%d"></iframe>', k)),
        _fmt('<iframe src="https://maps.example.com/%d"></iframe>', k),
        _fmt('<div itemtype="https://schema.org/Offer">%s</div>', F.col("p_retailprice").cast("string")),
        F.lit("</body></html>"),
    )
    return p.select(k.alias("page_id"), _fmt("https://parts.example.com/p/%d", k).alias("url"), F.concat(head, body).alias("html"))


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per supplier with up to four forms, one of them never closed."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    html = F.concat(
        F.lit("<html><body><h2>"), F.col("s_name"), F.lit("</h2>"),
        F.lit('<form action="/search" method="get"><input name="q"><input type="submit" value="Go"></form>'),
        _fmt('<form action="/login/%d" method="Post"><input type="text" name="user">', k),
        _if(k % 3 == 0, '<input type="password" name="pw">'),
        _if(k % 4 == 0, '<textarea name="note"></textarea>'),
        _if(k % 4 == 1, '<select name="nation"><option>a</option></select>'),
        F.lit("</form>"),
        _if(k % 7 == 0, '<form action="/open"><input name="o">'),
        _if(k % 2 == 0, '<form><input type="email" name="mail"><input type="" name="blank"></form>'),
        F.lit("</body></html>"),
    )
    return s.select(k.alias("page_id"), _fmt("https://sup.example.com/s/%d?x=1", k).alias("url"), html.alias("html"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order: a table with a header row and one row per line item (an order has a
    handful of line items, so the per-order group is bounded), plus a nested table on some."""
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    rows = li.groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", F.format_string("<tr><td>%d</td><td>%.1f</td></tr>", "l_linenumber", "l_quantity").alias("h"))))["h"], "").alias("trs")
    )
    j = o.join(rows, o.o_orderkey == rows.l_orderkey, "left")
    k = F.col("o_orderkey")
    header = F.concat(F.lit("<tr><th>line</th><th>qty</th>"), F.repeat(F.lit("<th>x</th>"), (k % 3).cast("int")), F.lit("</tr>"))
    html = F.concat(
        F.lit("<html><body><table>"), header, F.coalesce(F.col("trs"), F.lit("")), F.lit("</table>"),
        _if(k % 5 == 0, "<table><tr><td>a</td></tr><tr><td><table><tr><td>n</td></tr></table></td></tr></table>"),
        _if(k % 7 == 0, "<table><tr><td>a</td><td><table><tr><td>n</td></tr></table></td><td>b</td></tr></table>"),
        F.lit("</body></html>"),
    )
    return j.select(k.alias("page_id"), _fmt("https://ord.example.com/o/%d", k).alias("url"), html.alias("html"))


def nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per nation: region as h1, nation as h2, an h3 with inner markup and an empty h4."""
    n = read(spark, sf_dir, "nation")
    r = read(spark, sf_dir, "region")
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    k = F.col("n_nationkey")
    html = F.concat(
        F.lit("<html><body><h1>"), F.col("r_name"), F.lit("</h1><h2>"), F.col("n_name"), F.lit("</h2>"),
        _fmt("<h3>Key <b>%d</b> end</h3><h4>  </h4><h2>Second &amp; more</h2>", k),
        F.lit("</body></html>"),
    )
    return j.select(k.cast("bigint").alias("page_id"), _fmt("https://geo.example.com/n/%d", k).alias("url"), html.alias("html"))


# --------------------------------------------------------------------------- logs


def _event_url(eid: Column) -> Column:
    r = F.floor(eid / 20).cast("bigint")  # 20 events a URL: the number of URLs grows with the table
    return F.format_string("https://site%d.example.com/p/%d", r % 20, r)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event read as one fetch attempt: url, attempt (1-based, by event id within the url),
    method, status (null = transport error), error, content type, elapsed seconds, headers."""
    e = read(spark, sf_dir, "events")
    eid = F.col("event_id")
    et = F.col("event_type")
    status = (
        F.when((et == "error") & (eid % 3 == 0), F.lit(None).cast("int"))
        .when(et == "error", F.lit(503)).when(et == "purchase", F.lit(404)).otherwise(F.lit(200))
    )
    headers = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("server").alias("key"), F.lit("nginx").alias("value")),
        F.when(F.col("value") > 100, F.struct(F.lit("STRICT-Transport-Security").alias("key"), F.lit("max-age=1").alias("value"))),
        F.when(eid % 2 == 0, F.struct(F.lit("x-frame-options").alias("key"), F.lit("DENY").alias("value"))),
        F.when(eid % 3 == 0, F.struct(F.lit("Content-Security-Policy").alias("key"), F.lit("default-src 'self'").alias("value"))),
        F.when(eid % 5 == 0, F.struct(F.lit("X-Content-Type-Options").alias("key"), F.lit("nosniff").alias("value"))),
        F.when(eid % 7 == 0, F.struct(F.lit("referrer-policy").alias("key"), F.lit("").alias("value"))),
    )))
    return e.select(
        eid.alias("event_id"),
        _event_url(eid).alias("url"),
        (eid % 20 + 1).cast("int").alias("attempt"),
        F.when(eid % 2 == 0, F.lit("HEAD")).otherwise(F.lit("GET")).alias("method"),
        status.alias("status_code"),
        F.when(status.isNull(), F.lit("timeout")).alias("error"),
        F.when(et == "signup", F.lit("application/pdf")).otherwise(F.lit("Text/HTML; charset=utf-8")).alias("content_type"),
        (F.col("value") / 100).alias("elapsed_sec"),
        headers.alias("headers"),
    )


def robots_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One robots.txt per supplier host: a default group, a group for one named agent, comments,
    allow lines, a sitemap, an empty Disallow on some, and a 404 on every tenth host."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    body = F.concat(
        F.lit("# robots\nUser-agent: *\n"),
        _fmt("Disallow: /private/%d\n", k),
        _if(k % 3 == 0, _fmt("Allow: /private/%d/open\n", k)),
        F.lit("Disallow: /tmp # temp\n"),
        _fmt("Sitemap: https://s%d.example.com/sm-%d.xml\n", k, k),
        F.lit("\nUser-agent: Mozilla\n"),
        _if(k % 3 == 0, _fmt("Allow: /m/%d/ok\n", k)),
        _fmt("Disallow: /m/%d\n", k),
        _if(k % 4 == 0, "Disallow:\nfoo: bar\n"),
        _if(k % 5 == 0, "  \nUser-agent: bot\nDisallow: /\n"),
    )
    return s.select(
        _fmt("s%d.example.com", k).alias("host"),
        F.when(k % 10 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status_code"),
        body.alias("body"),
    )


def robots_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs to test against the robots table: per supplier host, a few paths per line item."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    host = F.format_string("https://s%d.example.com", F.col("l_suppkey"))
    paths = F.array(
        F.format_string("/private/%d/open/%d", F.col("l_suppkey"), F.col("l_orderkey")),
        F.format_string("/private/%d", F.col("l_suppkey")),
        F.format_string("/m/%d/x%d", F.col("l_suppkey"), F.col("l_linenumber")),
        F.format_string("/tmp/%d", F.col("l_orderkey")),
        F.format_string("/pub/%d#frag", F.col("l_orderkey")),
    )
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.posexplode(paths).alias("variant", "path"), host.alias("base"),
    ).select("l_orderkey", "l_linenumber", "variant", F.concat("base", "path").alias("url"))


def url_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap probe results per supplier host: declared sitemap exists on even keys, the default
    sitemap.xml on multiples of 3, sitemap_index.xml answers 500 on multiples of 5."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = F.array(
        F.struct(_fmt("https://s%d.example.com/sm-%d.xml", k, k).alias("url"), F.when(k % 2 == 0, 200).otherwise(404).alias("status_code")),
        F.struct(_fmt("https://s%d.example.com/sitemap.xml", k).alias("url"), F.when(k % 3 == 0, 200).otherwise(404).alias("status_code")),
        F.struct(_fmt("https://s%d.example.com/sitemap_index.xml", k).alias("url"), F.when(k % 5 == 0, 500).otherwise(200).alias("status_code")),
    )
    return s.select(F.explode(rows).alias("r")).select("r.url", "r.status_code")


def certs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate per order host; organisation missing on multiples of 5, handshake error on
    multiples of 7; notAfter written like the TLS library does (day padded with a space)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    not_after = F.concat(F.date_format(d, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(d).cast("string"), 2, " "),
                         F.lit(" "), F.date_format(d, "HH:mm:ss yyyy"), F.lit(" GMT"))
    issuer = F.when(k % 5 == 0, F.create_map(F.lit("commonName"), F.lit("R3 CA"))).otherwise(
        F.create_map(F.lit("organizationName"), F.lit("Let's Encrypt"), F.lit("commonName"), F.lit("R3")))
    return o.select(
        _fmt("h%d.example.com", k).alias("hostname"),
        F.when(k % 7 != 0, issuer).alias("issuer"),
        F.when(k % 7 != 0, F.create_map(F.lit("commonName"), _fmt("h%d.example.com", k))).alias("subject"),
        F.when(k % 7 != 0, not_after).alias("not_after"),
        F.when(k % 7 == 0, F.lit("[SSL: CERTIFICATE_VERIFY_FAILED] certificate verify failed")).alias("error"),
    )


def graph_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robots file of the crawl corpus' host: three pages closed to all agents, and a sitemap named
    after the corpus' last page."""
    mx = read(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("mx"))
    body = F.format_string("User-agent: *\nDisallow: /p/13\nDisallow: /p/18\nDisallow: /p/30\nSitemap: https://g.example.com/sm-%d.xml\n", "mx")
    return mx.select(F.lit("g.example.com").alias("host"), F.lit(200).alias("status_code"), body.alias("body"))


def graph_url_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap probes of the crawl corpus' host: the declared one is gone, the default one is there."""
    mx = read(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("mx"))
    rows = F.array(
        F.struct(_fmt("https://g.example.com/sm-%d.xml", F.col("mx")).alias("url"), F.lit(404).alias("status_code")),
        F.struct(F.lit("https://g.example.com/sitemap.xml").alias("url"), F.lit(200).alias("status_code")),
    )
    return mx.select(F.explode(rows).alias("r")).select("r.url", "r.status_code")


def fault_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per supplier, some with URLs that cannot be read: a favicon, a link, an image, a video, a script or a form's action."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    html = F.concat(
        _fmt("<html><head><title>Supplier %d</title>", k),
        _if(k % 3 == 0, '<link rel="icon" href="http://[bad/i.ico">'), _if(k % 3 == 1, '<link rel="icon" href="/i.ico">'),
        F.lit('</head><body><p>Alpha beta</p><a href="/ok">gamma</a><a href="mailto:[x">mail</a>'),
        _if(k % 4 == 0, '<a href="http://[::1/x">six</a>'), _if(k % 4 == 1, '<a href="http://[::1]/x">six</a>'),
        F.lit('<img src="/a.png" alt="x"><img src="data:[" alt="">'), _if(k % 5 == 0, '<img data-src="//zz]/a.png" alt="y">'),
        _if(k % 8 == 0, '<video src="http://[v/x.mp4"></video>'), _if(k % 6 == 0, '<script src="//[zz]/s.js"></script>'),
        F.lit('<form action="/f"><input name="q"></form>'), _if(k % 7 == 0, '<form action="http://x]/f"></form>'), F.lit("</body></html>"))
    return s.select(k.alias("page_id"), _fmt("https://sup.example.com/f/%d", k).alias("url"), html.alias("html"))


def graph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored crawl corpus: page i per order key links to 2i+1 and 2i+2 (when they exist), back
    to the root, and to a fragment variant of its first child. Every 17th page is stored as a PDF,
    every 19th failed to fetch (no response)."""
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    n = o.agg(F.max("o_orderkey").alias("mx"))
    k = F.col("o_orderkey")
    j = o.crossJoin(F.broadcast(n))
    url = lambda x: F.format_string("https://g.example.com/p/%d", x)
    kid = lambda x: _if(x <= F.col("mx"), F.format_string('<a href="/p/%d">c</a>', x))
    html = F.concat(
        F.lit("<html><body>"), kid(2 * k + 1), kid(2 * k + 2),
        _if(2 * k + 1 <= F.col("mx"), F.format_string('<a href="/p/%d#x">frag</a>', 2 * k + 1)),
        F.lit('<a href="/p/0">home</a><a href="https://elsewhere.example.org/">out</a></body></html>'),
    )
    missing = (k % 19 == 0) & (k > 0)
    pdf = (k % 17 == 0) & (k > 0)
    return j.select(
        k.alias("page_id"), url(k).alias("url"),
        F.when(~missing, html).alias("html"),
        F.when(missing, F.lit(None).cast("int")).otherwise(F.lit(200)).alias("status_code"),
        F.when(pdf, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.when(missing, F.lit("Connection refused")).alias("error"),
        (F.lit(0.05) + (k % 10) / 100).alias("elapsed_sec"),
    )


def order_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One requested URL per order (order_no, url)."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("order_no"), _fmt("https://r.example.com/o/%d", k).alias("url"))


def redirect_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect hops (url, location): finished orders lead to the order numbered like their customer, relative to
    their URL; every 50th order to itself; of the others every seventh to another host."""
    k = F.col("o_orderkey")
    location = (F.when(k % 50 == 0, _fmt("https://r.example.com/o/%d", k)).when(F.col("o_orderstatus") == "F", _fmt("../o/%d", F.col("o_custkey")))
                .when(k % 7 == 0, _fmt("//cdn.example.net/x/%d", k)))
    return read(spark, sf_dir, "orders").select(_fmt("https://r.example.com/o/%d", k).alias("url"), location.alias("location")).filter("location IS NOT NULL")


def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered pages with forms, tables and links, of all suppliers, orders and customers."""
    return supplier_pages(spark, sf_dir).unionByName(order_pages(spark, sf_dir)).unionByName(customer_pages(spark, sf_dir))
