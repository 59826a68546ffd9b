"""One query per operator: ``QUERIES[name](spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or tables Spark derives from them in
``sources.fixtures``), runs the operator over all rows, and returns a flat result whose column
names match the oracle SQL in ``pagelens.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.functions import html as H
from pagelens.functions import markup
from pagelens.functions.urls import hostname, netloc, normalize_url, resolve_link, scheme
from pagelens.operators import audit, blocks, crawl, health, links, media, meta, robots, text
from pagelens.operators.parse import exploded, members, parsed
from pagelens.plans import report as R
from pagelens.plans import sinks
from pagelens.session import ensure_conf, read_table, scratch_path, table_path
from pagelens.sources import fixtures as FX
from pagelens.sources.pages import classify, read_pages, with_envelope
from pagelens.sources.redirects import with_redirects
from pagelens.streaming import stream as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

GRAPH_SEED = "https://g.example.com/p/0"
GRAPH_DEPTH = 4
GRAPH_MAX_PAGES = 25
CERT_AS_OF = "1999-01-01 06:00:00"


def query(name: str):
    def reg(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_conf(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run

    return reg


def _pages(spark, sf_dir) -> DataFrame:
    return read_pages(spark, table_path(sf_dir, "pages"))


def _ctx(df: DataFrame) -> DataFrame:
    return parsed(with_envelope(df) if "final_url" not in df.columns else df)


def _report_with_certificates(spark, sf_dir) -> DataFrame:
    certs = audit.cert_status(FX.certs_table(spark, sf_dir), F.to_timestamp(F.lit(CERT_AS_OF)))
    pages = _pages(spark, sf_dir)
    return R.analyze(pages, ssl=audit.ssl_for_pages(pages, certs))


def _report(spark, sf_dir) -> DataFrame:
    return R.analyze(_pages(spark, sf_dir))


# --------------------------------------------------------------------------- A: sources, sinks


@query("page_source")
def q_page_source(spark, sf_dir):
    """A1: the page envelope."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", "url", "final_url", "redirected", "content_length_bytes", "status_code", "content_type")


@query("redirect_hops")
def q_redirect_hops(spark, sf_dir):
    """A1: where every requested URL ended and through which URLs, from a log of single hops."""
    p = with_redirects(FX.order_urls(spark, sf_dir), FX.redirect_log(spark, sf_dir))
    return p.select("order_no", "url", "final_url", F.size("redirect_chain").cast("bigint").alias("hops"), F.array_join("redirect_chain", " ").alias("chain"), "error")


@query("page_outcome")
def q_page_outcome(spark, sf_dir):
    """A2: ok / skipped / error per fetch log row."""
    log = FX.fetch_log(spark, sf_dir)
    return classify(log).select("event_id", "url", "outcome", F.col("outcome_reason").alias("reason"))


@query("seed_urls")
def q_seed_urls(spark, sf_dir):
    """A3: seed normalisation of page URLs as typed (with and without scheme, padded)."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    variants = F.array(F.col("url"), F.concat(F.lit("  "), F.substring_index("url", "://", -1), F.lit(" ")))
    v = exploded(p, ["page_id"], variants, "variant", "typed")
    return v.select("page_id", "variant", normalize_url(F.col("typed")).alias("seed"))


@query("sink_json")
def q_sink_json(spark, sf_dir):
    """A4: the nested report written as JSON and read back."""
    path = scratch_path(spark, "report-json")
    sinks.write_json(_report_with_certificates(spark, sf_dir), path)
    back = spark.read.json(path)
    return back.select("page_id", F.col("meta.title").alias("title"), F.col("text_stats.word_count").alias("word_count"),
                       F.col("links.total").alias("links_total"), F.col("ssl_info.valid").alias("ssl_valid"), F.size("_errors").alias("n_errors"))


@query("sink_csv")
def q_sink_csv(spark, sf_dir):
    """A5: the flat CSV written and read back (all fields as text)."""
    path = scratch_path(spark, "report-csv")
    sinks.write_csv(_report(spark, sf_dir), path)
    schema = ", ".join(f"{c} string" for c in sinks.CSV_FIELDS)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(path)


@query("sink_text")
def q_sink_text(spark, sf_dir):
    """The overview lines written as text and read back."""
    path = scratch_path(spark, "report-txt")
    sinks.write_text(_report(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --------------------------------------------------------------------------- B: HTML as a relation


@query("html_tokens")
def q_html_tokens(spark, sf_dir):
    """B1: ordered tokens of every page."""
    p = read_table(spark, sf_dir, "pages")
    t = exploded(p, ["page_id"], markup.page_tokens(F.col("html")), "pos", "t")
    return t.select("page_id", "pos", "t.kind", "t.name", F.char_length("t.raw").cast("bigint").alias("raw_len"))


def elements(pages: DataFrame) -> DataFrame:
    """B2: elements as rows, with the token each ends at. Row-local: one pass over each page keeps the stack of open
    elements (``functions.markup``); nothing is shuffled. Void and raw-text elements end where they start."""
    e = exploded(pages, ["page_id"], markup.parse_page(F.col("html"))["els"], "no", "e")
    return e.select("page_id", F.col("e.i").alias("pos"), "e.name", F.col("e.end").alias("end_pos"), F.col("e.a").alias("attrs"))


@query("html_elements")
def q_html_elements(spark, sf_dir):
    """B2: element intervals."""
    e = elements(read_table(spark, sf_dir, "pages"))
    return e.select("page_id", "pos", "name", "end_pos", F.size(F.map_keys("attrs")).cast("bigint").alias("n_attrs"))


@query("html_unescape")
def q_html_unescape(spark, sf_dir):
    """Decoded text tokens holding character references."""
    p = read_table(spark, sf_dir, "pages")
    t = exploded(p, ["page_id"], markup.page_tokens(F.col("html")), "pos", "t").filter(F.col("t.kind") == "text").select("page_id", "pos", "t.raw")
    t = H.with_entities(t.filter(F.col("raw").contains("&")))
    return t.select("page_id", "pos", H.unescape(F.col("raw")).alias("decoded"))


@query("visible_text")
def q_visible_text(spark, sf_dir):
    """Page text length, word count and digest."""
    c = _ctx(read_table(spark, sf_dir, "pages"))
    return c.select("page_id", F.char_length("text").cast("bigint").alias("n_chars"), text.word_count().alias("n_words"),
                    F.md5("text").alias("text_md5"))


@query("element_text")
def q_element_text(spark, sf_dir):
    """Text of every h1 (nodes stripped and joined without separator)."""
    c = _ctx(read_table(spark, sf_dir, "pages"))
    h = exploded(c, ["page_id"], meta.headings()["h1"], "idx", "text")
    return h


@query("url_resolve")
def q_url_resolve(spark, sf_dir):
    """Every <a href> of every page resolved against the page URL (fragment cut)."""
    c = _ctx(read_table(spark, sf_dir, "pages"))
    a = exploded(c, ["page_id", "final_url"], links.anchors(), "idx", "a")
    return a.select("page_id", "idx", F.col("a.href").alias("href"), resolve_link(F.col("final_url"), F.col("a.href")).alias("resolved"))


@query("url_parts")
def q_url_parts(spark, sf_dir):
    """Scheme, netloc and hostname of page URLs."""
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", scheme(F.col("url")).alias("scheme"), netloc(F.col("url")).alias("netloc"),
                    hostname(F.col("url")).alias("hostname"))


# --------------------------------------------------------------------------- C: extractors


@query("page_title")
def q_page_title(spark, sf_dir):
    c = _ctx(read_table(spark, sf_dir, "pages"))
    t = meta.title()
    return c.select("page_id", t.alias("title"), F.coalesce(F.char_length(t), F.lit(0)).cast("bigint").alias("title_length"))


def _customer_ctx(spark, sf_dir):
    return _ctx(FX.customer_pages(spark, sf_dir))


@query("meta_tags")
def q_meta_tags(spark, sf_dir):
    c = _customer_ctx(spark, sf_dir)
    m = c.select("page_id", meta.meta_section().alias("m"))
    return m.select("page_id", "m.description", "m.description_length", "m.robots", "m.viewport", "m.keywords")


@query("meta_document")
def q_meta_document(spark, sf_dir):
    c = _customer_ctx(spark, sf_dir)
    m = c.select("page_id", meta.meta_document().alias("m"))
    return m.select("page_id", "m.language", "m.canonical", "m.favicon", "m.charset")


@query("open_graph")
def q_open_graph(spark, sf_dir):
    c = _customer_ctx(spark, sf_dir)
    return members(c, ["page_id"], F.map_entries(meta.open_graph()), "e").select("page_id", "e.*")


@query("twitter_card")
def q_twitter_card(spark, sf_dir):
    c = _customer_ctx(spark, sf_dir)
    return members(c, ["page_id"], F.map_entries(meta.twitter_card()), "e").select("page_id", "e.*")


def _numbered(label: str, values, label_name: str, value_name: str):
    """The values of an array as array<struct<label, idx, value>>."""
    return F.transform(values, lambda v, i: F.struct(F.lit(label).alias(label_name), i.alias("idx"), v.alias(value_name)))


@query("headings")
def q_headings(spark, sf_dir):
    c = _ctx(FX.nation_pages(spark, sf_dir))
    h = c.select("page_id", meta.headings().alias("h"))
    rows = F.flatten(F.array(*[_numbered(f"h{i}", F.col(f"h.h{i}"), "level", "text") for i in range(1, 7)]))
    return members(h, ["page_id"], rows, "r").select("page_id", "r.*")


@query("text_stats")
def q_text_stats(spark, sf_dir):
    """C7 over plain-text documents."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", text.plain_text(F.col("text")).alias("text"))
    s = d.select("doc_id", text.text_stats(with_paragraphs=False).alias("s"))
    return s.select("doc_id", "s.word_count", "s.character_count", F.col("s.estimated_reading_time_min").alias("reading_min"),
                    "s.text_sample")


@query("paragraph_count")
def q_paragraph_count(spark, sf_dir):
    c = _ctx(read_table(spark, sf_dir, "pages"))
    return c.select("page_id", text.paragraph_count().alias("paragraph_count"))


@query("page_links")
def q_page_links(spark, sf_dir):
    c = _ctx(read_table(spark, sf_dir, "pages"))
    l = c.select("page_id", links.page_links(links.anchors()).alias("links"))
    return links.link_table(l)


def _customer_links(spark, sf_dir):
    c = _customer_ctx(spark, sf_dir)
    a = c.select("page_id", "final_url", "text", links.anchors().alias("anc"))
    return a.select("page_id", "final_url", "text", "anc", links.page_links(F.col("anc")).alias("links"))


@query("link_counts")
def q_link_counts(spark, sf_dir):
    l = _customer_links(spark, sf_dir)
    s = l.select("page_id", links.links_section(F.col("anc"), F.col("links")).alias("s"))
    return s.select("page_id", "s.total", "s.internal_count", "s.external_count", "s.nofollow_count", "s.mailto_count", "s.tel_count")


@query("external_domains")
def q_external_domains(spark, sf_dir):
    l = _customer_links(spark, sf_dir)
    return members(l, ["page_id"], links.external_domains(F.col("links")), "domain")


@query("mailto_tel")
def q_mailto_tel(spark, sf_dir):
    l = _customer_links(spark, sf_dir)
    rows = F.concat(_numbered("mailto", links.mailto(F.col("anc")), "kind", "value"), _numbered("tel", links.tel(F.col("anc")), "kind", "value"))
    return members(l, ["page_id"], rows, "r").select("page_id", "r.*")


def _part_ctx(spark, sf_dir):
    return _ctx(FX.part_pages(spark, sf_dir))


@query("images")
def q_images(spark, sf_dir):
    c = _part_ctx(spark, sf_dir)
    i = exploded(c, ["page_id"], media.images(), "idx", "img")
    return i.select("page_id", "idx", "img.src", "img.alt", "img.width", "img.height")


@query("image_alt_audit")
def q_image_alt_audit(spark, sf_dir):
    c = _part_ctx(spark, sf_dir)
    s = c.select("page_id", media.image_section(media.images()).alias("s"))
    return s.select("page_id", "s.count", "s.missing_alt_count")


@query("media_videos")
def q_media_videos(spark, sf_dir):
    return members(_part_ctx(spark, sf_dir), ["page_id"], media.videos(), "src")


@query("media_audios")
def q_media_audios(spark, sf_dir):
    return members(_part_ctx(spark, sf_dir), ["page_id"], media.audios(), "src")


@query("embedded_players")
def q_embedded_players(spark, sf_dir):
    return exploded(_part_ctx(spark, sf_dir), ["page_id"], media.players(), "idx", "src")


@query("scripts_styles")
def q_scripts_styles(spark, sf_dir):
    s = _part_ctx(spark, sf_dir).select("page_id", media.scripts_styles().alias("s"))
    return s.select(
        "page_id", F.array_join("s.external_scripts", " ").alias("external_scripts"), "s.inline_script_count",
        F.array_join("s.external_stylesheets", " ").alias("external_stylesheets"), "s.inline_style_count",
    )


def _forms(spark, sf_dir):
    c = _ctx(FX.supplier_pages(spark, sf_dir))
    f = exploded(c, ["page_id"], blocks.forms(), "form_idx", "f")
    return f


@query("forms")
def q_forms(spark, sf_dir):
    f = _forms(spark, sf_dir)
    return f.select(
        "page_id", "form_idx", "f.action", "f.method", "f.input_count",
        F.array_join(F.transform("f.inputs", lambda x: F.concat_ws(":", x["type"], F.coalesce(x["name"], F.lit("")))), ",").alias("inputs"),
    )


@query("login_forms")
def q_login_forms(spark, sf_dir):
    f = _forms(spark, sf_dir)
    return f.filter(F.col("f.has_password_field")).select("page_id", "form_idx", "f.action")


@query("html_tables")
def q_html_tables(spark, sf_dir):
    c = _ctx(FX.order_pages(spark, sf_dir))
    t = exploded(c, ["page_id"], blocks.tables(), "table_idx", "t")
    return t.select("page_id", "table_idx", "t.rows", "t.columns_approx")


@query("jsonld_types")
def q_jsonld_types(spark, sf_dir):
    s = _part_ctx(spark, sf_dir).select("page_id", blocks.structured_data().alias("s"))
    return s.select("page_id", "s.json_ld_count", F.array_join("s.json_ld_types", "|").alias("json_ld_types"))


@query("microdata_types")
def q_microdata_types(spark, sf_dir):
    s = _part_ctx(spark, sf_dir).select("page_id", blocks.structured_data().alias("s"))
    return s.select("page_id", F.array_join("s.microdata_types", "|").alias("microdata_types"), "s.has_structured_data")


@query("social_links")
def q_social_links(spark, sf_dir):
    l = _customer_links(spark, sf_dir)
    s = exploded(l, ["page_id"], links.social_links(F.col("links")), "idx", "s")
    return s.select("page_id", "idx", "s.platform", "s.url")


@query("emails")
def q_emails(spark, sf_dir):
    """C25 over documents."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", text.plain_text(F.col("text")).alias("text"))
    return members(d, ["doc_id"], text.emails(F.col("text")), "email")


@query("emails_mailto")
def q_emails_mailto(spark, sf_dir):
    """C25 over rendered pages: page text plus mailto targets."""
    l = _customer_links(spark, sf_dir)
    return members(l, ["page_id"], text.emails(F.col("text"), links.mailto(F.col("anc"))), "email")


@query("phones")
def q_phones(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", text.plain_text(F.col("text")).alias("text"))
    return members(d, ["doc_id"], text.phones(F.col("text")), "phone")


@query("keyword_density")
def q_keyword_density(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", text.plain_text(F.col("text")).alias("text"))
    k = exploded(d, ["doc_id"], text.keyword_density(F.col("text")), "rank", "k")
    return k.select("doc_id", "rank", "k.word", "k.count", "k.density_pct")


def _customer_report(spark, sf_dir):
    return R.analyze(with_envelope(FX.customer_pages(spark, sf_dir)))


@query("seo_checks")
def q_seo_checks(spark, sf_dir):
    r = _customer_report(spark, sf_dir)
    c = exploded(r, ["page_id"], F.col("seo.checks"), "check_no", "c")
    return c.select("page_id", "check_no", "c.name", "c.passed", "c.detail")


@query("seo_score")
def q_seo_score(spark, sf_dir):
    r = _customer_report(spark, sf_dir)
    return r.select("page_id", "seo.passed", "seo.total", "seo.score_pct")


@query("security_headers")
def q_security_headers(spark, sf_dir):
    log = FX.fetch_log(spark, sf_dir)
    s = log.select("event_id", audit.security_headers(F.col("headers")).alias("s"))
    names = dims.SECURITY_HEADER_NAMES
    return s.select("event_id", "s.present_count", *[F.element_at("s.headers", F.lit(h)).alias(h.lower().replace("-", "_")) for h in names])


@query("technologies")
def q_technologies(spark, sf_dir):
    p = FX.customer_pages(spark, sf_dir)
    return members(p, ["page_id"], audit.technologies(F.col("html"), F.create_map().cast("map<string,string>")), "tech")


@query("cert_expiry")
def q_cert_expiry(spark, sf_dir):
    return audit.cert_status(FX.certs_table(spark, sf_dir), F.to_timestamp(F.lit(CERT_AS_OF)))


@query("extract_errors")
def q_extract_errors(spark, sf_dir):
    """Pages with URLs that cannot be read: the section concerned has its default and a note, the others what they have."""
    r = R.analyze(with_envelope(FX.fault_pages(spark, sf_dir)))
    return r.select("page_id", F.array_join("_errors", "; ").alias("errors"), F.col("text_stats.word_count").alias("word_count"),
                    F.col("meta.title").alias("title"), F.col("meta.favicon").alias("favicon"), F.col("links.total").alias("links_total"),
                    F.col("links.mailto_count").alias("mailto_count"), F.col("images.count").alias("image_count"), F.size("media.videos").alias("videos"),
                    F.size("scripts_styles.external_scripts").alias("scripts"), F.size("forms").alias("forms"), F.col("seo.total").alias("seo_total"))


# --------------------------------------------------------------------------- D: robots, crawl


@query("robots_summary")
def q_robots_summary(spark, sf_dir):
    s = robots.robots_summary(FX.robots_table(spark, sf_dir))
    return s.select("host", "exists", "disallow_count", F.array_join("disallow_rules", "|").alias("disallow_rules"),
                    F.array_join("sitemaps", "|").alias("sitemaps"))


@query("robots_rules")
def q_robots_rules(spark, sf_dir):
    r = robots.robots_rules(FX.robots_table(spark, sf_dir))
    return r.select("host", "is_default", F.array_join("agents", ",").alias("agents"), "rule_no", "allow", "path")


@query("robots_filter")
def q_robots_filter(spark, sf_dir):
    rules = robots.robots_rules(FX.robots_table(spark, sf_dir))
    urls = FX.robots_urls(spark, sf_dir)
    out = robots.can_fetch_agents(urls, rules, [dims.DEFAULT_USER_AGENT, "MyBot/1.0"])
    return out.select("l_orderkey", "l_linenumber", "variant", "agent", "allowed")


@query("sitemap_discovery")
def q_sitemap_discovery(spark, sf_dir):
    s = robots.robots_summary(FX.robots_table(spark, sf_dir)).withColumn("base", F.concat(F.lit("https://"), F.col("host")))
    return robots.sitemaps(s, FX.url_status(spark, sf_dir))


@query("sitemap_found")
def q_sitemap_found(spark, sf_dir):
    s = robots.robots_summary(FX.robots_table(spark, sf_dir)).withColumn("base", F.concat(F.lit("https://"), F.col("host")))
    return robots.sitemap_found(robots.sitemaps(s, FX.url_status(spark, sf_dir)))


def _graph_report(spark, sf_dir):
    return R.analyze(with_envelope(FX.graph_pages(spark, sf_dir)))


def _graph_fetches(spark, sf_dir):
    return crawl.fetch_table(with_envelope(FX.graph_pages(spark, sf_dir)))


@query("link_graph")
def q_link_graph(spark, sf_dir):
    f = _graph_fetches(spark, sf_dir).filter(F.col("outcome") == "ok")
    lt = exploded(f, ["page_id"], F.col("internal"), "rank", "url").withColumn("internal", F.lit(True))
    seeds = f.select("page_id", F.lit(GRAPH_SEED).alias("seed_url"))
    return links.link_graph(lt, seeds)


def _crawl(spark, sf_dir):
    index = crawl.index_corpus(with_envelope(FX.graph_pages(spark, sf_dir)), scratch_path(spark, "crawl-index"))
    rules = robots.robots_rules(FX.graph_robots(spark, sf_dir))
    return crawl.crawl(spark, None, None, GRAPH_SEED, GRAPH_DEPTH, GRAPH_MAX_PAGES, rules=rules, index=index)


@query("crawl_bfs")
def q_crawl_bfs(spark, sf_dir):
    recs, _ = _crawl(spark, sf_dir)
    return recs.select("seq", "url", "depth", "outcome")


@query("crawl_trace")
def q_crawl_trace(spark, sf_dir):
    recs, blocked = _crawl(spark, sf_dir)
    return crawl.crawl_trace(recs, blocked)


@query("fetch_outcome")
def q_fetch_outcome(spark, sf_dir):
    log = FX.fetch_log(spark, sf_dir)
    return crawl.fetch_outcome(log, retries=3)


# --------------------------------------------------------------------------- E: link health


@query("unique_links")
def q_unique_links(spark, sf_dir):
    c = _ctx(read_table(spark, sf_dir, "pages"))
    l = links.link_table(c.select("page_id", links.page_links(links.anchors()).alias("links")))
    u = links.unique_links(l, ["page_id", "rank"])
    return u.select("url", F.col("first_seen.page_id").alias("first_page"), F.col("first_seen.rank").alias("first_rank"),
                    "text", "nofollow", "sightings")


def _link_status(spark, sf_dir):
    log = FX.fetch_log(spark, sf_dir)
    urls = log.select("url").distinct()
    return health.link_status(urls, log)


@query("link_status")
def q_link_status(spark, sf_dir):
    return _link_status(spark, sf_dir)


@query("link_validation")
def q_link_validation(spark, sf_dir):
    return health.link_validation(_link_status(spark, sf_dir))


@query("broken_links")
def q_broken_links(spark, sf_dir):
    return health.broken_links(_link_status(spark, sf_dir), 50)


# --------------------------------------------------------------------------- F: report and views


@query("page_report")
def q_page_report(spark, sf_dir):
    """F0 (flagship): the full page report, flattened for comparison."""
    return R.flat(_report_with_certificates(spark, sf_dir))


@query("crawl_summary")
def q_crawl_summary(spark, sf_dir):
    return R.crawl_summary(_graph_report(spark, sf_dir))


@query("pages_overview")
def q_pages_overview(spark, sf_dir):
    return R.overview(_report(spark, sf_dir))


@query("sink_text_run")
def q_sink_text_run(spark, sf_dir):
    """Summary, overview, failed pages and link validation of a run, written as text and read back."""
    path = scratch_path(spark, "run-txt")
    sinks.write_run_text(_graph_report(spark, sf_dir), _link_status(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("failed_pages")
def q_failed_pages(spark, sf_dir):
    return R.failed_pages(_graph_report(spark, sf_dir))


@query("list_preview")
def q_list_preview(spark, sf_dir):
    c = _ctx(read_table(spark, sf_dir, "pages"))
    urls = F.transform(links.page_links(links.anchors()), lambda x: x["url"])
    p = c.select("page_id", R.preview(urls, 3).alias("p"))
    return p.select("page_id", F.array_join("p.shown", " ").alias("shown"), F.col("p.more").cast("bigint").alias("more"))


@query("run_report")
def q_run_report(spark, sf_dir):
    recs, _ = _crawl(spark, sf_dir)
    pages = recs.select("outcome")
    summary = robots.robots_summary(FX.graph_robots(spark, sf_dir))
    found = robots.sitemap_found(robots.sitemaps(summary.withColumn("base", F.lit("https://g.example.com")), FX.graph_url_status(spark, sf_dir)))
    return R.run_report(F.lit(GRAPH_SEED), "crawl", GRAPH_DEPTH, pages,
                        summary.select(F.col("exists").alias("robots_exists"), F.col("disallow_count").alias("robots_disallow_count")),
                        found.select(F.col("found").alias("sitemap_found"), F.col("checked").alias("sitemaps_checked")),
                        health.link_validation(_link_status(spark, sf_dir)))


@query("page_size")
def q_page_size(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", "content_length_bytes", R.human_bytes(F.col("content_length_bytes")).alias("content_size"))


@query("page_flags")
def q_page_flags(spark, sf_dir):
    return R.page_flags(_report_with_certificates(spark, sf_dir))


# --------------------------------------------------------------------------- S: streaming


@query("stream_page_report")
def q_stream_page_report(spark, sf_dir):
    """The row-local sections computed by a file stream over the pages table, read back."""
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    S.stream_report(spark, table_path(sf_dir, "pages"), out, ck)
    return spark.read.parquet(out)


def _streamed_sections(spark, sf_dir) -> str:
    pages, out, ck = (scratch_path(spark, f"sections-{n}") for n in ("in", "out", "ck"))
    FX.block_pages(spark, sf_dir).write.parquet(pages)
    S.stream_sections(spark, pages, out, ck)
    return out


@query("stream_sections")
def q_stream_sections(spark, sf_dir):
    """Forms, tables and links of rendered pages, from a stream that writes its batches by their number."""
    s = spark.read.parquet(_streamed_sections(spark, sf_dir) + "/sections")
    forms = exploded(s, ["page_id"], F.col("forms"), "idx", "f").select(F.lit("form").alias("section"), "page_id", "idx", F.col("f.input_count").alias("n"), F.col("f.action").alias("detail"))
    tables = exploded(s, ["page_id"], F.col("tables"), "idx", "t").select(F.lit("table").alias("section"), "page_id", "idx", F.col("t.rows").alias("n"), F.col("t.columns_approx").cast("string").alias("detail"))
    customers = s.filter(F.col("url").startswith("https://shop.example.com/c/"))
    counted = customers.select(F.lit("links").alias("section"), "page_id", F.lit(0).alias("idx"), F.col("links.total").alias("n"), F.col("links.external_count").cast("string").alias("detail"))
    return forms.unionByName(tables).unionByName(counted)


@query("stream_totals")
def q_stream_totals(spark, sf_dir):
    """The totals after the last batch of that stream."""
    t = S.running_totals(spark, _streamed_sections(spark, sf_dir))
    return t.select(*[F.max(c).alias(c) for c in ("pages", "forms", "tables")])


@query("stream_visited_dedup")
def q_stream_visited_dedup(spark, sf_dir):
    """Distinct fragment-less URLs, kept by a streaming de-duplication over the pages table."""
    out, ck = scratch_path(spark, "dedup-out"), scratch_path(spark, "dedup-ck")
    src = S.page_stream(spark, table_path(sf_dir, "pages"))
    q = (S.stream_dedup(src).select("norm").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)
