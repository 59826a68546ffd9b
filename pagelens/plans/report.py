"""The page report (F0) and the site-level views over it.

``analyze`` is one chain of projections over the page table: every section is a row-local
expression over the page's token array, so the whole report is computed in a single map-only
stage (no exchange) and scales with the number of pages like a scan does.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators import audit, blocks, links, media, meta, text
from pagelens.operators.parse import attr, first_error, parsed, tags
from pagelens.session import scratch_path
from pagelens.sources.pages import classify

ENVELOPE_OUT = ["page_id", "url", "final_url", "redirected", "redirect_chain", "fetched_at", "status_code", "reason",
                "elapsed_sec", "content_type", "encoding", "content_length_bytes", "headers"]
SECTIONS = ["text_stats", "meta", "headings", "links", "images", "media", "scripts_styles", "forms", "tables",
            "structured_data", "social_links", "contacts", "keyword_density", "seo", "security_headers", "technologies", "_errors"]


def analyze(pages: DataFrame, ssl: DataFrame | None = None, order_col: str = "page_id") -> DataFrame:
    """the nested page record for every stored page (sections null unless outcome = ok).

    ``pages`` comes from ``read_pages``; ``ssl`` (optional) is ``ssl_for_pages`` output keyed by
    page_id — one row per page, joined by an equi-join on page_id.

    A section that meets a URL it cannot read takes its default and adds "section: reason" to ``_errors``; the others
    are not affected, the page is not lost.
    """
    ctx = parsed(classify(pages).withColumn("_html", F.when(F.col("outcome") == "ok", F.col("html")).otherwise(F.lit(""))), "_html")
    keep = [c for c in ENVELOPE_OUT if c in ctx.columns] + ["outcome", "outcome_reason", "error"]
    if order_col not in keep:
        keep.append(order_col)
    failed, first, second, third, shown = _stages(pages.sparkSession.sparkContext.applicationId)
    s3 = ctx.withColumn("_failed", failed).select(*keep, "text", *first).select("*", *second)
    out = s3.select("*", *third).withColumn("seo", audit.seo_section(F.col("_checks"))).select(*keep, *shown)
    if ssl is not None:
        out = out.join(ssl, "page_id", "left")
    else:
        out = out.withColumn("ssl_info", F.lit(None).cast(
            "struct<valid:boolean,issuer:string,subject:string,expires:string,days_until_expiry:bigint,error:string>"))
    return out


@lru_cache(maxsize=4)
def _stages(application: str) -> tuple:
    """The report's columns by the projection they belong to. They name their inputs, so one set serves every page table
    of an application; building them is thousands of calls into the JVM, and done once."""
    # what a section cannot read is found first; such a section is then computed over no elements, which gives its default
    failed = {
        "meta": first_error(meta.icon_refs()),
        "links": first_error(links.followed(links.anchors())),
        "images": first_error(F.filter(tags(["img"], F.col("linked")), lambda x: ~F.coalesce(attr(x, "src"), F.lit("")).startswith("data:"))),
        "media": first_error(media.media_refs()),
        "scripts_styles": first_error(media.script_refs()),
        "forms": first_error(tags(["form"], F.col("linked"))),
    }
    sound = lambda k: F.filter("linked", lambda x: F.col("_failed")[k].isNull())
    first = [
        F.array_compact(F.array(*[F.concat(F.lit(f"{k}: "), F.col("_failed")[k]) for k in failed])).alias("_errors"),
        text.text_stats().alias("text_stats"),
        F.when(F.col("_failed.meta").isNull(), meta.meta_section()).alias("meta"),
        meta.headings().alias("headings"),
        links.anchors(sound("links")).alias("_anc"),
        media.images(sound("images")).alias("_img"),
        media.media_section(sound("media")).alias("media"),
        media.scripts_styles(sound("scripts_styles")).alias("scripts_styles"),
        blocks.forms(sound("forms")).alias("forms"),
        blocks.tables().alias("tables"),
        blocks.structured_data().alias("structured_data"),
        text.keyword_density().alias("keyword_density"),
        audit.technologies(F.col("_html"), F.col("headers")).alias("technologies"),
        audit.security_headers(F.col("headers")).alias("security_headers"),
    ]
    second = [
        links.page_links(F.col("_anc")).alias("_links"),
        links.mailto(F.col("_anc")).alias("_mailto"),
        media.image_section(F.col("_img")).alias("images"),
    ]
    third = [
        links.links_section(F.col("_anc"), F.col("_links")).alias("links"),
        links.social_links(F.col("_links")).alias("social_links"),
        F.struct(text.emails(F.col("text"), F.col("_mailto")).alias("emails"), text.phones(F.col("text")).alias("phones")).alias("contacts"),
        audit.seo_checks(F.col("meta"), F.col("headings"), F.col("images"), F.col("text_stats"), F.col("final_url")).alias("_checks"),
    ]
    shown = [F.when(F.col("outcome") == "ok", F.col(c)).alias(c) for c in SECTIONS]
    return F.struct(*[c.alias(k) for k, c in failed.items()]), first, second, third, shown


def flat(report: DataFrame) -> DataFrame:
    """Scalar projection of the report (what the oracle compares for F0)."""
    r = F.col
    return report.select(
        "page_id", "final_url", "outcome",
        r("meta.title").alias("title"), r("meta.title_length").alias("title_length"), r("meta.language").alias("language"),
        r("meta.charset").alias("charset"),
        r("text_stats.word_count").alias("word_count"), r("text_stats.character_count").alias("character_count"),
        r("text_stats.estimated_reading_time_min").alias("reading_min"), r("text_stats.paragraph_count").alias("paragraph_count"),
        F.size(r("headings.h1")).cast("bigint").alias("h1_count"),
        r("links.total").alias("links_total"), r("links.internal_count").alias("internal_count"),
        r("links.external_count").alias("external_count"), r("images.count").alias("image_count"),
        r("seo.passed").alias("seo_passed"), r("seo.total").alias("seo_total"), r("seo.score_pct").alias("seo_score_pct"),
        F.array_join(r("technologies"), "; ").alias("technologies"),
        F.size(r("keyword_density")).cast("bigint").alias("keyword_rows"),
        F.array_join(r("contacts.emails"), " ").alias("emails"),
        F.array_join(r("_errors"), "; ").alias("errors"),
        r("ssl_info.valid").alias("ssl_valid"), r("ssl_info.error").alias("ssl_error"),
    )


# --------------------------------------------------------------------------- F1-F7


def crawl_summary(report: DataFrame) -> DataFrame:
    """one row — ok / failed pages, word, image and link totals, mean SEO (1 dp) and load (3 dp)."""
    ok = F.col("outcome") == "ok"
    return report.agg(
        F.count_if(ok).alias("pages_ok"),
        F.count_if(~ok).alias("pages_failed"),
        F.sum(F.when(ok, F.col("text_stats.word_count"))).alias("total_words"),
        F.sum(F.when(ok, F.col("images.count"))).alias("total_images"),
        F.sum(F.when(ok, F.col("links.internal_count"))).alias("total_internal"),
        F.sum(F.when(ok, F.col("links.external_count"))).alias("total_external"),
        F.round(F.avg(F.when(ok, F.col("seo.score_pct"))), 1).alias("avg_seo_pct"),
        F.round(F.avg(F.when(ok, F.col("elapsed_sec"))), 3).alias("avg_load_sec"),
    )


def overview(report: DataFrame, order_col: str = "page_id") -> DataFrame:
    """numbered list of ok pages in discovery order (numbered by ``global_rank``)."""
    title = F.coalesce(F.when(F.col("meta.title") != "", F.col("meta.title")), F.lit("(no title)"))
    shown = report.filter(F.col("outcome") == "ok").select(
        F.col(order_col).alias("_order"), "page_id", "status_code", F.substring(title, 1, 55).alias("title"), "final_url",
        F.col("text_stats.word_count").alias("words"), F.col("links.total").alias("links"),
        F.col("images.count").alias("images"), F.col("seo.score_pct").alias("seo_pct"),
    )
    return global_rank(shown, "_order", "n").select("n", "page_id", "status_code", "title", "final_url", "words", "links", "images", "seo_pct")


def global_rank(df: DataFrame, order_col: str, name: str) -> DataFrame:
    """1-based rank by ``order_col`` (unique) without funnelling all rows through one task.

    The rows are range-partitioned by the key and written once, each with the number of its
    partition; what is counted and what is numbered is that one stored table, so both see the same
    partitions however they are coalesced or read. The offsets are one row per partition."""
    path = scratch_path(df.sparkSession, "ranked")
    df.repartitionByRange(order_col).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = df.sparkSession.read.parquet(path)
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select("_part", (F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    local = Window.partitionBy("_part").orderBy(order_col)
    ranked = parts.withColumn("_local", F.row_number().over(local))
    return (
        ranked.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local")).cast("bigint"))
        .drop("_part", "_local", "_off")
    )


def failed_pages(report: DataFrame) -> DataFrame:
    """pages that failed or were skipped, with the reason."""
    return report.filter(F.col("outcome") != "ok").select(
        "page_id", "url", F.coalesce(F.col("outcome_reason"), F.lit("unknown")).alias("reason")
    )


def preview(c: Column, n: int | None = 10) -> Column:
    """first ``n`` items of a list and how many were left out (``n=None``: everything)."""
    if n is None:
        return F.struct(c.alias("shown"), F.lit(0).alias("more"))
    return F.struct(F.slice(c, 1, n).alias("shown"), F.greatest(F.size(c) - n, F.lit(0)).alias("more"))


def human_bytes(c: Column) -> Column:
    """B with no decimals, then KB/MB/GB/TB by 1024 with one decimal; null is "Unknown"."""
    x = c.cast("double")
    k = 1024.0
    fmt = lambda v, unit: F.format_string(f"%.1f {unit}", F.bround(v, 1))
    return (
        F.when(x.isNull(), F.lit("Unknown"))
        .when(x < k, F.format_string("%.0f B", F.bround(x, 0)))
        .when(x < k * k, fmt(x / k, "KB"))
        .when(x < k ** 3, fmt(x / k ** 2, "MB"))
        .when(x < k ** 4, fmt(x / k ** 3, "GB"))
        .otherwise(fmt(x / k ** 4, "TB"))
    )


def page_flags(report: DataFrame) -> DataFrame:
    """per-page display facts."""
    levels = [F.when(F.size(F.col(f"headings.h{i}")) > 0, F.lit(f"h{i}")) for i in range(1, 7)]
    ssl = F.col("ssl_info")
    ssl_text = (
        F.when(ssl.isNull(), F.lit("N/A (not HTTPS)"))
        .when(ssl["valid"], F.format_string("Valid -- expires %s (%s days left)", F.substring(ssl["expires"], 1, 10), ssl["days_until_expiry"].cast("string")))
        .otherwise(F.format_string("Could not verify -- %s", ssl["error"]))
    )
    return report.filter(F.col("outcome") == "ok").select(
        "page_id",
        (F.col("status_code") < 400).alias("status_ok"),
        "redirected",
        F.array_join(F.array_compact(F.array(*levels)), ",").alias("heading_levels"),
        F.size(F.map_keys(F.col("meta.open_graph"))).cast("bigint").alias("og_tags"),
        F.size(F.map_keys(F.col("meta.twitter_card"))).cast("bigint").alias("twitter_tags"),
        F.size("tables").cast("bigint").alias("table_count"),
        (F.col("security_headers.present_count") >= 4).alias("security_ok"),
        human_bytes(F.col("content_length_bytes")).alias("content_size"),
        ssl_text.alias("ssl_text"),
    )


def run_report(target: Column, mode: str, depth: int, pages: DataFrame, robots: DataFrame | None,
               sitemap: DataFrame | None, validation: DataFrame | None) -> DataFrame:
    """the run envelope as one row — each input is already a one-row aggregate, so the
    cross join is of single rows."""
    ok = F.col("outcome") == "ok"
    env = pages.agg(F.count(F.lit(1)).alias("pages_scraped"), F.count_if(ok).alias("pages_ok")).select(
        target.alias("target"), F.lit(mode).alias("mode"), F.lit(depth).alias("depth"), "pages_scraped", "pages_ok"
    )
    for part in (robots, sitemap, validation):
        if part is not None:
            env = env.crossJoin(part)
    return env
