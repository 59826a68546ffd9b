"""Report writers: JSON (nested), CSV (flat) and text lines.

Each writer is a distributed ``df.write`` into a directory the caller names; nothing is gathered
on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.operators.health import broken_links, link_validation
from pagelens.plans.report import crawl_summary, failed_pages, global_rank
from pagelens.session import scratch_path

CSV_FIELDS = ["url", "status_code", "title", "word_count", "h1_count", "internal_links", "external_links", "images",
              "missing_alt", "seo_score_pct", "load_time_sec", "technologies"]


def write_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: one JSON object per page, non-ASCII kept as is."""
    report.write.mode(mode).option("ignoreNullFields", "false").json(path)


def flatten_csv(report: DataFrame) -> DataFrame:
    """A5: the 12 flat columns; failed/skipped pages carry only url and status (ERROR if none)."""
    ok = F.col("outcome") == "ok"
    val = lambda c: F.when(ok, c.cast("string"))
    return report.select(
        "page_id",
        F.when(ok, F.col("final_url")).otherwise(F.col("url")).alias("url"),
        F.when(ok, F.col("status_code").cast("string")).otherwise(F.coalesce(F.col("status_code").cast("string"), F.lit("ERROR"))).alias("status_code"),
        val(F.substring(F.coalesce(F.col("meta.title"), F.lit("")), 1, 120)).alias("title"),
        val(F.col("text_stats.word_count")).alias("word_count"),
        val(F.size("headings.h1")).alias("h1_count"),
        val(F.col("links.internal_count")).alias("internal_links"),
        val(F.col("links.external_count")).alias("external_links"),
        val(F.col("images.count")).alias("images"),
        val(F.col("images.missing_alt_count")).alias("missing_alt"),
        val(F.col("seo.score_pct")).alias("seo_score_pct"),
        val(F.col("elapsed_sec")).alias("load_time_sec"),
        val(F.array_join("technologies", "; ")).alias("technologies"),
    )


def write_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    flatten_csv(report).select(*CSV_FIELDS).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def report_lines(report: DataFrame, order_col: str = "page_id") -> DataFrame:
    """The overview block per ok page — three lines: "  n. [status] title", the URL, and
    "words=.. links=.. images=.. seo=..%". (rank, line_no, line)."""
    title = F.substring(F.coalesce(F.when(F.col("meta.title") != "", F.col("meta.title")), F.lit("(no title)")), 1, 55)
    shown = report.filter(F.col("outcome") == "ok").select(
        F.col(order_col).alias("_order"), "status_code", title.alias("title"), "final_url", F.col("text_stats.word_count").alias("words"),
        F.col("links.total").alias("links"), F.col("images.count").alias("images"), F.col("seo.score_pct").alias("seo_pct"))
    ok = global_rank(shown, "_order", "rank")
    lines = F.array(
        F.format_string("  %2d. [%d] %s", F.col("rank"), F.col("status_code"), F.col("title")),
        F.format_string("      %s", F.col("final_url")),
        F.format_string("      words=%d  links=%d  images=%d  seo=%s%%", F.col("words"), F.col("links"),
                        F.col("images"), F.col("seo_pct").cast("string")),
    )
    return ok.select("rank", F.posexplode(lines).alias("line_no", "line"))


def write_text(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report_lines(report).orderBy("rank", "line_no").select("line").write.mode(mode).text(path)


# --------------------------------------------------------------------------- the text of a whole run


def _key(name: str, value: Column) -> Column:
    return F.concat(F.lit("    " + name.ljust(dims.KEY_WIDTH) + ": "), value.cast("string"))


def _section(title: Column) -> list[Column]:
    shown = F.concat(F.lit(" "), title, F.lit(" "))
    pad = F.greatest(F.lit(4), F.lit(dims.SECTION_WIDTH) - F.char_length(shown))
    left = F.floor(pad / 2).cast("int")
    return [F.lit(""), F.concat(F.repeat(F.lit("="), left), shown, F.repeat(F.lit("="), pad - left))]


def _subsection(title: str) -> list[Column]:
    return [F.lit(""), F.lit(f">> {title} " + "-" * max(2, dims.SUBSECTION_WIDTH - len(title)))]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_lines(report: DataFrame, status: DataFrame, order_col: str = "page_id", broken: int = 50) -> DataFrame:
    """A6, a whole run: crawl summary, overview of the ok pages, failed and skipped pages with their
    reasons, link validation with the first ``broken`` broken links. (part, rank, line_no, line).

    Parts are left out as the run has nothing for them: averages and overview without ok pages, the
    failed pages without any, the broken links' detail without any. The columns needed of the report
    and the link statuses are stored once; headings come from the one row of their totals.
    """
    nested = {"meta": ["title"], "text_stats": ["word_count"], "links": ["total", "internal_count", "external_count"], "images": ["count"], "seo": ["score_pct"]}
    slim = report.select(*{order_col, "page_id"}, "url", "final_url", "outcome", "outcome_reason", "status_code", "elapsed_sec",
                         *[F.struct(*[F.col(f"{s}.{c}").alias(c) for c in cs]).alias(s) for s, cs in nested.items()])
    slim, status = _stored(slim, "run-pages"), _stored(status, "run-links")
    row = lambda df, part, lines: df.select(F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("rank"), F.posexplode_outer(F.array_compact(F.array(*lines))).alias("line_no", "line")).filter("line IS NOT NULL")
    given = lambda test, lines: [F.when(test, x) for x in lines]

    total = crawl_summary(slim)
    any_ok, any_failed = F.col("pages_ok") > 0, F.col("pages_failed") > 0
    head = row(total, 1, [
        *_section(F.concat(F.lit("CRAWL SUMMARY -- "), (F.col("pages_ok") + F.col("pages_failed")).cast("string"), F.lit(" pages visited"))),
        _key("Pages scraped successfully", F.col("pages_ok")), *given(any_failed, [_key("Pages failed / skipped", F.col("pages_failed"))]),
        *given(any_ok, [_key("Total words (all pages)", F.col("total_words")), _key("Total images (all pages)", F.col("total_images")),
                        _key("Total internal links", F.col("total_internal")), _key("Total external links", F.col("total_external")),
                        _key("Average SEO score", F.concat(F.col("avg_seo_pct").cast("string"), F.lit("%"))), _key("Average load time", F.concat(F.col("avg_load_sec").cast("string"), F.lit("s"))),
                        *_subsection("Pages Overview")])])
    pages = report_lines(slim, order_col).select(F.lit(2).alias("part"), "rank", "line_no", "line")

    failed_head = row(total, 3, given(any_failed, _subsection("Failed / Skipped Pages")))
    failed = global_rank(failed_pages(slim.withColumn("page_id", F.col(order_col))), "page_id", "rank")
    failed = failed.select(F.lit(3).alias("part"), "rank", F.lit(0).alias("line_no"), F.concat(F.lit("  [X] "), F.coalesce("url", F.lit("")), F.lit(" -- "), F.col("reason")).alias("line"))

    checked = link_validation(status)
    links = row(checked, 4, [*_section(F.lit("LINK VALIDATION")), _key("Links Checked", F.col("checked")), _key("Working", F.col("ok_count")), _key("Broken", F.col("broken_count")),
                             *given(F.col("broken_count") > 0, _subsection("Broken Links Detail"))])
    why = F.when(F.col("error") != "", F.concat(F.lit(" ("), F.col("error"), F.lit(")"))).otherwise("")
    shown = broken_links(status, broken).withColumn("rank", F.row_number().over(Window.orderBy("url")).cast("bigint"))  # at most ``broken`` rows
    detail = shown.select(F.lit(4).alias("part"), "rank", F.lit(0).alias("line_no"), F.concat(F.lit("  [X] ["), F.col("code"), F.lit("] "), F.col("url"), why).alias("line"))
    more = row(checked, 5, given(F.col("broken_count") > broken, [F.concat(F.lit("  ... and "), (F.col("broken_count") - broken).cast("string"), F.lit(" more"))]))

    out = head
    for part in (pages, failed_head, failed, links, detail, more):
        out = out.unionByName(part)
    return out


def write_run_text(report: DataFrame, status: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The lines of a run in order, as text files in the order of their names."""
    run_lines(report, status).orderBy("part", "rank", "line_no").select("line").write.mode(mode).text(path)
