"""The text export of a run: order of its lines, parts that are left out."""

from pyspark.sql import functions as F

from pagelens.plans.sinks import run_lines, write_run_text

PAGES = ("page_id bigint, url string, final_url string, outcome string, outcome_reason string, status_code int, elapsed_sec double, meta struct<title:string>, "
         "text_stats struct<word_count:bigint>, links struct<total:bigint,internal_count:bigint,external_count:bigint>, images struct<count:bigint>, seo struct<score_pct:double>")
STATUS = "url string, status_code int, ok boolean, error string"


def page(i, outcome="ok", reason=None, title="T"):
    ok = outcome == "ok"
    return (i, f"u{i}", f"f{i}" if ok else None, outcome, reason, 200 if ok else None, 0.5 if ok else None, (title,) if ok else None, (10 * i,) if ok else None,
            (3, 2, 1) if ok else None, (4,) if ok else None, (50.0,) if ok else None)


def test_lines_in_order(spark, tmp_path):
    pages = [page(3, title=None), page(1, title="x" * 80), page(2, "error", "no route"), page(4, "skipped")]
    links = [("b", 404, False, None), ("a", None, False, "timed out"), ("c", 200, True, None), ("d", None, False, "")]
    path = str(tmp_path / "run")
    write_run_text(spark.createDataFrame(pages, PAGES), spark.createDataFrame(links, STATUS), path)
    got = "\n".join(open(f).read()[:-1] for f in sorted((tmp_path / "run").glob("part-*")) if f.stat().st_size)
    assert got.split("\n") == [
        "", "=" * 20 + " CRAWL SUMMARY -- 4 pages visited " + "=" * 20, "    Pages scraped successfully: 2", "    Pages failed / skipped  : 2", "    Total words (all pages) : 40",
        "    Total images (all pages): 8", "    Total internal links    : 4", "    Total external links    : 2", "    Average SEO score       : 50.0%", "    Average load time       : 0.5s",
        "", ">> Pages Overview " + "-" * 30, "   1. [200] " + "x" * 55, "      f1", "      words=10  links=3  images=4  seo=50.0%", "   2. [200] (no title)", "      f3",
        "      words=30  links=3  images=4  seo=50.0%", "", ">> Failed / Skipped Pages " + "-" * 22, "  [X] u2 -- no route", "  [X] u4 -- unknown",
        "", "=" * 28 + " LINK VALIDATION " + "=" * 29, "    Links Checked           : 4", "    Working                 : 1", "    Broken                  : 3",
        "", ">> Broken Links Detail " + "-" * 25, "  [X] [ERR] a (timed out)", "  [X] [404] b", "  [X] [ERR] d"]


def test_parts_left_out(spark):
    lines = lambda pages, links, **kw: [r.line for r in run_lines(spark.createDataFrame(pages, PAGES), spark.createDataFrame(links, STATUS), **kw).orderBy("part", "rank", "line_no").collect()]
    none = lines([], [])
    assert [x for x in none if x and "=" not in x] == ["    Pages scraped successfully: 0", "    Links Checked           : 0", "    Working                 : 0", "    Broken                  : 0"]
    many = lines([page(1)], [(f"u{k:02}", 500, False, None) for k in range(9)], broken=4)
    assert many[-1] == "  ... and 5 more" and many[-2] == "  [X] [500] u03" and not any("Failed" in x for x in many)
