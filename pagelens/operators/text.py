"""Text statistics, paragraphs, contacts and keyword density."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.functions import html as H
from pagelens.operators.parse import let, page_cols

WORD = dims.WORD_PATTERN


@page_cols
def words(text: Column | None = None) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


@page_cols
def word_count(text: Column | None = None) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def reading_minutes(wc: Column) -> Column:
    """0 without words, else max(1, round-half-even(words / 200))."""
    return F.when(wc == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.bround(wc / F.lit(float(dims.WORDS_PER_MINUTE)), 0).cast("int"))
    )


@page_cols
def text_sample(text: Column | None = None) -> Column:
    n = dims.TEXT_SAMPLE_CHARS
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


@page_cols
def paragraph_count(els: Column | None = None) -> Column:
    return F.size(F.filter(els, lambda x: x["name"] == "p")).cast("bigint")


@page_cols
def text_stats(text: Column | None = None, els: Column | None = None, with_paragraphs: bool = True) -> Column:
    wc = word_count(text)
    fields = [
        wc.alias("word_count"),
        F.char_length(text).cast("bigint").alias("character_count"),
        reading_minutes(wc).alias("estimated_reading_time_min"),
        text_sample(text).alias("text_sample"),
    ]
    if with_paragraphs:
        fields.append(paragraph_count(els).alias("paragraph_count"))
    return F.struct(*fields)


def plain_text(c: Column) -> Column:
    """Text of a plain-text document as the page analyzer would see it (whitespace squeezed)."""
    return H.squeeze(F.coalesce(c, F.lit("")))


# --------------------------------------------------------------------------- contacts


@page_cols
def emails(text: Column | None = None, mailto: Column | None = None) -> Column:
    """Sorted distinct e-mail addresses of the text plus mailto targets (before "?", stripped);
    names ending in an image/style/script extension are dropped."""
    found = F.regexp_extract_all(text, F.lit(dims.EMAIL_PATTERN), 0)
    if mailto is not None:
        addrs = F.filter(F.transform(mailto, lambda m: H.strip(F.substring_index(m, "?", 1))), lambda a: a != "")
        found = F.concat(found, addrs)
    kept = F.filter(found, lambda e: ~e.rlike("(?i)" + dims.NON_EMAIL_SUFFIX))
    return F.array_sort(F.array_distinct(kept))


@page_cols
def phones(text: Column | None = None) -> Column:
    """Sorted distinct stripped phone-like matches with at least 7 digits."""
    raw = F.regexp_extract_all(text, F.lit("(?U)" + dims.PHONE_PATTERN), 0)
    cands = F.transform(raw, lambda p: H.strip(p))
    kept = F.filter(cands, lambda p: F.length(F.regexp_replace(p, r"(?U)\D", "")) >= 7)
    return F.array_sort(F.array_distinct(kept))


# --------------------------------------------------------------------------- keywords


@page_cols
def keyword_density(text: Column | None = None, top_n: int = dims.TOP_KEYWORDS) -> Column:
    """Top words of a page: lower-cased words longer than 2 whose apostrophe-free form is not a
    stop word; by count, ties by first occurrence; density over all kept words (2 dp).

    Row-local: the kept words are sorted with their positions, word runs are found by comparing
    neighbours, and each run's length is its count and its first position the first occurrence.
    O(n log n) per page inside the JVM, no shuffle; stop words are a hash-set test (``isin``). array<struct<word, count, density_pct>>.
    """
    stop = dims.stopword_list()
    low = F.transform(words(text), lambda w: F.lower(w))
    # the length test is per occurrence (cheap); the stop-word test runs once per distinct word
    cand = F.filter(F.transform(low, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: F.length(x["word"]) > 2)

    def count_runs(srt):
        n = F.size(srt)
        idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        # 0-based positions where a new word starts in the sorted list
        run_starts = F.filter(idx, lambda k: (k == 0) | (F.get(srt, k)["word"] != F.get(srt, k - 1)["word"]))

        def runs_of(rs):
            m = F.size(rs)
            ridx = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
            runs = F.transform(
                ridx,
                lambda j: F.struct(
                    (F.get(rs, j) - F.coalesce(F.get(rs, j + 1), n)).alias("neg_count"),
                    F.get(srt, F.get(rs, j))["pos"].alias("first"),
                    F.get(srt, F.get(rs, j))["word"].alias("word"),
                ),
            )
            kept = F.filter(runs, lambda r: ~F.replace(r["word"], F.lit("'"), F.lit("")).isin(stop))

            def top_of(kr):
                total = F.aggregate(kr, F.lit(0).cast("bigint"), lambda acc, r: acc - r["neg_count"])
                top = F.slice(F.sort_array(kr), 1, top_n)
                return let(total, lambda tot: F.transform(
                    top,
                    lambda r: F.struct(
                        r["word"].alias("word"),
                        (-r["neg_count"]).cast("bigint").alias("count"),
                        F.round(-r["neg_count"] / tot * 100, 2).alias("density_pct"),
                    ),
                ))

            return let(kept, top_of)

        return let(run_starts, runs_of)

    return let(F.sort_array(cand), count_runs)
