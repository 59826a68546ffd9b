"""SEO checks and score, security headers, technologies, certificates, extractor errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.functions.urls import hostname
from pagelens.operators.parse import truthy

CHECK_TYPE = "array<struct<name:string,passed:boolean,detail:string>>"


def _check(name: str, passed: Column, detail: Column, when: Column | None = None) -> Column:
    s = F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail"))
    return s if when is None else F.when(when, s)


def seo_checks(meta: Column, headings: Column, images: Column, text_stats: Column, url: Column) -> Column:
    """The ordered checklist: 9 fixed checks plus 3 that apply only when their subject exists."""
    title, tl = meta["title"], meta["title_length"]
    desc, dl = meta["description"], meta["description_length"]
    preview = F.when(F.char_length(desc) > 60, F.concat(F.substring(desc, 1, 60), F.lit("..."))).otherwise(desc)
    h1 = F.size(headings["h1"])
    robots = F.lower(F.coalesce(meta["robots"], F.lit("")))
    img_count, missing = images["count"], images["missing_alt_count"]
    wc = text_stats["word_count"]
    or_text = lambda c, t: F.when(truthy(c), c).otherwise(F.lit(t))
    checks = F.array(
        _check("Title tag present", truthy(title), or_text(title, "Missing <title> tag")),
        _check("Title length optimal (30-60 chars)", (tl >= 30) & (tl <= 60), F.format_string("%d characters", tl), truthy(title)),
        _check("Meta description present", truthy(desc), or_text(preview, "Missing meta description")),
        _check("Description length optimal (120-160 chars)", (dl >= 120) & (dl <= 160), F.format_string("%d characters", dl), truthy(desc)),
        _check("Exactly one H1 tag", h1 == 1, F.format_string("%d H1 tag(s) found", h1)),
        _check("Canonical URL set", truthy(meta["canonical"]), or_text(meta["canonical"], "No canonical link")),
        _check("Viewport meta (mobile-friendly)", truthy(meta["viewport"]), or_text(meta["viewport"], "Missing viewport tag")),
        _check("Language attribute set", truthy(meta["language"]), or_text(meta["language"], "Missing lang attribute")),
        _check("Not blocking search indexing", ~robots.contains("noindex"), or_text(meta["robots"], "No robots meta tag")),
        _check("Images have alt text", missing == 0, F.format_string("%d/%d images missing alt text", missing, img_count), img_count > 0),
        _check("Uses HTTPS", F.lower(url).startswith("https"), F.upper(F.substring_index(url, "://", 1))),
        _check("Sufficient content length (300+ words)", wc >= 300, F.format_string("%d words", wc)),
    )
    return F.filter(checks, lambda c: c.isNotNull())


def seo_section(checks: Column) -> Column:
    passed = F.size(F.filter(checks, lambda c: c["passed"]))
    total = F.size(checks)
    return F.struct(
        checks.alias("checks"),
        passed.cast("bigint").alias("passed"),
        total.cast("bigint").alias("total"),
        F.round(passed * 100.0 / F.greatest(total, F.lit(1)), 1).alias("score_pct"),
    )


def security_headers(headers: Column) -> Column:
    """The 7 security headers looked up case-insensitively, how many are non-empty, and 7."""
    low = F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    vals = [F.element_at(low, F.lit(h.lower())) for h in dims.SECURITY_HEADER_NAMES]
    present = sum((F.when(truthy(v), 1).otherwise(0) for v in vals), F.lit(0))
    return F.struct(
        F.map_from_arrays(F.array(*[F.lit(h) for h in dims.SECURITY_HEADER_NAMES]), F.array(*vals)).alias("headers"),
        present.cast("bigint").alias("present_count"),
        F.lit(len(dims.SECURITY_HEADER_NAMES)).cast("bigint").alias("total"),
    )


def header_text(headers: Column) -> Column:
    """"k:v k:v ..." in map order."""
    h = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    return F.array_join(F.transform(F.map_entries(h), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")


def technologies(html: Column, headers: Column) -> Column:
    """Sorted names of technologies with a pattern matching html + " " + header text, any case."""
    combined = F.concat(F.coalesce(html, F.lit("")), F.lit(" "), header_text(headers))
    hits = [F.when(combined.rlike("(?iU)" + "|".join(f"(?:{p})" for p in pats)), F.lit(name)) for name, pats in dims.TECH_SIGNATURES]
    return F.array_sort(F.array_compact(F.array(*hits)))


# --------------------------------------------------------------------------- certificates


def cert_status(certs: DataFrame, as_of: Column) -> DataFrame:
    """Certificate facts per host: valid, issuer (organisation else common name), subject common
    name, expiry (ISO text) and whole days until expiry (floored). Error rows are invalid.

    ``certs``: hostname, issuer MAP, subject MAP, not_after STRING ("Jun  1 12:00:00 2025 GMT"),
    error STRING.
    """
    squeezed = F.regexp_replace(F.col("not_after"), " +", " ")
    expiry = F.try_to_timestamp(squeezed, F.lit("MMM d HH:mm:ss yyyy z"))
    secs = F.unix_timestamp(expiry) - F.unix_timestamp(as_of)
    ok = F.col("error").isNull()
    return certs.select(
        "hostname",
        ok.alias("valid"),
        F.when(ok, F.coalesce(F.element_at("issuer", F.lit("organizationName")), F.element_at("issuer", F.lit("commonName")))).alias("issuer"),
        F.when(ok, F.element_at("subject", F.lit("commonName"))).alias("subject"),
        F.when(ok, F.date_format(expiry, "yyyy-MM-dd'T'HH:mm:ss")).alias("expires"),
        F.when(ok, F.floor(secs / 86400)).cast("bigint").alias("days_until_expiry"),
        F.col("error"),
    )


def ssl_for_pages(pages: DataFrame, certs_status: DataFrame) -> DataFrame:
    """Attach certificate facts to https pages (null for other schemes; missing cert row = error)."""
    p = pages.select("page_id", "final_url", hostname(F.col("final_url")).alias("hostname"))
    j = p.join(certs_status, "hostname", "left")
    https = F.lower(F.col("final_url")).startswith("https")
    info = F.when(
        https,
        F.when(
            F.col("valid").isNull(),
            F.struct(F.lit(False).alias("valid"), *[F.lit(None).cast(t).alias(n) for n, t in
                     [("issuer", "string"), ("subject", "string"), ("expires", "string"), ("days_until_expiry", "bigint")]],
                     F.lit("no certificate record").alias("error")),
        ).otherwise(F.struct("valid", "issuer", "subject", "expires", "days_until_expiry", "error")),
    )
    return j.select("page_id", info.alias("ssl_info"))
