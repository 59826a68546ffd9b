"""Stored pages as the input relation (A1-A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.urls import normalize_url
from pagelens.session import ensure_conf, spread

# optional envelope columns and their defaults when a page table does not carry them
ENVELOPE = [
    ("final_url", "string", None),  # defaults to url
    ("redirect_chain", "array<string>", "array()"),
    ("fetched_at", "timestamp", None),
    ("status_code", "int", "200"),
    ("reason", "string", "'OK'"),
    ("elapsed_sec", "double", None),
    ("content_type", "string", "'text/html'"),
    ("encoding", "string", None),
    ("headers", "map<string,string>", "map()"),
    ("error", "string", None),
]


def with_envelope(df: DataFrame) -> DataFrame:
    """Fill absent envelope columns with their defaults and derive the page envelope:
    redirected, content length in bytes (UTF-8 size of the stored text), elapsed to 3 dp."""
    cols = set(df.columns)
    out = df
    for name, typ, default in ENVELOPE:
        if name == "final_url":
            val = F.col("final_url") if name in cols else F.col("url")
            out = out.withColumn(name, F.coalesce(val, F.col("url")))
        elif name not in cols:
            out = out.withColumn(name, (F.expr(default) if default else F.lit(None)).cast(typ))
        elif default:
            out = out.withColumn(name, F.coalesce(F.col(name), F.expr(default).cast(typ)))
    return (
        out.withColumn("redirected", F.col("final_url") != F.col("url"))
        .withColumn("content_length_bytes", F.octet_length("html").cast("bigint"))
        .withColumn("elapsed_sec", F.round("elapsed_sec", 3))
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A1: the stored-page table with the fetch envelope."""
    ensure_conf(spark)
    return with_envelope(spread(spark.read.parquet(path)))


def classify(pages: DataFrame) -> DataFrame:
    """A2: outcome of each fetch — ``error`` (no response), ``skipped`` (content type without
    text/html, any case) or ``ok``. The HTTP status does not matter."""
    ctype = F.coalesce(F.col("content_type"), F.lit(""))
    outcome = (
        F.when(F.col("error").isNotNull() | F.col("status_code").isNull(), "error")
        .when(~F.lower(ctype).contains("text/html"), "skipped")
        .otherwise("ok")
    )
    reason = (
        F.when(outcome == "error", F.coalesce(F.col("error"), F.lit("Unknown error")))
        .when(outcome == "skipped", F.concat(F.lit("non-HTML content ("), F.when(ctype == "", "unknown").otherwise(ctype), F.lit(")")))
    )
    return pages.withColumn("outcome", outcome).withColumn("outcome_reason", reason)


def seed_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """A3: normalised seed URLs."""
    return df.withColumn("seed", normalize_url(F.col(col)))
