"""Redirect hops: where a URL leads and through which URLs (A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.urls import resolve
from pagelens.session import scratch_path

MAX_REDIRECTS = 30


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def follow(hops: DataFrame, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """Every URL of a hop log (url, location) followed to its end: url, final_url, redirect_chain, error.

    ``redirect_chain`` has the URLs passed through in order, the first one included and the last one not. More
    than ``max_redirects`` hops, so every loop too, give an error, an empty chain and the URL itself.

    Pointers are doubled: after k rounds a row has followed up to 2^k hops, so five rounds settle 30. Rows
    that have come to an end leave the rounds; each round is one equi-join on the URL, which is unique on the
    right side, so a target of many rows is split on the left (AQE skew join), and is stored, as the
    next one reads it twice. A location is resolved against its URL; of several hops of a URL the one
    with the smallest target counts; hops without URL or location are none.
    """
    to = resolve(F.col("url"), F.col("location"))
    one = hops.filter("url IS NOT NULL AND location IS NOT NULL").select("url", to.alias("to")).groupBy("url").agg(F.min("to").alias("to"))
    going = _stored(one.withColumn("path", F.array("url")), "redirect-hops")
    done, reach = going.limit(0), 1
    while reach <= max_redirects:
        # all that is known of a target: rows on their way and rows that have come to an end
        known = going.unionByName(done).select(F.col("url").alias("at"), F.col("to").alias("next"), F.col("path").alias("more"))
        step = going.join(known, F.col("to") == F.col("at"), "left").select(
            "url", F.coalesce("next", "to").alias("to"), F.concat("path", F.coalesce("more", F.array().cast("array<string>"))).alias("path"), F.col("at").isNull().alias("ended"))
        step = _stored(step, "redirect-round")
        done = done.unionByName(step.filter("ended").drop("ended"))
        going = step.filter("NOT ended").drop("ended")
        reach *= 2
    too_many = F.size("path") > max_redirects
    return done.unionByName(going).select(
        "url", F.when(too_many, F.col("url")).otherwise(F.col("to")).alias("final_url"),
        F.when(too_many, F.array().cast("array<string>")).otherwise(F.col("path")).alias("redirect_chain"),
        F.when(too_many, F.lit(f"Exceeded {max_redirects} redirects.")).alias("error"))


def with_redirects(pages: DataFrame, hops: DataFrame, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """The pages with ``final_url``, ``redirect_chain`` and, where there were too many, ``error`` from a hop log."""
    ends = follow(hops, max_redirects).select(F.col("url").alias("_from"), F.col("final_url").alias("_final"), F.col("redirect_chain").alias("_chain"), F.col("error").alias("_error"))
    own = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    return (pages.join(ends, F.col("url") == F.col("_from"), "left")
            .withColumn("final_url", F.coalesce("_final", "url"))
            .withColumn("redirect_chain", F.coalesce("_chain", F.array().cast("array<string>")))
            .withColumn("error", F.coalesce(F.col("_error"), own)).drop("_from", "_final", "_chain", "_error"))
