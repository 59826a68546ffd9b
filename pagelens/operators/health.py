"""Link health from a probe log.

``probes``: (url, method HEAD|GET, attempt, status_code?, error?). The HEAD result decides unless
it is 400 or more, then the GET result does; a transport error (no status) makes the link broken
with the error text cut to 150 characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_status(urls: DataFrame, probes: DataFrame) -> DataFrame:
    """(url, status_code, ok, error) for every URL of ``urls``.

    The first HEAD and first GET per URL are picked with filtered ``min_by`` aggregates (partial
    aggregation map-side), then joined to the URL list on url.
    """
    first = probes.groupBy("url").agg(
        F.min_by(F.struct("status_code", "error"), F.when(F.col("method") == "HEAD", F.col("attempt"))).alias("h"),
        F.min_by(F.struct("status_code", "error"), F.when(F.col("method") == "GET", F.col("attempt"))).alias("g"),
    )
    j = urls.select("url").join(first, "url", "left")
    h, g = F.col("h"), F.col("g")
    use_get = h["status_code"] >= 400
    res = F.when(h["status_code"].isNull(), h).when(use_get, g).otherwise(h)
    status = res["status_code"]
    err = F.when(status.isNull(), F.substring(F.coalesce(res["error"], F.lit("no probe recorded")), 1, 150))
    return j.select("url", status.alias("status_code"), F.coalesce(status < 400, F.lit(False)).alias("ok"), err.alias("error"))


def link_validation(status: DataFrame) -> DataFrame:
    """One row — checked, ok_count, broken_count."""
    return status.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if("ok").alias("ok_count"),
        F.count_if(~F.col("ok")).alias("broken_count"),
    )


def broken_links(status: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` broken links by URL (code or ERR, error) and how many were left out.

    ``orderBy().limit()`` plans as a top-k (each partition keeps its best n, one small merge)."""
    broken = status.filter(~F.col("ok"))
    shown = broken.orderBy("url").limit(n).select(
        "url", F.coalesce(F.col("status_code").cast("string"), F.lit("ERR")).alias("code"), "error"
    )
    more = broken.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more_count"))
    return shown.crossJoin(more)
