"""Breadth-first crawl over a stored corpus, its trace, and fetch outcomes from an attempt log.

The crawl is a driver loop with one iteration per depth level (the depth limit is a small user
parameter); each iteration is a handful of joins on the executors. The visited set, the frontier
and the page budget are global across levels, so the crawl is not one recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.functions.urls import cut_fragment, netloc
from pagelens.operators.parse import exploded
from pagelens.operators.robots import can_fetch
from pagelens.session import scratch_path

RECORD_COLS = ["seq", "url", "depth", "outcome", "reason"]


def crawl(spark: SparkSession, outcomes: DataFrame | None, edges: DataFrame | None, seed: str, depth: int, max_pages: int,
          rules: DataFrame | None = None, user_agent: str = dims.DEFAULT_USER_AGENT,
          index: str | None = None) -> tuple[DataFrame, DataFrame]:
    """FIFO breadth-first crawl from ``seed``.

    ``outcomes``: (url, outcome, reason) per stored fetch, keyed by the requested URL;
    ``edges``: (src, rank, dst) internal links of ok pages in document order, fragments cut.
    Alternatively ``index`` names a table that ``index_corpus`` wrote: a level then reads the buckets of the URLs it
    takes and nothing else, so no level touches the pages themselves.
    Returns (records, blocked): records (seq, url, depth, outcome, reason) in crawl order, at
    most ``max_pages``; blocked (url, depth) robots-blocked URLs that were dequeued.

    FIFO order is reproduced by ranking each level by (parent's sequence number, link rank). A URL
    is visited on first dequeue; robots-blocked URLs are visited but use no budget; failed and
    non-HTML pages use budget and are not expanded. A level writes its candidates, what it takes and what that gave to
    the shared folder; everything later reads those tables, so lineage stays one level deep.
    """
    if rules is not None:
        rules = stored(rules, "crawl-rules")  # parsed once, not once a level
    seed_norm = seed.split("#")[0]
    seed_net = netloc(F.lit(seed_norm))
    frontier = spark.createDataFrame([(seed_norm, 0, 0)], "url string, parent_seq long, link_rank int")
    visited = spark.createDataFrame([], "url string")
    records = spark.createDataFrame([], "seq long, url string, depth int, outcome string, reason string")
    blocked_all = spark.createDataFrame([], "url string, depth int")
    taken_so_far = 0
    for d in range(depth + 1):
        cand = frontier.groupBy("url").agg(F.min(F.struct("parent_seq", "link_rank")).alias("ord"))
        cand = cand.join(visited, "url", "left_anti")
        cand = can_fetch(cand, rules, user_agent) if rules is not None else cand.withColumn("allowed", F.lit(True))
        cand = stored(cand.select("url", "ord", "allowed"), f"crawl-candidates{d}")
        budget = max_pages - taken_so_far
        # a top-k: the level's first URLs, as many as the budget has left
        ranked = cand.filter("allowed").select("url", "ord").orderBy("ord").limit(budget)
        ranked = stored(ranked.withColumn("r", F.row_number().over(Window.orderBy("ord"))), f"crawl-taken{d}")
        n_taken = ranked.count()
        if n_taken == 0 and cand.isEmpty():
            break
        # blocked URLs dequeued before the budget ran out are visited (and reported)
        blocked = cand.filter(~F.col("allowed"))
        if n_taken == budget:
            blocked = blocked.crossJoin(F.broadcast(ranked.agg(F.max("ord").alias("m")))).filter(F.col("ord") < F.col("m"))
        blocked = blocked.select("url", F.lit(d).alias("depth"))
        blocked_all = blocked_all.unionByName(blocked)
        if index is not None:
            found = read_index(spark, index, ranked).select("url", "outcome", "reason", "internal")
        else:
            found = outcomes.select("url", "outcome", "reason").withColumn("internal", F.lit(None).cast("array<string>"))
        recs = stored(ranked.join(found, "url", "left").select(
            (F.col("r") + F.lit(taken_so_far)).cast("long").alias("seq"), "url", F.lit(d).alias("depth"),
            F.coalesce("outcome", F.lit("error")).alias("outcome"),
            F.when(F.col("outcome").isNull(), F.lit("not in the stored corpus")).otherwise(F.col("reason")).alias("reason"), "internal",
        ), f"crawl-records{d}")
        records = records.unionByName(recs.select(*RECORD_COLS))
        visited = visited.unionByName(ranked.select("url")).unionByName(blocked.select("url"))
        taken_so_far += n_taken
        if taken_so_far >= max_pages or d == depth:
            break
        ok = recs.filter(F.col("outcome") == "ok")
        if index is not None:
            nxt = exploded(ok, [F.col("seq").alias("parent_seq")], F.col("internal"), "link_rank", "url")
        else:
            nxt = ok.select(F.col("url").alias("src"), F.col("seq").alias("parent_seq")).join(edges, "src").select(
                F.col("dst").alias("url"), "parent_seq", F.col("rank").cast("int").alias("link_rank"))
        frontier = nxt.filter(netloc(F.col("url")) == seed_net).select("url", "parent_seq", "link_rank")
    return records, blocked_all


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket(url, buckets: int):
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def index_corpus(pages: DataFrame, path: str, buckets: int = 64) -> str:
    """Writes what crawls need of a stored corpus, once: per requested URL the outcome and the links to follow, in folders by
    URL bucket and sorted by URL inside. Any number of crawls then run on it."""
    table = fetch_table(pages).select("url", "outcome", "reason", "internal", _bucket(F.col("url"), buckets).alias("bucket"))
    table.repartition(buckets, "bucket").sortWithinPartitions("bucket", "url").write.partitionBy("bucket").parquet(path)
    pages.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}-buckets")
    return path


def read_index(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """The index's rows in the buckets of the given URLs; the list of buckets is at most their number, which is fixed."""
    buckets = spark.read.parquet(f"{path}-buckets").first().buckets
    own = [r.b for r in urls.select(_bucket(F.col("url"), buckets).alias("b")).distinct().collect()]
    schema = "url string, outcome string, reason string, internal array<string>, bucket int"
    return spark.read.schema(schema).parquet(path).filter(F.col("bucket").isin(own))


def crawl_trace(records: DataFrame, blocked: DataFrame) -> DataFrame:
    """One line per dequeued URL — crawled ones with their sequence number, then blocked ones."""
    return records.select("seq", "url", "depth", "outcome").unionByName(
        blocked.select(F.lit(None).cast("long").alias("seq"), "url", "depth", F.lit("robots-blocked").alias("outcome"))
    )


def fetch_outcome(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """Per URL, the first attempt within ``retries`` that got any response, else the last error.

    One ``groupBy(url)`` of declarative aggregates (``min_by``/``max_by`` with filters): partial
    aggregation runs map-side, so a URL with a third of all attempts never lands in one task raw.
    """
    within = F.col("attempt") <= retries
    got = within & F.col("status_code").isNotNull()
    return attempts.groupBy("url").agg(
        F.min_by(F.struct("attempt", "status_code", "elapsed_sec"), F.when(got, F.col("attempt"))).alias("g"),
        F.max_by(F.col("error"), F.when(within, F.col("attempt"))).alias("last_error"),
        F.count_if(within).alias("attempts"),
    ).select(
        "url",
        F.col("g.attempt").alias("attempt"),
        F.col("g.status_code").alias("status_code"),
        F.round(F.col("g.elapsed_sec"), 3).alias("elapsed_sec"),
        F.when(F.col("g").isNull(), F.coalesce("last_error", F.lit("Unknown error"))).alias("error"),
        F.least(F.col("attempts"), F.lit(retries)).cast("bigint").alias("attempts_made"),
    )


def fetch_table(pages: DataFrame) -> DataFrame:
    """What the crawl needs from stored fetches, and nothing more: per requested URL the outcome,
    the reason, and for ok pages the internal links (document order, fragments cut). Only the link
    section is parsed."""
    from pagelens.operators.links import anchors, page_links
    from pagelens.operators.parse import parsed
    from pagelens.sources.pages import classify

    p = classify(pages)
    ok = F.col("outcome") == "ok"
    p = p.withColumn("_html", F.when(ok, F.col("html")).otherwise(F.lit("")))
    ctx = parsed(p, "_html")
    internal = F.filter(page_links(anchors()), lambda x: x["internal"])
    return ctx.select("page_id", "url", "outcome", F.col("outcome_reason").alias("reason"),
                      F.when(ok, F.transform(internal, lambda x: cut_fragment(x["url"]))).alias("internal"))


def edges_from_fetches(fetches: DataFrame) -> DataFrame:
    """(src, rank, dst) from ``fetch_table`` output."""
    return exploded(fetches.filter(F.col("outcome") == "ok"), [F.col("url").alias("src")], F.col("internal"), "rank", "dst")
