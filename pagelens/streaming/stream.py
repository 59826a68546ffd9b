"""Structured Streaming forms of the page analyses.

Pages arriving as parquet files get the same row-local sections as the batch report — text
statistics, paragraph count, contacts and technologies — with no shuffle and no state. Sections of elements (forms, tables, links) and the
running totals go through ``foreachBatch``: each batch writes a folder of its own number, so a batch
that is run again replaces what it wrote. The
visited-set de-duplication keeps the first arrival of each fragment-less URL: exactly (state holds
every URL) or bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions.urls import cut_fragment
from pagelens.operators import audit, blocks, links, media, text
from pagelens.operators.parse import parsed
from pagelens.sources.pages import with_envelope

PAGE_SCHEMA = "page_id bigint, url string, html string"


def row_local_sections(pages: DataFrame) -> DataFrame:
    """Per-page sections that need nothing beyond the row (usable on a stream)."""
    ctx = parsed(pages)
    headers = F.create_map().cast("map<string,string>")
    return ctx.select(
        "page_id", "url",
        text.text_stats().alias("text_stats"),
        text.emails().alias("emails"),
        text.phones().alias("phones"),
        audit.technologies(F.col("html"), headers).alias("technologies"),
    )


def flat_sections(df: DataFrame) -> DataFrame:
    return df.select(
        "page_id", "url",
        F.col("text_stats.word_count").alias("word_count"),
        F.col("text_stats.character_count").alias("character_count"),
        F.col("text_stats.paragraph_count").alias("paragraph_count"),
        F.array_join("emails", " ").alias("emails"),
        F.array_join("phones", " ").alias("phones"),
        F.array_join("technologies", "; ").alias("technologies"),
    )


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """The page files at ``path`` (a folder, whatever its name, or one file) as a stream; nothing is copied."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return spark.readStream.schema(PAGE_SCHEMA).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(PAGE_SCHEMA).parquet(path)


def stream_report(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str) -> None:
    """Read page files as a stream, add the row-local sections, write parquet; runs every
    available file once (``availableNow``) and stops."""
    src = page_stream(spark, in_dir)
    q = (
        flat_sections(row_local_sections(src)).writeStream.format("parquet")
        .option("path", out_dir).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def element_sections(pages: DataFrame) -> DataFrame:
    """Per page: forms, tables and the link record of the report, words and images for the totals."""
    ctx = parsed(with_envelope(pages)).select("page_id", "url", "final_url", text.word_count().alias("words"), F.size(media.images()).cast("bigint").alias("images"),
                                              blocks.forms().alias("forms"), blocks.tables().alias("tables"), links.anchors().alias("_anc"))
    found = ctx.withColumn("_links", links.page_links(F.col("_anc")))
    return found.select("page_id", "url", "words", "images", "forms", "tables", links.links_section(F.col("_anc"), F.col("_links")).alias("links"))


TOTALS = ("pages", "words", "images", "internal", "external", "forms", "tables")


def stream_sections(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """S1 with element sections: every file that is there, in batches; a later call goes on where the last one stopped.

    Batch n writes ``sections/batch=n`` and its sums ``totals/batch=n``, replacing both if it is run again after
    a failure, so nothing is counted twice. Totals are summed from the sections as written: a page is parsed once."""
    src = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_batch:
        src = src.option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, no: int) -> None:
        path = f"{out_dir}/sections/batch={no}"
        found = element_sections(batch)
        found.write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.schema(found.schema).parquet(path)
        size = lambda c: F.sum(F.size(c)).cast("bigint")
        sums = [F.count(F.lit(1)), F.sum("words"), F.sum("images"), F.sum("links.internal_count"), F.sum("links.external_count"), size("forms"), size("tables")]
        done.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in zip(TOTALS, sums)]).write.mode("overwrite").parquet(f"{out_dir}/totals/batch={no}")

    src.parquet(in_dir).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """The totals after each batch: batch and the sums of all batches up to it (one small row a batch)."""
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return spark.read.parquet(f"{out_dir}/totals").select("batch", *[F.sum(c).over(upto).alias(c) for c in TOTALS])


def stream_dedup(stream: DataFrame, watermark: str | None = None, ts_col: str = "fetched_at") -> DataFrame:
    """First arrival of each fragment-less URL. Without ``watermark`` the state keeps every URL
    (exact, like the visited set); with it, state is bounded and duplicates further apart than the
    watermark are no longer recognised."""
    s = stream.withColumn("norm", cut_fragment(F.col("url")))
    if watermark is None:
        return s.dropDuplicates(["norm"])
    return s.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(["norm"])
