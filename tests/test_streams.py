"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from pagelens.functions import html as H
from pagelens.session import scratch_path, table_path
from pagelens.streaming import stream as S

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_report_equals_batch(spark):
    pages = table_path(SF, "pages")
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    S.stream_report(spark, pages, out, ck)
    batch = S.flat_sections(S.row_local_sections(H.with_entities(spark.read.parquet(pages).select("page_id", "url", "html"))))
    assert rows(spark.read.parquet(out)) == rows(batch)


def test_page_stream_reads_folders_and_single_files(spark):
    path = scratch_path(spark, "t-pages")
    df = spark.createDataFrame([(1, "u#a", "h"), (2, "u#b", None)], S.PAGE_SCHEMA)
    df.coalesce(1).write.parquet(path)
    for at in (path, table_path(SF, "pages")):
        out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
        S.page_stream(spark, at).select("page_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.read.parquet(out)) == rows(spark.read.parquet(at).select("page_id"))


def test_folder_named_like_a_file(spark):
    path = scratch_path(spark, "t-parts") + "/pages.parquet"
    spark.createDataFrame([(k, f"u{k}#a", "h") for k in range(20)], S.PAGE_SCHEMA).repartition(4).write.parquet(path)
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    S.stream_report(spark, path, out, ck)
    assert rows(spark.read.parquet(out).select("page_id")) == [(k,) for k in range(20)]


def test_dedup_within_watermark(spark):
    path, out, ck = (scratch_path(spark, f"t-{n}") for n in ("in", "out", "ck"))
    schema = "url string, fetched_at timestamp"
    data = [("u#a", "2024-01-01 00:00:00"), ("u#b", "2024-01-01 00:05:00"), ("v", "2024-01-01 00:06:00"), ("v", "2024-01-01 00:06:00")]
    df = spark.createDataFrame(data, "url string, t string").select("url", F.to_timestamp("t").alias("fetched_at"))
    df.write.parquet(path)
    src = spark.readStream.schema(schema).parquet(path)
    S.stream_dedup(src, "10 minutes").select("norm").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out)) == [("u",), ("v",)]
