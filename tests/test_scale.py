"""Results that must not depend on partitions, folders or quoting."""

import pytest
from pyspark.sql import functions as F

from pagelens.plans import sinks
from pagelens.plans.report import global_rank
from pagelens.session import checkpoint_dir, scratch_path


def test_global_rank_numbers_every_row(spark):
    """Wide rows over many partitions, with adaptive coalescing on."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = 400_000
        wide = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit("x" * 270)).alias("pad"))
        got = global_rank(wide, "k", "r")
        row = got.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("r") != F.col("k") + 1).cast("int")).alias("wrong")).first()
        assert (row["n"], row["wrong"]) == (n, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_csv_doubles_quotes(spark):
    cols = ", ".join(f"'{c}' as {c}" for c in sinks.CSV_FIELDS if c != "title")
    path = scratch_path(spark, "csv-quotes")
    df = spark.sql(f"select {cols}").withColumn("title", F.lit('He said "hi", ok')).select(*sinks.CSV_FIELDS)
    original, sinks.flatten_csv = sinks.flatten_csv, lambda r: r
    try:
        sinks.write_csv(df, path)
    finally:
        sinks.flatten_csv = original
    lines = [r.value for r in spark.read.text(path).collect()]
    assert any('"He said ""hi"", ok"' in x for x in lines)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.first()["title"] == 'He said "hi", ok'


def test_checkpoint_folder_must_be_shared():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
