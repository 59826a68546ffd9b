"""The training-data pipeline: quality rules, exact dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Decisions and copies hold for single rows: a stage stores its input with a row number, which is the key
the operators see, so null and repeated ids are rows of their own. A decision goes back to its rows by a
bitmap of fixed size over the rows it changes; only those (and the bitmap's few false hits) are joined, so
the texts that simply stay are never moved. What a stage stored for itself is dropped when the next
one starts, as its result is then written; so a stage's DataFrame is to be written before the next stage
is called.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import drop_stored, maybe_among, prepare, stored, written
from pagelens.llm.exact_dedup import exact_dedup
from pagelens.llm.mixing import pareto_mix
from pagelens.llm.ngram_join import near_duplicates
from pagelens.llm.packing import pack
from pagelens.llm.quality import quality_rules
from pagelens.session import scratch_path, table_path


#: What the last stage that ran has stored.
_last: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_stored(spark, [p for p in _last if p in stored])
        _last.clear()
        prepare(spark)
        before = len(stored)
        out = f(spark, docs, sf_dir)
        _last.extend(stored[before:])
        return out

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a stored row number, ``__row``."""
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), "stage-rows")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The numbered documents whose row is not among ``gone`` (__row, distinct), without the number."""
    gone = written(gone.select(F.col("__row").alias("__gone")), "stage-gone")
    marked = maybe_among(rows, "__row", gone)
    stay = marked.filter(~F.col("__maybe"))
    rest = marked.filter("__maybe").join(gone, F.col("__row") == F.col("__gone"), "left_anti")
    return stay.unionByName(rest).drop("__row", "__maybe")


def _owners(rows: DataFrame, groups: DataFrame, keep: str) -> DataFrame:
    """The row of each group (__row, group) with the smallest or largest id, null ids last; of equal ids one row."""
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row") if keep == "min" else F.struct("doc_id", "__row")
    named = groups.join(rows.select("__row", "doc_id"), "__row")
    return named.groupBy("group").agg((F.min(one) if keep == "min" else F.max(one)).alias("own")).select("own.__row")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """6: documents that the quality rules reject go."""
    rows = _numbered(docs)
    return _without(rows, quality_rules(rows, id_col="__row").filter("NOT kept"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """10: of equal texts, the document with the largest id stays."""
    rows = _numbered(docs)
    groups = exact_dedup(rows, keep="max", id_col="__row").select("__row", F.col("keep_id").alias("group"))
    return _without(rows, groups.join(_owners(rows, groups, "max"), "__row", "left_anti"))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9: of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more, the smallest id stays."""
    rows = _numbered(docs)
    groups = near_duplicates(rows, width=5, threshold=(80, 100), id_col="__row").select("__row", F.col("component_id").alias("group"))
    return _without(rows, groups.join(_owners(rows, groups, "min"), "__row", "left_anti"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4: documents repeated or left out so that the sources' words meet their weights."""
    rows = _numbered(docs)
    copies = written(pareto_mix(rows, row_col="__row").filter("copies <> 1").select(F.col("__row").alias("__of"), F.col("copies").alias("__copies")), "stage-copies")
    marked = maybe_among(rows, "__row", copies.select("__of"))
    once = marked.filter(~F.col("__maybe")).select(*docs.columns)
    rest = marked.filter("__maybe").join(copies, F.col("__row") == F.col("__of"), "left").withColumn("__copies", F.coalesce("__copies", F.lit(1).cast("bigint"))).filter("__copies > 0")
    return once.unionByName(rest.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).select(*docs.columns))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """7: the mix in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near), ("mixing", mix), ("packing", packed)]

#: Quality estimates and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
