"""Operator 5, token counts: a digest cache.

Counts are stored under the digest of the normalised content (null as empty text; nothing else, as the
counts must be the library's for the text as it stands) and the digest of the tokenizer file. Documents
are joined to the cache; of the misses, each distinct digest is encoded once, and its count is
appended to the cache. Which rows the cache surely has, and which may have
a digest that other rows have too, is told by bitmaps of fixed size: the first are passed over, the others
keep one text a digest in each part before the texts of a digest meet, so a group with a third of all
rows moves one text a part, and all remaining texts are encoded where they are read. Ids play no role.

Defined cases: rows with null or repeated ids are rows of their own; a null or empty text has 0 bytes and the library's count for ''; repeated rows are
each returned; an empty table gives no rows; other columns are ignored. A cache folder that does not
exist yet is empty. Rows appended twice by a repeated run are read as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import maybe_among, prepare, text_of, written

CACHE = "tokenizer string, digest string, n_tokens bigint"


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a .json (tokenizers) or .model (sentencepiece) file as texts -> lists of ids."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def version(path: str) -> str:
    """Digest of the tokenizer file: another file is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load(path)
        for pdf in batches:
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": [len(x) for x in encode(pdf["text"].tolist())]})

    return run


def read_cache(spark, cache: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. Counts of new texts are appended to ``cache``."""
    spark = prepare(docs.sparkSession)
    tag = version(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    keys = written(rows.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "token-keys")
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == tag).select("digest").distinct()
    miss = written(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).join(stored, "digest", "left_anti"), "token-miss")
    short = lambda: F.xxhash64("digest").alias("key")
    texts = rows.select("text", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).withColumn("key", short())
    # texts that the cache surely has go where they are read; of the rest, those met once are encoded there
    texts = maybe_among(texts, "key", miss.select(short())).filter("__maybe").drop("__maybe")
    marked = maybe_among(texts, "key", miss.filter("rows > 1").select(short()))
    once = marked.filter("NOT __maybe").select("digest", "text")
    several = marked.filter("__maybe").select("digest", "text").dropDuplicates(["digest"])
    encode = _count(tokenizer_path)
    fresh = once.mapInPandas(encode, "digest string, n_tokens bigint").unionByName(several.mapInPandas(encode, "digest string, n_tokens bigint"))
    fresh = fresh.join(miss.select("digest"), "digest", "left_semi")  # the bitmap lets a few through that the cache has
    fresh.select(F.lit(tag).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
