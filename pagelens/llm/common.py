"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.session import checkpoint_dir, scratch_path

#: A word is a run of characters other than space and tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows handed to Python at once: small enough that a batch of very long texts fits a worker.
BATCH_ROWS = "400"
#: Rows a Parquet reader decodes at once: with whole texts, Spark's 4096 are arrays of many MB in each task.
DECODED_ROWS = "512"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on (idempotent)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", DECODED_ROWS)
    # reading ranges side by side keeps off-heap copies of whole column chunks, for each thread that ever read one
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")
    checkpoint_dir(spark)
    return spark


#: Tables that ``written`` has stored and nobody has dropped, oldest first.
stored: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that ``written`` stored; only for what no DataFrame still in use is built on."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        stored.remove(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character untouched; null stays null."""
    return F.translate(text, UPPER, LOWER)


def text_of(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: Elements that ``before_each`` folds in one block, and code points in a piece of ``pieces``.
BLOCK, PIECE = 64, 512


def before_each(values: Column, merge, zero: Column, levels: int = 2) -> Column:
    """For each element of an array ``merge`` over all elements before it (``zero`` for the first).

    Blocks are folded one by one and the blocks' totals the same way, so that the work grows with the
    array and no array is copied element by element, as appending to one would.
    """
    inside = lambda xs: F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, 1, i), zero, merge))
    if levels == 0:
        return inside(values)
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    return let(blocks, lambda bs: let(before_each(F.transform(bs, lambda b: F.aggregate(b, zero, merge)), merge, zero, levels - 1), lambda before: F.flatten(
        F.transform(bs, lambda b, k: F.transform(inside(b), lambda x: merge(before[k], x))))))


def sums_before(lengths: Column) -> Column:
    """Sum of the elements before each one."""
    return before_each(lengths, lambda a, b: a + b, F.lit(0))


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, to ``cut`` from without counting from its start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text given as its ``pieces``."""
    first = (start / PIECE).cast("int")
    last = ((end - 1) / PIECE).cast("int")
    return F.when(end > start, F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "").substr(start - first * PIECE + 1, end - start)).otherwise("")


#: Bits of the map in ``maybe_among``: 512 rows of 4 KB, 2 MB whatever the number of ids.
MAP_BITS, MAP_ROW = 1 << 24, 1 << 15


def maybe_among(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Adds ``__maybe``: false only if the row's id is surely not among ``ids`` (one column).

    The ids are hashed into a bitmap of fixed size, which alone is broadcast; where they fill it, more
    rows are true and the exact join that follows moves more, with the same result.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS)).cast("bigint")
    key = ids.select(place(F.col(ids.columns[0]).cast("bigint")).alias("p"))
    bits = key.groupBy(F.floor(F.col("p") / MAP_ROW).cast("bigint").alias("__map_row")).agg(F.bitmap_construct_agg(F.col("p") % MAP_ROW).alias("__bits"))
    bits = F.broadcast(written(bits, "id-bitmap"))
    p = place(F.col(id_col).cast("bigint"))
    out = df.withColumn("__p", p).join(bits, F.floor(F.col("__p") / MAP_ROW).cast("bigint") == F.col("__map_row"), "left")
    at = F.col("__p") % MAP_ROW
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, (at % 8).cast("int")) == 1
    return out.withColumn("__maybe", F.coalesce(bit, F.lit(False))).drop("__p", "__map_row", "__bits")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): node, root (the smallest node reachable), for every node that has an edge.

    Each round every node points to its smallest neighbour, pointers are shortened, and the edges are
    contracted to what their ends point to, until none is left. Nodes are never gathered: a hub's edges
    are summed to a minimum before they are moved.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    roots = None
    while not edges.isEmpty():
        to = both(edges).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        for _ in range(2):
            up = to.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
            to = written(to.join(up, F.col("root") == F.col("up"), "left").select("node", F.coalesce("up_root", "root").alias("root")), f"{name}-to")
        if roots is None:
            roots = to
        else:
            up = to.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
            roots = written(roots.join(up, F.col("root") == F.col("up"), "left").select("node", F.coalesce("up_root", "root").alias("root")), f"{name}-roots")
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
