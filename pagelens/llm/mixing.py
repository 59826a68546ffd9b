"""Operator 4, mixing sources to target weights: Pareto order sampling. DataFrame functions only.

Each source has a target number of words. With ``m`` the target over the source's words, every
document is taken ``floor(m)`` times for certain, and the remaining words R are filled by a fixed-size
sample with unequal probabilities. A document's inclusion probability is lambda = min(1, c * x), where x
is the square root of its size class (the size with all but its five highest bits cleared, so a source
has some hundreds of classes) and c is such that the words expected, the sum of lambda * size, are R.
Documents with lambda 1 are certain and come first; the others are ranked by random odds u/(1-u) over
inclusion odds lambda/(1-lambda) and taken in that order until R words are reached (the last one where
it comes nearer).

No source is sorted as a whole. The rank's place in (0, 1) is cut into ``SLOTS`` slots, whose words
are summed per source; only the slot in which the source's size is reached is cut again into as many,
and only the rows of that second slot are put in order. Random numbers are digests of seed and id, so
reruns and retried tasks agree; rows without an id of their own (null, or the id of another row too) draw
by their row number, which is stored with the sizes before anything is drawn.

Defined cases: null text has size 0; null sources are a source of their own, ordered last; documents
without words are taken ``floor(m)`` times or once more, at 0 words; rows with null or repeated ids are
rows of their own with draws of their own (by ``row_col`` if it is given); an empty table gives no rows; a
mix without words has targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.llm.common import WORD, maybe_among, prepare, written

SLOTS = 4096
SALTS = 16
MAX_REPEAT = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cycled_weights(by_source: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: the given weights, repeating over the sources in code point order, null last."""
    place = F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())) - 1
    return by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1))


def targets(by_source: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to one row per source (src, words, weight).

    Shares of all words by weight; a source stops at ``max_repeat`` times its words and its excess is
    reshared by weight. The sources that stop are those with the least words per weight, so the
    windows run over the sources in that order (one row per source, already summed).
    """
    cap = F.col("words") * F.lit(float(max_repeat))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    x = by_source.withColumn("cap", cap)
    x = x.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(rest))
    x = x.withColumn("all_words", F.sum("words").over(W.partitionBy(F.lit(1))))
    x = x.withColumn("level", (F.col("all_words") - F.col("capped_before")) / F.col("weight_left"))
    # the first source in the order whose share at its level is not above its cap fixes the level
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    x = x.withColumn("fixed", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("src").isNull(), F.col("src")))).over(W.partitionBy(F.lit(1))))
    return x.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap")))).select("src", "words", "weight", "target")


def random_unit(seed: int, key: Column) -> Column:
    """A number in (0, 1) from the digest of seed and key (52 bits)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def _own_ids(rows: DataFrame) -> DataFrame:
    """Adds ``own``: whether the row's id is no other row's. Ids are counted, never grouped as rows; the rows whose id
    may be repeated are dealt over ``SALTS`` parts, so one id on many rows is not one task's."""
    again = written(rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select(F.col("id").alias("again")), "mix-again")
    marked = maybe_among(rows, "id", again)
    salts = again.select("again", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    maybe = marked.filter("__maybe").join(salts, (F.col("id") == F.col("again")) & (F.pmod(F.col("row"), F.lit(SALTS)) == F.col("salt")), "left")
    sure = marked.filter("NOT __maybe").select(*rows.columns, F.col("id").isNotNull().alias("own"))
    return sure.unionByName(maybe.select(*rows.columns, (F.col("id").isNotNull() & F.col("again").isNull()).alias("own")))


def size_class(size: Column) -> Column:
    """The size plus one with all but its five highest bits cleared."""
    n = size + 1
    low = F.greatest(F.length(F.bin(n)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, low), low)


def factors(classes: DataFrame) -> DataFrame:
    """The factor c of each source: src, c. ``classes`` has src, class, words and left, one row a class of a source.

    The largest classes are certain as long as c * x would be above 1; the windows run over the classes of a
    source from the largest (some hundreds of rows).
    """
    order = W.partitionBy("src").orderBy(F.col("class").desc())
    x = classes.withColumn("x", F.sqrt(F.col("class").cast("double")))
    x = x.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("rest", F.sum(F.col("x") * F.col("words")).over(order.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("level", F.when(F.col("rest") > 0, (F.col("left") - F.col("before")) / F.col("rest")))
    fits = F.col("level") * F.col("x") <= 1
    return x.groupBy("src").agg(F.max_by(F.when(fits, F.col("level")), F.when(fits, F.col("class"))).alias("c"))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: int = MAX_REPEAT, seed: int = 17, row_col: str | None = None) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words), copies, inclusion (the probability of a copy more than
    the certain ones), and ``row_col``, a distinct number of each row, if given."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), n_words(F.col(text_col)).alias("size"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).cast("bigint").alias("row"))
    rows = written(rows, "mix-sizes")
    by_source = rows.groupBy("src").agg(F.sum("size").alias("words"))
    plan = targets(cycled_weights(by_source, weights), max_repeat)
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("bigint")
    plan = plan.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("words"))
    plan = written(plan.select("src", "words", "target", "whole", "left"), "mix-plan")  # one row per source

    classes = rows.groupBy("src", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    classes = classes.join(plan.select(F.col("src").alias("s"), "left"), F.col("src").eqNullSafe(F.col("s"))).select("src", "class", "words", "left")
    c = written(factors(classes), "mix-factors").select(F.col("src").alias("s"), "c")  # one row per source
    u = random_unit(seed, F.when(F.col("own"), F.col("id").cast("string")).otherwise(F.concat(F.lit("row "), F.col("row").cast("string"))))
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("c"), F.lit(0.0)) * F.sqrt(size_class(F.col("size")).cast("double"))))
    drawn = _own_ids(rows).join(c, F.col("src").eqNullSafe(F.col("s"))).select("id", "src", "size", "row", chance.alias("chance"), u.alias("u"))
    # the rank r = u/(1-u) over lambda/(1-lambda) is mapped to (0, 1) by r / (1 + r), which keeps the order; certain ones are at 0
    place = F.col("u") * (1 - F.col("chance")) / (F.col("u") * (1 - F.col("chance")) + (1 - F.col("u")) * F.col("chance"))
    rows = written(drawn.select("id", "src", "size", "row", "chance", place.alias("place")), "mix-places")

    slot = lambda level: F.floor(F.col("place") * (SLOTS ** level)).cast("bigint")
    first = _cut(rows.groupBy("src", slot(1).alias("slot")).agg(F.sum("size").alias("sum")), plan.select("src", "left"))
    in_first = rows.join(first, [rows["src"].eqNullSafe(first["s"]), slot(1) == first["cut"]]).select(
        rows["id"], rows["src"], "size", "place", "row", "before", "left")
    second = _cut(in_first.groupBy("src", slot(2).alias("slot")).agg(F.sum("size").alias("sum")),
                  in_first.groupBy("src").agg(F.min("left").alias("left"), F.min("before").alias("base")))
    in_second = in_first.join(second.select("s", "cut", F.col("before").alias("base")), [in_first["src"].eqNullSafe(F.col("s")), slot(2) == F.col("cut")])
    order = W.partitionBy("src").orderBy("place", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    edge = in_second.withColumn("ahead", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # the place up to which documents are taken; ties of place follow in size and row
    last = edge.filter(F.col("ahead") + F.col("size") / 2 <= F.col("left")).groupBy("src").agg(F.max(F.struct("place", "size", "row")).alias("last"))
    edges = plan.join(first.select("s", "cut"), plan["src"].eqNullSafe(F.col("s")), "left").drop("s")
    edges = edges.join(second.select(F.col("s"), F.col("cut").alias("cut2")), edges["src"].eqNullSafe(F.col("s")), "left").drop("s")
    edges = edges.join(last.select(F.col("src").alias("s"), "last"), edges["src"].eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("src", "s")
    edges = written(edges, "mix-edges")  # one row per source; small enough or not, the planner then knows its size
    r = rows.join(edges, rows["src"].eqNullSafe(edges["s"]))
    more = (F.when(F.col("left") <= 0, F.lit(False))
            .when(F.col("cut").isNull(), F.lit(True))  # the source ends before its size is reached
            .when(slot(1) != F.col("cut"), slot(1) < F.col("cut"))
            .when(F.col("cut2").isNull(), F.lit(True))
            .when(slot(2) != F.col("cut2"), slot(2) < F.col("cut2"))
            .otherwise(F.coalesce(F.struct("place", "size", "row") <= F.col("last"), F.lit(False))))
    copies = F.col("whole") + more.cast("bigint")
    return r.select(F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("chance").alias("inclusion"),
                    *([F.col("row").alias(row_col)] if row_col else []))


def _cut(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """The slot of each source in which its size ``left`` is reached: s, cut, before (words ahead of the slot), left.

    ``sums`` has at most SLOTS rows a source; ``sizes`` may bring ``base``, the words ahead of all slots.
    """
    base = F.col("base") if "base" in sizes.columns else F.lit(0).cast("bigint")
    sizes = sizes.select(F.col("src").alias("s"), "left", base.alias("base"))
    x = sums.join(sizes, sums["src"].eqNullSafe(sizes["s"])).filter(F.col("left") > 0)
    upto = F.sum("sum").over(W.partitionBy("s").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)) + F.col("base")
    x = x.withColumn("upto", upto).filter(F.col("upto") > F.col("left"))
    return x.groupBy("s").agg(F.min("slot").alias("cut"), F.min_by(F.col("upto") - F.col("sum"), "slot").alias("before"), F.min("left").alias("left"))
