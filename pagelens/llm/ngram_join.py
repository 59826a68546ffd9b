"""Operator 9, n-gram Jaccard join: filters under several global orders of the tokens.

A document's set is its distinct word shingles. Two documents link when the Jaccard similarity of
their sets reaches the threshold t; the result gives the connected components.

Documents with the same set are one class, found from a digest, and one stands for it. Linked classes
of sizes n share at least ceil(t n) tokens, so under any order of all tokens the first n - ceil(t n) + k
tokens of both hold k common ones. Three orders are used:

1. by hash, with k a tenth of the set: a class stays only if enough of its first tokens occur in
   another class's. This reads a fifth of the tokens and drops most documents;
2. and 3. over the whole sets of those that stay, rare tokens first, ties broken by a second and a third
   hash, with k = 1. Tokens found in one class only come first, so a class with too many of them has
   no partner, and passages shared by many documents come last and bring no candidates.

A pair is a candidate if it shares a first token under order 2 and one under order 3; candidates are
verified on the whole sets. Hashes have 64 bits.

Hot tokens: a token among the first of more than ``COLD`` classes does not bring all pairs. The class with
the smallest share of tokens of its own, most likely what the others were copied from, is compared with
each. Groups that this does not connect are filtered again, by the tokens in which members differ from
that leader: what all have in common no longer counts, so few are left to compare, and nothing is lost.
``COLD`` grows eightfold with each such level, so their number stays small.
Tokens are counted before they are moved, and joins on tokens and classes are split by adaptive
execution.

Defined cases: texts without words or null texts have an empty set, link with nothing and are their own
component; a document with a null id links with nothing and has a null component; repeated rows are
in one class; an empty table gives no rows; other columns are ignored. Rows with one id and
different texts are linked through the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import components, maybe_among, prepare, text_of, written
from pagelens.llm.shingles import digest, shingle_sets, sliced

COLD = 32


def least_common(n, threshold: tuple[int, int]):
    """ceil(t n), for integers, arrays and columns."""
    num, den = threshold
    if isinstance(n, Column):
        return F.floor((n * num + (den - 1)) / den).cast("bigint")
    return (n * num + den - 1) // den


def overlap(n):
    """Common tokens asked for among the first under order 1."""
    return F.greatest(F.lit(1), F.floor(n / 10)).cast("bigint") if isinstance(n, Column) else max(1, n // 10)


def _signatures(width: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, digests, firsts = [], [], []
            for bodies in sliced(pdf["text"]):
                for s in shingle_sets(bodies, width):
                    n = len(s)
                    sizes.append(n)
                    digests.append(digest(s))
                    firsts.append(s[: n - least_common(n, threshold) + overlap(n)].view(np.int64) if n else None)
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "n": sizes, "digest": digests, "first": firsts})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [s.view(np.int64) for bodies in sliced(pdf["text"]) for s in shingle_sets(bodies, width)]
            yield pd.DataFrame({"c": pdf["id"], "tokens": sets})

    return run


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Rows (c, t) -> c, hits: the tokens found in two classes or more, with the number of classes."""
    count = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return tokens.join(count, "t").groupBy("c").agg(F.collect_list(F.struct("df", "t")).alias("hits"))


def near_duplicates(docs: DataFrame, width: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id", text_col: str = "text",
                    cold: int = COLD) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(F.col(text_col)).alias("text"))
    signed = written(rows.mapInPandas(_signatures(width, threshold), "id bigint, n bigint, digest binary, first array<bigint>"), "ngram-signed")
    usable = signed.filter("n > 0 AND id IS NOT NULL")
    classes = written(usable.groupBy("digest", "n").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("copies")), "ngram-classes")

    # order 1. Most documents are the only one of their class, which the bitmap tells; the others are looked up
    stand = classes.select(F.col("digest").alias("d"), "c")
    others = usable.select("id", "digest").join(classes.filter("copies > 1").select("digest", "c"), "digest").filter("id <> c").select("id")
    marked = maybe_among(usable, "id", others)
    looked_up = marked.filter("__maybe").join(stand, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("c")), "left_semi")
    firsts = marked.filter("NOT __maybe").select("id", "first").union(looked_up.select("id", "first")).select(F.col("id").alias("c"), F.explode("first").alias("t"))
    size = classes.select("c", "n")
    asked = overlap(least_common(F.col("n"), threshold))
    stay = shared_tokens(firsts).select("c", F.size("hits").alias("found")).join(size, "c").filter(F.col("found") >= asked).select("c", "n")
    stay = written(stay, "ngram-stay")

    # orders 2 and 3, over whole sets
    again = maybe_among(rows.filter("id IS NOT NULL"), "id", stay.select("c")).filter("__maybe").select("id", "text")
    again = again.join(stay.select(F.col("c").alias("id")).distinct(), "id", "left_semi")
    sets = written(again.mapInPandas(_sets(width), "c bigint, tokens array<bigint>").withColumn("n", F.size("tokens").cast("bigint")).filter("n > 0"), "ngram-sets")
    hits = shared_tokens(sets.select("c", F.explode("tokens").alias("t"))).join(sets.select("c", "n"), "c")
    keep = (F.size("hits") - least_common(F.col("n"), threshold) + 1).cast("int")
    hits = hits.withColumn("keep", keep).filter("keep > 0")
    def first(seed: int) -> Column:
        order = F.sort_array(F.transform("hits", lambda x: F.struct(x["df"].alias("df"), F.xxhash64(x["t"], F.lit(seed)).alias("h"), x["t"].alias("t"))))
        return F.transform(F.slice(order, F.lit(1), F.col("keep")), lambda x: x["t"])

    filters = written(hits.select("c", "n", (F.col("n") - F.size("hits")).alias("alone"), first(2).alias("second"), first(3).alias("third")), "ngram-filters")
    roots = _linked(filters, sets, threshold, cold)
    class_root = classes.select(F.col("digest").alias("d"), "c").join(roots, F.col("c") == F.col("node"), "left").select("d", F.coalesce("root", "c").alias("root"))
    out = signed.select("id", "n", "digest").join(class_root, (F.col("digest") == F.col("d")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def _linked(filters: DataFrame, sets: DataFrame, threshold: tuple[int, int], cold: int) -> DataFrame:
    """node, root of the classes that have links."""
    near_size = lambda a, b: F.least(a, b) >= least_common(F.greatest(a, b), threshold)
    # groups of classes that may link: first by the first tokens of order 2
    groups = filters.select(F.posexplode("second").alias("pos", "g"), "c", "n", "alone").select(
        "g", "c", "n", F.col("c").alias("root"), F.col("n").alias("size"), (F.col("alone") + F.col("pos")).alias("pos"), (F.col("alone") / F.col("n")).alias("own"))
    num, den = threshold

    def may(x: Column, y: Column) -> Column:
        """Whether a pair can link whose first common token is the group's: what follows it, itself included, holds the common tokens the pair needs."""
        differ = F.floor((x["n"] + y["n"]) * (den - num) / (den + num))
        rest = F.least(x["size"] - x["pos"], y["size"] - y["pos"])
        return (x["root"] != y["root"]) & near_size(x["n"], y["n"]) & (2 * rest >= x["size"] + y["size"] - differ)

    roots, level = None, 0
    while True:
        lead = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("own", "c", "n")).alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        lead = written(lead.filter("lo <> hi").select("g", "m", "lead"), f"ngram-groups{level}")
        few = groups.join(lead.filter(F.col("m") <= cold).select("g"), "g").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("c", "n", "root", "size", "pos"))).alias("l"))
        each = F.flatten(F.transform("l", lambda x: F.transform(
            F.filter("l", lambda y: (y["c"] > x["c"]) & may(x, y)), lambda y: F.struct(x["c"].alias("a"), y["c"].alias("b")))))
        pairs = few.select(F.explode(each).alias("p")).select("p.a", "p.b")
        hot = lead.filter(F.col("m") > cold).select("g", F.col("lead.c").alias("lead"), F.col("lead.n").alias("lead_n"))
        member = written(groups.select("g", "c", "n").join(hot, "g").filter("c <> lead"), f"ngram-hot{level}")
        star = member.filter(near_size(F.col("n"), F.col("lead_n"))).select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b"))
        found = written(_verified(pairs.union(star).distinct(), filters, sets, threshold), f"ngram-links{level}")
        roots = components(found, f"ngram-components{level}") if roots is None else _joined(roots, found, level)
        # hot groups that are not connected yet: their members against each other, told apart by what
        # each has other than its leader
        to = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
        member = member.join(to("c"), "c", "left").join(to("lead"), "lead", "left")
        root, lead_root = F.coalesce("c_root", "c"), F.coalesce("lead_root", "lead")
        is_open = member.groupBy("g").agg(F.min(root).alias("lo"), F.max(root).alias("hi"), F.min(lead_root).alias("of_lead")).filter("lo <> hi OR lo <> of_lead").select("g")
        pending = member.join(is_open, "g").select("lead", "c", "n", root.alias("root")).distinct()
        pending = written(pending, f"ngram-open{level}")
        if pending.isEmpty():
            return roots
        groups = _rebased(pending, sets, threshold, level)
        level, cold = level + 1, cold * 8


def _joined(roots: DataFrame, links: DataFrame, level: int) -> DataFrame:
    """``roots`` (node, root) after more links."""
    to = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    edges = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b")
    edges = written(edges.distinct(), f"ngram-joins{level}")
    if edges.isEmpty():
        return roots
    more = components(edges, f"ngram-components{level}")
    up = more.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
    moved = roots.join(up, F.col("root") == F.col("up"), "left").select("node", F.coalesce("up_root", "root").alias("root"))
    return written(moved.union(more.join(roots.select("node"), "node", "left_anti")), f"ngram-roots{level}")


def _rebased(members: DataFrame, sets: DataFrame, threshold: tuple[int, int], level: int) -> DataFrame:
    """Groups (g, c, n, root, size, pos, own) such that members (lead, c, n, root) of one lead that may link and are not connected share one.

    With D the tokens found in just one of a set and its leader's, two linked sets differ in
    |Dx| + |Dy| - 2 |Dx and Dy| tokens, at most n (1 - t) / t for the smaller n. So Dx and Dy share at
    least |Dx| - n (1 - t) / t tokens; and at least one, as a pair without any would both link with the
    leader. That is the same prefix filter again, on far smaller sets: rare tokens first, those of one
    member only leading. A leader is in none of its groups, so groups shrink from level to level.
    """
    num, den = threshold
    whole = lambda k: sets.select(F.col("c").alias(k), F.col("tokens").alias(f"set_{k}"))
    d = members.join(whole("c"), "c").join(whole("lead"), "lead")
    d = d.withColumn("d", F.concat(F.array_except("set_c", "set_lead"), F.array_except("set_lead", "set_c")))
    d = written(d.select(F.struct("lead", "c").alias("c"), "n", "root", "d", F.size("d").cast("bigint").alias("own")), f"ngram-differ{level}")
    token = d.select("c", F.explode("d").alias("e")).select("c", F.xxhash64("c.lead", "e").alias("t"))
    hits = shared_tokens(token).join(d.select("c", "n", "root", "own"), "c")
    asked = F.greatest(F.lit(1), F.col("own") - F.floor(F.col("n") * (den - num) / num))
    hits = hits.withColumn("keep", (F.size("hits") - asked + 1).cast("int")).filter("keep > 0")
    first = F.transform(F.slice(F.sort_array("hits"), F.lit(1), F.col("keep")), lambda x: x["t"])
    listed = hits.select(F.posexplode(first).alias("pos", "g"), F.col("c.c").alias("c"), "n", "root", "own", (F.col("own") - F.size("hits")).alias("alone"))
    return written(listed.select("g", "c", "n", "root", F.col("own").alias("size"), (F.col("alone") + F.col("pos")).alias("pos"), "own"), f"ngram-rebased{level}")


def _verified(pairs: DataFrame, filters: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) from order 2, those that also share a first token under order 3 and whose sets reach the threshold."""
    num, den = threshold
    third = lambda k: filters.select(F.col("c").alias(k), F.col("third").alias(f"third_{k}"))
    whole = lambda k: sets.select(F.col("c").alias(k), F.col("tokens").alias(f"set_{k}"))
    pairs = pairs.join(third("a"), "a").join(third("b"), "b").filter(F.arrays_overlap("third_a", "third_b")).select("a", "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    pairs = pairs.join(whole("a"), "a").join(whole("b"), "b")
    return pairs.filter(both * den >= (F.size("set_a") + F.size("set_b") - both) * num).select("a", "b").distinct()
