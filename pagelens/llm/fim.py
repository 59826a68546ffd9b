"""Operator 12, fill-in-middle: a Fenwick tree over fixed text blocks finds the cuts.

A text is split into blocks of ``BLOCK`` bytes of its UTF-8 form. For each block the tree holds how many
units (``[A-Za-z]+`` or one other character) and how many code points start in it. The place after k
units is the start of unit k: a binary-lifting descent gives the block that holds it together with the
code points before that block, and only that block is looked at to find the place inside. Cuts come back
as three numbers a row; the text itself never returns from Python: the training text is put together
from them by built-in functions, in the row, so there is no exchange at all.

Memory is the text's own bytes and the masks of one slab of blocks. Reruns give the same rows: cuts and
forms come from the digest of seed and id.

Defined cases: a null text is empty; empty texts, and texts that hold a control string, stay as they
are (form ``plain``, no cuts); a null id counts as an empty one; rows of one id with different texts
draw the same numbers, repeated rows are each returned; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import prepare, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block, and blocks counted at once.
BLOCK, SLAB = 512, 2048


class Fenwick:
    """Prefix sums of units and code points over blocks."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        self.n = len(units)
        self.tree = np.zeros((2, self.n + 1), np.int64)
        self.tree[0, 1:], self.tree[1, 1:] = units, points
        step = 1
        while step < self.n:  # node i takes in its child i - step, all nodes of a level at once
            at = np.arange(2 * step, self.n + 1, 2 * step)
            self.tree[:, at] += self.tree[:, at - step]
            step *= 2
        self.top = 1 << max(self.n.bit_length() - 1, 0)

    def descend(self, k: int) -> tuple[int, int, int]:
        """The block in which unit k (from 0) starts, with the units and code points before the block."""
        at = units = points = 0
        step = self.top
        while step:
            if at + step <= self.n and units + self.tree[0, at + step] <= k:
                at += step
                units += int(self.tree[0, at])
                points += int(self.tree[1, at])
            step >>= 1
        return at, units, points


def _starts(raw: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Where units and code points start among the bytes lo..hi."""
    part = raw[max(lo - 1, 0):hi]
    letter = ((part | 0x20) - 97) < 26
    point = (part & 0xC0) != 0x80
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return (unit[1:], point[1:]) if lo else (unit, point)


def cuts(raw: np.ndarray, h1: int, h2: int, block: int = BLOCK) -> tuple[int, int, int]:
    """Number of units, and the code points before the first and before the second cut."""
    units, points = [], []
    for lo in range(0, len(raw), block * SLAB):
        hi = min(lo + block * SLAB, len(raw))
        edges = np.arange(0, hi - lo, block)
        for out, mask in zip((units, points), _starts(raw, lo, hi)):
            out.append(np.add.reduceat(mask, edges, dtype=np.int64))
    if not units:
        return 0, 0, 0
    units, points = np.concatenate(units), np.concatenate(points)
    n, total = int(units.sum()), int(points.sum())
    tree = Fenwick(units, points)

    def place(k: int) -> int:
        if k >= n:
            return total
        at, before, chars = tree.descend(k)
        unit, point = _starts(raw, at * block, min((at + 1) * block, len(raw)))
        here = np.flatnonzero(unit)[k - before]
        return chars + int(np.count_nonzero(point[:here]))

    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, place(a), place(b)


def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    rows = [cuts(np.frombuffer(t.as_buffer(), np.uint8), x, y) for t, x, y in zip(text, h1.to_pylist(), h2.to_pylist())]
    cols = np.array(rows, np.int64).reshape(-1, 3)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(cols[:, k])) for k in range(3)], ["n", "a", "b"])


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, fim_text.

    Of 100 documents, those whose third draw is ``plain_from`` or more stay as they are; of the others,
    those whose fourth is under ``spm_below`` put the suffix first."""
    prepare(docs.sparkSession)
    text = F.col("text")
    d = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text"))
    d = d.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256))
    find = F.arrow_udf(_cuts, "struct<n:bigint,a:bigint,b:bigint>")
    d = d.withColumn("cut", find("text", _draw(F.col("digest"), 1), _draw(F.col("digest"), 2)))
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | held | (_draw(F.col("digest"), 3) % 100 >= plain_from), "plain").when(_draw(F.col("digest"), 4) % 100 < spm_below, "spm").otherwise("psm")
    a, b = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substr(text, b + 1)
    d = d.withColumn("form", form)
    cut = F.col("form") != "plain"
    return d.select(
        F.col("id").alias(id_col), F.col("cut.n").alias("n"), "form",
        F.when(cut, F.col("cut.a")).alias("prefix_chars"), F.when(cut, F.col("cut.b") - F.col("cut.a")).alias("middle_chars"),
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(text).alias("fim_text"))


def restored(fim_text: Column, form: Column) -> Column:
    """The text a training text was made from. No part holds a control string, so each is read up to the next one."""
    def parts(first: str, second: str):
        one = F.substr(fim_text, F.lit(len(first) + 1))
        x = F.substring_index(one, second, 1)
        two = F.substr(one, F.char_length(x) + len(second) + 1)
        y = F.substring_index(two, MIDDLE, 1)
        return x, y, F.substr(two, F.char_length(y) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_1, prefix_1, middle_1 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_1, middle_1, suffix_1)).otherwise(fim_text)
