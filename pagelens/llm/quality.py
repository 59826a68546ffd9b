"""Operator 6, quality rules: robust multivariate outliers.

Base rules reject texts with too few words or mostly repeated windows. Of the others, a document is
rejected when its vector of transformed statistics is far, by Mahalanobis distance, from the centre of
its language and source. Centre and covariance are minimum-covariance-determinant estimates over all
rows: from medians and median deviations, concentration steps keep the nearest (n + p + 1) / 2 of n rows
(p statistics) and estimate again, so junk of nearly half a group does not enter; distances are scaled
by their median, which makes up for the rows left out. Statistics are kept as integers, so sums, quantiles and verdicts do not
depend on partitions, order or retries.

Estimates are made for each language and source, each language, and all rows; a document is judged by
the finest that has ``MIN_ROWS`` rows. ``FLOORS`` are the least standard deviations a statistic counts
with, so a statistic that is the same in most documents does not reject for a trifle.

A task sees single texts; what is shuffled is one row of sums per group and task, and a hot language
or source is summed before it is moved.

Defined cases: a null text has no words and fails the base rules; null languages or sources are groups
of their own; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.llm.common import prepare, text_of, written

#: Transformed statistics, in units of 1 / SCALE: mean word length, log symbols per 100 words, share of
#: letters in words, lexical diversity; and the least standard deviation each counts with.
FEATURES = ("word_len", "symbols", "letters", "diversity")
FLOORS = (0.35, 0.5, 0.06, 0.03)
SCALE = 1024
STEPS = 4
MIN_ROWS = 40
#: A clean document is beyond this quantile of the chi-square distribution once in a hundred thousand.
QUANTILE_Z = 4.2649
MIN_WORDS, MAX_REPEAT = 20, 30

SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first included.

    Exact: words are numbered, and a window is the pair of the ranks of its halves.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    half, v = window // 2, len(number)
    if v ** half < 1 << 62:
        g = a[: n - half + 1].copy()
        for k in range(1, half):
            g = g * v + a[k: n - half + 1 + k]
    else:
        g = a
        for k in range(1, half):
            g = np.unique(g[:-1] * v + a[k:], return_inverse=True)[1]
    ranks, r = np.unique(g, return_inverse=True)
    if len(ranks) == len(g):
        return 0
    m = n - window + 1
    _, inv, count = np.unique(r[:m] * len(ranks) + r[half: half + m], return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[inv] > 1)
    if not len(start):
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + window, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def statistics(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the figures for the features."""
    body = text.encode("utf-8", "surrogatepass")
    words = body.split()
    seen, dup, lines = set(), 0, 0
    for line in body.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    by = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    space = int(by[9:14].sum() + by[32])
    points = int(by[:128].sum() + by[192:].sum())
    letters = int(by[65:91].sum() + by[97:123].sum() + by[192:].sum())
    digits = int(by[48:58].sum())
    return (len(words), points - space, int(by[list(SYMBOLS)].sum()), dup, repeat_words(words), lines, letters, digits, int(by[65:91].sum()), len(set(words)))


SCHEMA = "id bigint, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, " + ", ".join(f"{c} bigint" for c in FEATURES)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        x = np.array([statistics(t) for t in pdf["text"]], dtype=np.float64).reshape(-1, 10)
        words, chars = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1)
        of = (x[:, 1] / words, np.log1p(100 * x[:, 2] / words), x[:, 6] / chars, np.log(np.maximum(x[:, 9], 1)) / np.log(np.maximum(words, 2)))
        out = pdf[["id", "lang", "source"]].astype({"id": "Int64"})
        for k, c in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
            out[c] = x[:, k].astype(np.int64)
        for c, v in zip(FEATURES, of):
            out[c] = np.rint(v * SCALE).astype(np.int64)
        yield out


def chi_square(z: float, k: int = len(FEATURES)) -> float:
    """Quantile of the chi-square distribution at the normal deviate z (Wilson and Hilferty)."""
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance, from arrays of the centre and of the inverse covariance (by rows)."""
    d = [F.col(c) / SCALE - F.col(mean)[k] for k, c in enumerate(FEATURES)]
    p = len(FEATURES)
    return sum(d[i] * d[j] * F.col(inverse)[i * p + j] for i in range(p) for j in range(p))


def binned(square: Column) -> Column:
    """Squared distances as integers on a log scale (256 to each doubling): few distinct values, so exact quantiles stay small."""
    return F.floor(F.log2(square + F.lit(2.0 ** -20)) * 256).cast("bigint")


def _estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of integer sums -> centre and inverse covariance."""
    p = len(FEATURES)
    for pdf in batches:
        means, inverses = [], []
        for r in pdf.to_dict("records"):
            n = float(r["n"])
            m = np.array([float(r[f"s{i}"]) for i in range(p)]) / n
            cov = np.array([[float(r[f"s{min(i, j)}_{max(i, j)}"]) / n for j in range(p)] for i in range(p)]) - np.outer(m, m)
            cov = cov / SCALE**2 + np.diag(np.square(FLOORS))
            means.append((m / SCALE).tolist())
            inverses.append(np.linalg.inv(cov).ravel().tolist())
        yield pd.DataFrame({"key": pdf["key"], "mean": means, "inverse": inverses})


def _sums(rows: DataFrame) -> DataFrame:
    p = range(len(FEATURES))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(FEATURES[i]).alias(f"s{i}") for i in p],
                                   *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i in p for j in p if i <= j])


def group_keys(lang: str = "lang", source: str = "source") -> Column:
    """Keys of the groups a document belongs to, the finest first."""
    return F.array(F.to_json(F.struct(F.lit(0).alias("level"), F.col(lang).alias("lang"), F.col(source).alias("source"))),
                   F.to_json(F.struct(F.lit(1).alias("level"), F.col(lang).alias("lang"))), F.lit('{"level":2}'))


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of every group: key, n, mean, inverse, scale.

    ``rows`` has lang, source and the features as integers.
    """
    keyed = rows.select(F.explode(group_keys()).alias("key"), *FEATURES)
    middle = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, 0.5).alias(f"m_{c}") for c in FEATURES])
    middle = written(middle.filter(F.col("n") >= MIN_ROWS), "mcd-medians")
    spread = keyed.join(middle, "key").groupBy("key").agg(
        F.first("n").alias("n"), *[F.first(f"m_{c}").alias(f"m_{c}") for c in FEATURES],
        *[F.percentile(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5).alias(f"d_{c}") for c in FEATURES])
    p = len(FEATURES)
    var = [F.pow(1.4826 * F.col(f"d_{c}") / SCALE, 2) + FLOORS[k] ** 2 for k, c in enumerate(FEATURES)]
    now = spread.select("key", F.array(*[F.col(f"m_{c}") / SCALE for c in FEATURES]).alias("mean"),
                        F.array(*[(1 / var[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("inverse"))
    now = written(now, "mcd-start")
    for step in range(STEPS):
        far = keyed.join(now, "key").withColumn("bin", binned(distance()))
        # few distinct bins, so the windows run over short lists whatever the size of a group
        bins = far.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        support = F.floor((F.sum("rows").over(W.partitionBy("key")) + p + 1) / 2)
        cut = written(bins.withColumn("upto", upto).withColumn("support", support).filter("upto >= support").groupBy("key").agg(F.min("bin").alias("cut")), f"mcd-cut{step}")
        near = far.join(cut, "key").filter(F.col("bin") <= F.col("cut"))
        now = written(_sums(near).mapInPandas(_estimate, "key string, mean array<double>, inverse array<double>"), f"mcd-step{step}")
    far = keyed.join(now, "key").groupBy("key").agg(F.percentile(binned(distance()), 0.5).alias("bin"))
    median = F.pow(F.lit(2.0), F.col("bin") / 256)
    return written(now.join(far.select("key", F.greatest(F.lit(1.0), median / chi_square(0.0)).alias("scale")), "key"), "mcd")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, the base statistics, base_failed, distance (squared; null where no group judges), kept."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text_of(F.col(text_col)).alias("text"))
    rows = written(rows.mapInPandas(_measure, SCHEMA), "quality-rows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    found = estimates(rows.filter(~F.col("base_failed")))
    k = group_keys()
    out = rows.withColumn("keys", k)
    for level in range(3):
        e = found.select(F.col("key").alias(f"key{level}"), F.col("mean").alias(f"mean{level}"), F.col("inverse").alias(f"inverse{level}"), F.col("scale").alias(f"scale{level}"))
        out = out.join(e, F.col("keys")[level] == F.col(f"key{level}"), "left")
    square = F.coalesce(*[F.when(F.col(f"key{n}").isNotNull(), distance(f"mean{n}", f"inverse{n}") / F.col(f"scale{n}")) for n in range(3)])
    out = out.withColumn("distance", square)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(QUANTILE_Z), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
