"""Operator 11, toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Examples are at most ``EXAMPLES`` distinct labelled texts, those with the smallest content digests. Terms are
whole words and the 4- and 5-grams of words (a mark before the first letter); of the examples' terms the
``TERMS`` that tell the labels apart best are the vocabulary, so that what most texts are made of does
not drown what the labels depend on. Document frequencies are counted over all documents.

The index holds, for every term, the examples that have it, in blocks of ``BLOCK`` examples (equal and alike
vectors lie together), and the largest weight in each block. A query adds up the block maxima of its
terms, opens blocks from the largest bound down and stops once no bound reaches the k-th similarity found:
the neighbours are those of a full comparison. Ties go to the earlier place in the index.

Neighbours vote with the square of their similarity; an isotonic map, fitted on the examples' own votes
without themselves, turns the vote into the share of toxic examples with such a vote. Texts without any
term of the vocabulary share the vote of the examples that have none.

What the driver holds is bounded by the parameters: the vocabulary, and one vector per example. Every document is
read whole; scoring is row-local against the broadcast index.

Defined cases: a null or empty text has no terms; a null id counts as an empty one and has no label; of several
labels of one id the highest counts; examples of one text count once with their mean label; without
labels every score is 0; repeated rows are each returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import prepare, written

#: Bounds of what is learned from: distinct labelled texts, and terms of the vocabulary.
EXAMPLES, TERMS = 20_000, 1_024
#: A term needs this chi-square against independence of the label; neighbours that vote; examples in a block.
LEAST_CHI, NEIGHBOURS, BLOCK = 20.0, 15, 64
GRAMS = (4, 5)
#: Words whose terms a task remembers, and terms it holds before it hands on their counts.
CACHED, HELD = 200_000, 200_000
WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[str]:
    """Terms of one lower-case word: itself, and its n-grams with a mark before the first letter."""
    marked = "^" + word
    return ["=" + word] + [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Examples (text, label) to term, n examples with it, toxic ones among them (summed within the task)."""
    n, toxic = Counter(), Counter()
    out = lambda: pd.DataFrame({"term": list(n), "n": list(n.values()), "toxic": [toxic[t] for t in n]})
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"]):
            own = {t for w in set(WORD.findall(text.lower())) for t in word_terms(w)}
            n.update(own)
            if label:
                toxic.update(dict.fromkeys(own, label))
            if len(n) >= HELD:
                yield out()
                n.clear(), toxic.clear()
    if n:
        yield out()


def _vectors(terms: list[str]):
    """Adds to every row the places of its vocabulary terms and how often they occur; drops the text."""
    place = {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple] = {}
        for pdf in batches:
            ids, tfs = [], []
            for text in pdf["text"]:
                total: Counter = Counter()
                for word, c in Counter(WORD.findall(text.lower())).items() if text else ():
                    hits = cache.get(word)
                    if hits is None:
                        if len(cache) >= CACHED:
                            cache.clear()
                        hits = cache[word] = tuple(place[t] for t in word_terms(word) if t in place)
                    for t in hits:
                        total[t] += c
                own = sorted(total)
                ids.append(own)
                tfs.append([total[t] for t in own])
            yield pdf.drop(columns=["text"]).assign(terms=ids, tf=tfs)

    return run


def weights(terms, tf, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term places and TF-IDF weights of one vector, of length 1."""
    at = np.asarray(terms, np.int64)
    w = (1.0 + np.log(np.asarray(tf, np.float64))) * idf[at]
    size = np.sqrt((w * w).sum())
    return at, w / size if size else w


class BlockMaxIndex:
    """Postings of unit vectors by term and block, with the largest weight of each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.n_blocks = max(1, -(-self.n // block))
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((owner, term))
        term, self.owner, self.weight = term[order], owner[order], weight[order]
        cell = term * self.n_blocks + self.owner // block
        self.start = np.searchsorted(cell, np.arange(n_terms * self.n_blocks + 1))
        self.top = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.top.reshape(-1), cell, self.weight)

    def nearest(self, terms: np.ndarray, weight: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and similarities of the k nearest vectors (similarity above 0), and how many blocks were opened."""
        bounds = weight @ self.top[terms] if len(terms) else np.zeros(self.n_blocks)
        found_at, found = np.zeros(0, np.int64), np.zeros(0)
        opened = 0
        for b in np.argsort(-bounds, kind="stable"):
            # a bound equal to the k-th similarity may hold a tie of an earlier place; 1e-9 covers rounding
            if bounds[b] <= 0 or (len(found) >= k and bounds[b] < found[k - 1] - 1e-9):
                break
            opened += 1
            score = np.zeros(self.block)
            for t, w in zip(terms, weight):
                lo, hi = self.start[t * self.n_blocks + b], self.start[t * self.n_blocks + b + 1]
                score[self.owner[lo:hi] - b * self.block] += w * self.weight[lo:hi]
            here = np.flatnonzero(score)
            at = here + b * self.block
            here, at = here[at != skip], at[at != skip]
            found_at, found = np.concatenate([found_at, at]), np.concatenate([found, np.round(score[here], 12)])
            best = np.lexsort((found_at, -found))[:k]
            found_at, found = found_at[best], found[best]
        return found_at, found, opened


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means of the labels over rising votes (pool adjacent violators): from which vote, and the mean."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # smallest vote, sum, count
    values, first, inverse = np.unique(votes[order], return_index=True, return_inverse=True)
    sums, counts = np.bincount(inverse, labels[order], len(values)), np.bincount(inverse, minlength=len(values))
    for v, s, c in zip(values, sums, counts):
        pools.append([v, s, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s2, c2 = pools.pop()
            pools[-1][1] += s2
            pools[-1][2] += c2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Scorer:
    """Scores of vectors against the examples."""

    def __init__(self, idf: np.ndarray, vectors: list[tuple], labels: np.ndarray, ids: list, k: int = NEIGHBOURS):
        # alike vectors lie together: blocks are narrow in terms, their bounds close to what they hold
        have = [i for i in sorted(range(len(vectors)), key=lambda i: (vectors[i], i)) if vectors[i][0]]
        self.idf, self.k = idf, k
        self.units = [weights(*vectors[i], idf) for i in have]
        self.labels, self.ids = labels[have], [ids[i] for i in have]
        self.index = BlockMaxIndex(self.units, len(idf))
        bare = np.setdiff1d(np.arange(len(vectors)), have)
        self.bare = float((labels[bare].sum() + (labels.mean() if len(labels) else 0.0)) / (len(bare) + 1.0))
        self.steps = None

    def vote(self, at: np.ndarray, sims: np.ndarray) -> float:
        return float((sims ** 2 * self.labels[at]).sum() / (sims ** 2).sum()) if len(at) else self.bare

    def own_vote(self, i: int) -> float:
        """The vote on example i by the others."""
        return self.vote(*self.index.nearest(*self.units[i], self.k, skip=i)[:2])

    def calibrate(self, votes: np.ndarray) -> None:
        self.steps = isotonic(votes, self.labels) if len(votes) else (np.zeros(1), np.zeros(1))

    def score(self, terms, tf) -> tuple[float, list, list]:
        """Calibrated score, and the nearest three examples with their similarities."""
        if not len(terms):
            return self.bare, [], []
        at, sims, _ = self.index.nearest(*weights(terms, tf, self.idf), self.k)
        if not len(at):
            return self.bare, [], []
        step = max(int(np.searchsorted(self.steps[0], self.vote(at, sims), "right")) - 1, 0)
        return float(self.steps[1][step]), [self.ids[i] for i in at[:3]], [round(float(s), 6) for s in sims[:3]]


def _scored(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, cache = shared.value, {}
        for pdf in batches:
            rows = []
            for terms, tf in zip(pdf["terms"], pdf["tf"]):
                key = (bytes(terms), bytes(tf))
                if key not in cache:
                    if len(cache) >= CACHED // 10:
                        cache.clear()
                    cache[key] = scorer.score(terms, tf)
                rows.append(cache[key])
            yield pd.DataFrame({"id": pdf["id"], "score": [r[0] for r in rows], "examples": [r[1] for r in rows], "similarities": [r[2] for r in rows]})

    return run


def _own_votes(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "vote": [shared.value.own_vote(int(i)) for i in pdf["i"]]})

    return run


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def examples(docs: DataFrame, labels: DataFrame, label_col: str, n: int = EXAMPLES) -> DataFrame:
    """id, text, label: at most ``n`` distinct labelled texts of the training folds, those of the smallest digests.

    Only ids and digests are joined with the labels; the texts of the chosen (at most ``n`` rows, broadcast) are
    read after, and copies of one text are summed to one within the tasks."""
    named = labels.filter(F.col(label_col).isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max(label_col).alias("label"))
    keys = docs.filter(F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))).select("id", F.xxhash64("text").alias("digest"))
    one = keys.join(named, "id").groupBy("digest").agg(F.min("id").alias("id"), F.avg("label").cast("double").alias("label"))
    chosen = written(one.orderBy("digest").limit(n), "toxicity-chosen")
    at = F.broadcast(chosen.select("id", "digest", "label"))
    texts = docs.withColumn("digest", F.xxhash64("text")).join(at, ["id", "digest"])
    return texts.groupBy("digest").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.min("label").alias("label"))


def vocabulary(sample: DataFrame, n_terms: int = TERMS, least_chi: float = LEAST_CHI) -> list[str]:
    """The terms that tell toxic examples apart best, at most ``n_terms``."""
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    if not total.n or not total.toxic or total.toxic >= total.n:
        return []
    counts = sample.select("text", "label").repartition(sample.sparkSession.sparkContext.defaultParallelism).mapInPandas(_term_counts, "term string, n double, toxic double")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    due = F.col("n") * (total.toxic / total.n)
    chi = F.pow(F.col("toxic") - due, 2) / (due * (1 - total.toxic / total.n))
    best = counts.filter((F.col("toxic") > due) & (F.col("toxic") >= 3) & (2 * F.col("toxic") >= F.col("n"))).select("term", F.round(chi, 6).alias("chi"))
    return [r.term for r in best.filter(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "term").limit(n_terms).collect()]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n_examples: int = EXAMPLES, n_terms: int = TERMS) -> DataFrame:
    """One row per document: id, held_out, score, predicted, examples, similarities (the nearest three examples)."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = written(examples(rows, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias(label_col)), label_col, n_examples), "toxicity-examples")
    terms = vocabulary(sample, n_terms)
    kind = "terms array<int>, tf array<int>"
    vectors = written(rows.mapInPandas(_vectors(terms), f"id {docs.schema[id_col].dataType.simpleString()}, {kind}"), "toxicity-vectors")
    seen = {r.t: r.n for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs = vectors.count()
    idf = np.array([np.log((1.0 + n_docs) / (1.0 + seen.get(t, 0))) + 1.0 for t in range(len(terms))])
    known = sample.select("id", "text", "label", "digest").mapInPandas(_vectors(terms), f"id {docs.schema[id_col].dataType.simpleString()}, label double, digest bigint, {kind}")
    known = sorted(known.collect(), key=lambda r: r.digest)
    scorer = Scorer(idf, [(tuple(r.terms), tuple(r.tf)) for r in known], np.array([r.label for r in known]), [r.id for r in known])
    shared = spark.sparkContext.broadcast(scorer)
    n_known = len(scorer.units)
    own = spark.range(n_known, numPartitions=max(1, min(64, n_known // 200))).withColumnRenamed("id", "i").mapInPandas(_own_votes(shared), "i bigint, vote double")
    votes = np.array([r.vote for r in own.orderBy("i").collect()])
    scorer.calibrate(votes)
    final = spark.sparkContext.broadcast(scorer)
    out = vectors.mapInPandas(_scored(final), f"id {docs.schema[id_col].dataType.simpleString()}, score double, examples array<bigint>, similarities array<double>")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "examples", "similarities")
