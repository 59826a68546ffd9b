"""Operator 13, spelling variants: one-edit neighbourhoods in a reduced alphabet.

Letters are hashed to a few symbols; the words near a word (one code point inserted, deleted or
replaced) then have reduced forms that are equal or one edit apart. For every word the one-edit
neighbourhood of its reduced form is generated and joined with the reduced vocabulary; what meets is
verified on the words themselves. A pair is generated from one of its ends only: an insertion is the
other side's deletion, and of two different symbols the larger generates the smaller. Reduced words are
64-bit polynomial hashes, so that a neighbour costs the same whatever the word's length; a collision adds
a candidate, which verification drops.

How many symbols words of a length get follows the size of the vocabulary, so that a reduced word stands
for few words at any size: short words get many symbols and have few places, long words few. A word
enters the reduced vocabulary under the alphabet of its own length, for replacements, and under that of
the next length, whose words reach it by a deletion.

Counts are summed within tasks before rows move, so a word that a third of all rows hold arrives as one
row a task; after that only distinct words are handled. Roots come from pointer doubling: a form has at
least ``ratio`` times the word's occurrences, so chains are short and have no cycle.

Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count
each; a run from which a code point is deleted may vanish; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import prepare, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words a task holds before it hands on their counts.
HELD = 200_000
#: Reduced words are to outnumber the words of the vocabulary by this factor; smallest and largest alphabet.
ROOM, FEWEST, MOST = 8, 2, 64
#: Neighbours generated at once in a task.
CHUNK = 1_000_000
PRIME = 0x9E3779B97F4A7C15 | 1


def _counted(every: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"]):
                if not text:
                    continue
                start = zlib.crc32(f"{i}:".encode())
                # bytes.lower() lowers A-Z only
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    held[word] += n
                if len(held) >= HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return run


def vocabulary(docs: DataFrame, every: int = 97, least_chars: int = 5, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of the texts, with one code point deleted from every run whose checksum ``every`` divides."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInPandas(_counted(every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= least_n) & (F.char_length("word") >= least_chars))


def symbols(n_words: int, length: int) -> int:
    """Symbols of the reduced alphabet for words of a length."""
    return int(min(max(np.ceil((ROOM * max(n_words, 1)) ** (1.0 / max(length, 1))), FEWEST), MOST))


def _reduced(points: np.ndarray, size: int) -> np.ndarray:
    """Code points hashed to 1..size."""
    return ((points * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(size) + np.uint64(1)).astype(np.uint64)


def _keys(hashes: np.ndarray, size: int, length: int) -> np.ndarray:
    """Reduced words of one alphabet and length, as join keys."""
    h = hashes ^ np.uint64((size * 1_000_003 + length) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)


def _powers(length: int) -> np.ndarray:
    out = np.full(length + 1, PRIME, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _by_length(pdf: pd.DataFrame, per_row) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """Words of equal length with their code points (a row a word), few enough rows at once for CHUNK neighbours."""
    for length, part in pdf.groupby(pdf["word"].str.len(), sort=False):
        rows = max(1, CHUNK // per_row(length))
        for k in range(0, len(part), rows):
            some = part.iloc[k:k + rows]
            yield length, some, np.frombuffer("".join(some["word"]).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)


def _homes(n_words: int):
    """The reduced vocabulary: key, word, n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, some, points in _by_length(pdf, lambda n: n):
                for size in {symbols(n_words, length), symbols(n_words, length + 1)}:
                    hashes = (_reduced(points, size) * _powers(length)[:length]).sum(axis=1, dtype=np.uint64)
                    yield pd.DataFrame({"key": _keys(hashes, size, length), "word": some["word"].to_numpy(), "n": some["n"].to_numpy()})

    return run


def _neighbours(n_words: int):
    """Reduced neighbours: key, same (the reduced word itself), of, of_n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inverse = np.uint64(pow(PRIME, -1, 1 << 64))
        for pdf in batches:
            for length, some, points in _by_length(pdf, lambda n: n * (2 + symbols(n_words, n) // 2)):
                size, powers = symbols(n_words, length), _powers(length)
                r = _reduced(points, size)
                terms = r * powers[:length]
                whole = terms.sum(axis=1, dtype=np.uint64)
                row = np.arange(len(some))
                keys, rows = [_keys(whole, size, length)], [row]
                for s in range(1, size):  # replaced by a smaller symbol
                    at, pos = np.nonzero(r > np.uint64(s))
                    keys.append(_keys(whole[at] - terms[at, pos] + np.uint64(s) * powers[pos], size, length))
                    rows.append(at)
                # one symbol deleted, from a run of equal ones the first
                before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                gone = before + (whole[:, None] - before - terms) * inverse
                first = np.ones(r.shape, bool)
                first[:, 1:] = r[:, 1:] != r[:, :-1]
                at, pos = np.nonzero(first)
                keys.append(_keys(gone[at, pos], size, length - 1))
                rows.append(at)
                rows = np.concatenate(rows)
                same = np.zeros(len(rows), bool)
                same[:len(some)] = True
                yield pd.DataFrame({"key": np.concatenate(keys), "same": same, "of": some["word"].to_numpy()[rows], "of_n": some["n"].to_numpy()[rows]})

    return run


def near_pairs(words: DataFrame, n_words: int) -> DataFrame:
    """a, a_n, b, b_n: every unordered pair of words one edit apart, once. ``words``: distinct word, with n."""
    homes = words.mapInPandas(_homes(n_words), "key bigint, word string, n bigint")
    probes = words.mapInPandas(_neighbours(n_words), "key bigint, same boolean, of string, of_n bigint")
    met = probes.join(homes.hint("shuffle_hash"), "key").filter(~F.col("same") | (F.col("of") < F.col("word")))
    # a pair that meets under the wrong length or by equal hashes alone falls here; of two words of one
    # length the probe's symbol is larger or equal, so no pair meets twice
    return met.filter(F.levenshtein("of", "word", 1) == 1).select(F.col("of").alias("a"), F.col("of_n").alias("a_n"), F.col("word").alias("b"), F.col("n").alias("b_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for every word with a form, by pointer doubling."""
    to = forms.select("word", F.col("form").alias("root"))
    while True:
        up = to.select(F.col("word").alias("up"), F.col("root").alias("up_root"))
        stepped = to.join(up, F.col("root") == F.col("up"), "left")
        to = written(stepped.select("word", F.coalesce("up_root", "root").alias("root"), F.col("up_root").isNotNull().alias("moved")), "spelling-roots")
        if to.filter("moved").isEmpty():
            return to.drop("moved")


def spelling_variants(docs: DataFrame, ratio: int = 2, every: int = 97, least_chars: int = 5, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    spark = prepare(docs.sparkSession)
    words = written(vocabulary(docs, every, least_chars, least_n, id_col, text_col), "spelling-words")
    pairs = near_pairs(words, words.count())
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best")
    near = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    known = words.join(near, "word", "left")
    takes = -F.col("best.rank") >= ratio * F.col("n")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(takes, F.col("best.form")).alias("form"),
                                 F.when(takes, -F.col("best.rank")).alias("form_n")), "spelling-forms")
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
