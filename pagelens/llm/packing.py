"""Operator 7, best-fit packing: hierarchical residual packing.

Every input partition tokenises its documents and packs their pieces best-fit, longest first, into
sequences of ``capacity`` tokens. Sequences that are nearly full are final. The others become items
(indivisible, with their fill as length) of the next round, in which eight partitions merge into one
and are packed best-fit again, up to one tree root. Only fills move between rounds, never tokens: at
the end each piece looks up the sequence and place of the one it was first put in.

A document is its token ids and one end token. Only documents longer than a sequence are cut, into
pieces of ``capacity`` tokens, of which the first may be shorter; full pieces are sequences at once, so
each document brings one item at most.

A merge passes on the ``CARRY`` emptiest of its sequences at most, so a task's memory is bounded
whatever the table's size; the others are final as they are, and no piece is ever left out. (After a
best-fit round at most one sequence of a group is half full or less, so of a thousand groups a
thousand sequences at most can still fill others.)

Ids are those of the ``tokenizers`` library. Texts of plain Latin letters, digits, ASCII signs and short
runs are encoded by ``tiktoken`` where its file of the same vocabulary is given, which gives the same
ids three times as fast; all others by ``tokenizers`` itself.

Defined cases: a null or empty text is one token, the end; repeated rows and null ids are packed
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import prepare, text_of, written

CAPACITY = 2048
FAN_IN = 8
CARRY = 20_000
#: A sequence with less room than this share of the capacity is nearly full.
NEARLY = 0.01
PLAIN = re.compile(r"[\n\t -~À-ÖØ-öø-ÿ]*")
LONG_RUN = 300
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, place bigint, fill bigint, home bigint"


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path)
    slow.no_truncation()
    slow.no_padding()
    if not ranks_path:
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            words = text.split()
            if not words or max(map(len, words)) < LONG_RUN and len(text) - sum(map(len, words)) - len(words) < LONG_RUN:
                return np.array(fast.encode(text, allowed_special=allowed, disallowed_special=()), dtype="<u4")
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item (longest first, each into the fullest bin that takes it), fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by their room
    have = 0  # bit r is set if some open bin has room r
    fills: list[int] = []
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        fit = have >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                have &= ~(1 << r)
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += n
        if r > n:
            room[r - n].append(b)
            have |= 1 << (r - n)
    return bins, places, np.array(fills, dtype=np.int64)


def _pack_partition(tokenizer_path: str, ranks_path: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, home = encoder(tokenizer_path, ranks_path), TaskContext.get().partitionId()
        rows, ids_of = [], []
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    ids_of.append(doc_id)
        if not rows:
            return
        x = np.array(rows, dtype=np.int64)
        bins, places, fills = best_fit(x[:, 2], capacity)
        out = pd.DataFrame({"doc_id": pd.array(ids_of, dtype="Int64"), "piece": x[:, 0].astype(np.int32), "start": x[:, 1], "length": x[:, 2], "ids_crc32": x[:, 3],
                            "bin": (home << 32) + bins, "place": places, "fill": fills[bins], "home": home})
        for at in range(0, len(out), 50_000):
            yield out.iloc[at:at + 50_000]

    return run


def _merge(capacity: int, level: int, carry: int):
    base = level << 56

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "unit"], kind="stable", ignore_index=True)
        bins, places, fills = best_fit(pdf["fill"].to_numpy(), capacity)
        order = np.argsort(fills, kind="stable")
        open_ = np.zeros(len(fills), bool)
        open_[order[:carry]] = True
        open_ &= fills < capacity * (1 - NEARLY)
        return pd.DataFrame({"unit": pdf["unit"], "parent": base + (int(key[0]) << 32) + bins, "place": places, "fill": fills[bins], "open": open_[bins], "home": int(key[0])})

    return run


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, carry: int = CARRY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    pieces = written(rows.mapInPandas(_pack_partition(tokenizer_path, ranks_path, capacity, end_id), PIECES), "pack-pieces")
    units = pieces.filter(F.col("fill") < capacity * (1 - NEARLY)).groupBy("bin").agg(F.first("fill").alias("fill"), F.first("home").alias("home")).withColumnRenamed("bin", "unit")
    homes = (pieces.agg(F.max("home")).first()[0] or 0) + 1
    links, level = [], 0
    while homes > 1 or not links:
        level += 1
        homes = -(-homes // fan_in)
        merged = units.withColumn("to", F.floor(F.col("home") / fan_in)).groupBy("to").applyInPandas(
            _merge(capacity, level, carry if homes > 1 else 0), "unit bigint, parent bigint, place bigint, fill bigint, open boolean, home bigint")
        merged = written(merged, f"pack-level{level}")
        links.append(merged)
        units = merged.filter("open").groupBy(F.col("parent").alias("unit")).agg(F.first("fill").alias("fill"), F.first("home").alias("home"))
    # from the root down: where each unit ends up, and at which place
    final = None
    for merged in reversed(links):
        here = merged.select("unit", F.col("parent").alias("sequence_id"), F.col("place").alias("base"), "open")
        if final is not None:
            up = final.select(F.col("unit").alias("up"), F.col("sequence_id").alias("up_id"), F.col("base").alias("up_base"))
            here = here.join(up, here["sequence_id"] == up["up"], "left").select(
                "unit", F.coalesce("up_id", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("up_base", F.lit(0))).alias("base"))
        final = here.select("unit", "sequence_id", "base")
    out = pieces.join(final, pieces["bin"] == final["unit"], "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"))
