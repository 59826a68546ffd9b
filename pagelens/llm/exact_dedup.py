"""Operator 10, exact dedup: Patricia-trie owners.

Texts are equal when identical after lower-casing A-Z. Each task inserts the full byte strings of its
documents into one compressed radix trie whose terminal nodes hold the owner id and the number of
rows; so copies collapse before anything is shuffled, and a group with a third of all rows costs one
terminal per task. When a trie outgrows its budget, its largest subtrees are emitted and cut off
(their terminals are partial results that merge later).

The terminals are dealt by length and content hash, equal texts together. A partition goes through
buckets of a length class (bits of the length) and some bits of the hash; each bucket has one trie of
the byte strings of all its texts. They arrive in byte order, so all subtrees beside the path of the
last text are whole: a trie over its budget emits those as results and cuts them off, and nothing has
to be merged again.

Defined cases: a null text counts as empty; a null id never owns a group that has another id;
repeated rows count in ``group_size`` and, having the owner's id, are all flagged kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import lower_ascii, prepare, text_of

#: Bytes of labels a task's trie may hold before subtrees are spilled.
TRIE_BYTES = 48 << 20
#: Bits of the content hash that tell the buckets of a length class in a partition apart; what is too much for a trie spills.
HASH_BITS = 4
#: Bytes of texts in a batch of results, which Python, Arrow and the executor each hold once more.
CHUNK_BYTES = 1 << 20


class Node:
    __slots__ = ("label", "kids", "own", "rows")

    def __init__(self, label: bytes) -> None:
        self.label, self.kids, self.own, self.rows = label, {}, None, 0


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving (slices compare at memory speed)."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi - 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Byte strings with an owner id (smallest, or largest with ``keep='max'``) and a row count each."""

    def __init__(self, keep: str = "min") -> None:
        self.root, self.bytes, self.better = Node(b""), 0, max if keep == "max" else min

    def insert(self, key: bytes, own: int | None, rows: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = Node(key[at:])
                node.kids[key[at]] = kid
                self.bytes += len(kid.label) + 200
                node, at = kid, len(key)
                break
            rest = key[at:at + len(kid.label)]
            if rest != kid.label:
                n = common_prefix(rest, kid.label)
                top = Node(kid.label[:n])
                kid.label = kid.label[n:]
                top.kids[kid.label[0]] = kid
                node.kids[key[at]] = top
                self.bytes += 200
                kid = top
            node, at = kid, at + len(kid.label)
        if own is not None:
            node.own = own if node.own is None else self.better(node.own, own)
        node.rows += rows

    def _size(self, node: Node) -> int:
        todo, total = [node], 0
        while todo:
            x = todo.pop()
            total += len(x.label) + 200
            todo.extend(x.kids.values())
        return total

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node or self.root, prefix)]
        while todo:
            x, before = todo.pop()
            key = before + x.label
            if x.rows:
                yield key, x.own, x.rows
            todo.extend((k, key) for k in x.kids.values())

    def spill_behind(self, key: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        """Cut off and yield all subtrees beside the path to ``key``, and the terminals on it before ``key``."""
        node, at = self.root, 0
        while True:
            on_path = key[at] if at < len(key) else None
            for c in [c for c in node.kids if c != on_path]:
                kid = node.kids.pop(c)
                self.bytes -= self._size(kid)
                yield from self.terminals(kid, key[:at])
            if on_path is None:
                return
            if node.rows:
                yield key[:at], node.own, node.rows
                node.own, node.rows = None, 0
            node = node.kids[on_path]
            at += len(node.label)

    def spill(self, to: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Cut off and yield the largest subtrees below the first fork until ``to`` bytes remain."""
        parent, prefix = self.root, b""
        while len(parent.kids) == 1 and not next(iter(parent.kids.values())).rows:
            parent = next(iter(parent.kids.values()))
            prefix += parent.label
        sizes = sorted(((self._size(k), c) for c, k in parent.kids.items()), reverse=True)
        for size, c in sizes:
            if self.bytes <= to:
                break
            yield from self.terminals(parent.kids.pop(c), prefix)
            self.bytes -= size


PART = "body binary, own bigint, rows bigint"
OWNERS = "n_bytes bigint, text_sha256 string, keep_id bigint, group_size bigint"
Found = Iterator[tuple[bytes, int | None, int]]


def _chunks(found: Found, limit: int = CHUNK_BYTES) -> Iterator[list[tuple[bytes, int | None, int]]]:
    out, size = [], 0
    for x in found:
        out.append(x)
        size += len(x[0])
        if size > limit:
            yield out
            out, size = [], 0
    if out:
        yield out


def _partial(found: Found) -> Iterator[pd.DataFrame]:
    for x in _chunks(found):
        yield pd.DataFrame({"body": [k for k, _, _ in x], "own": pd.array([o for _, o, _ in x], dtype="Int64"), "rows": [n for _, _, n in x]})


def _whole(found: Found) -> Iterator[pd.DataFrame]:
    for x in _chunks(found):
        yield pd.DataFrame({"n_bytes": [len(k) for k, _, _ in x], "text_sha256": [hashlib.sha256(k).hexdigest() for k, _, _ in x],
                            "keep_id": pd.array([o for _, o, _ in x], dtype="Int64"), "group_size": [n for _, _, n in x]})


def _id(own) -> int | None:
    return None if own is pd.NA else int(own)


def _local(keep: str, budget: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = PatriciaTrie(keep)
        for pdf in batches:
            for body, own in zip(pdf["body"], pdf["id"].astype("Int64")):
                trie.insert(bytes(body), _id(own), 1)
            if trie.bytes > budget:
                yield from _partial(trie.spill(budget // 2))
        yield from _partial(trie.terminals())

    return run


def _merge(keep: str, budget: int):
    """Rows in the order of bucket and body to whole results, a trie for each bucket."""
    def results(batches: Iterator[pd.DataFrame]) -> Found:
        trie, at = PatriciaTrie(keep), None
        for pdf in batches:
            for bucket, body, own, rows in zip(pdf["bucket"].tolist(), pdf["body"], pdf["own"].astype("Int64"), pdf["rows"].tolist()):
                if bucket != at:
                    yield from trie.terminals()
                    trie, at = PatriciaTrie(keep), bucket
                key = bytes(body)
                trie.insert(key, _id(own), rows)
                if trie.bytes > budget:
                    yield from trie.spill_behind(key)
        yield from trie.terminals()

    return lambda batches: _whole(results(batches))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the lowered text).

    ``keep`` is 'min' or 'max': which id of a group of equal texts owns it.
    """
    prepare(docs.sparkSession)
    norm = lower_ascii(text_of(F.col("__text")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("__text")).select("id", norm.cast("binary").alias("body"))
    partial = rows.mapInPandas(_local(keep, trie_bytes), PART).withColumns({"n_bytes": F.octet_length("body"), "hash": F.xxhash64("body")})
    length_class = F.length(F.bin("n_bytes"))
    bucket = (length_class * (1 << HASH_BITS) + F.pmod("hash", F.lit(1 << HASH_BITS))).cast("bigint")
    dealt = partial.repartition("n_bytes", "hash").select(bucket.alias("bucket"), "body", "own", "rows")
    owners = dealt.sortWithinPartitions("bucket", "body").mapInPandas(_merge(keep, trie_bytes), OWNERS)
    members = rows.select("id", F.octet_length("body").cast("bigint").alias("n_bytes"), F.sha2("body", 256).alias("text_sha256"))
    return members.join(owners, ["n_bytes", "text_sha256"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
