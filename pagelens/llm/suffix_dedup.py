"""Operator 1, suffix-array dedup by linear grouping construction.

Removes every byte covered by a ``LENGTH``-byte string that also starts earlier. The text of a corpus is
never sorted as a whole:

1. Every ``LENGTH``-byte window has an anchor, the 32 bytes in it with the smallest hash. Equal windows have
   equal anchors, so only windows whose anchor occurs twice are looked at. Neighbouring windows with one
   anchor form a context, which is what moves, with the anchor's hash as key.
2. Equal contexts are one, with their earliest place, before and while they are shuffled. Where an
   anchor has a single context, its windows are equal to that one's and nothing needs an order.
3. The contexts of other anchors are cut to the windows found in more than one of them, and a suffix
   array of these strings brings equal windows together. It is built by linear grouping: suffixes are
   grouped by their Lyndon prefix, the groups processed in descending order with previous-smaller
   pointers, and the order is emitted from the groups without recursion or renaming.
4. An anchor with more than ``BLOCK`` contexts is dealt over several suffix arrays; their windows, one row for
   each distinct one, are then brought together by digest.
5. Each document gets the windows that have an earlier equal, and its text is cut.

Which anchors occur twice is told to the tasks by a bitmap of fixed size; where it fills up, more
contexts move, with the same result. Hashes of anchors and contexts have 64 bits each and are
compared together.

Defined cases: a null or empty text has no bytes; texts shorter than ``LENGTH`` are kept; null ids are the
last and one document; rows with the same id are one document, so neither is earlier than the
other at the same start; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import MAP_ROW, maybe_among, prepare, text_of, written
from pagelens.llm.shingles import SLICE_BYTES, _powers, _tables, mix

LENGTH = 100
ANCHOR = 32
BLOCK = 50_000
#: Bytes that one suffix array is built over, unless a single anchor has more.
ARRAY_BYTES = 1 << 16
#: Texts are hashed in slices of about this size: their arrays stay in a core's cache.
HASHED_BYTES = 1 << 16
BITS = 1 << 27
LAST = (1 << 63) - 1
_U = np.uint64


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of integers that end with a unique smallest one.

    Phase 1 refines groups of suffixes, which are intervals of ``sa`` named by their start, from the
    highest to the lowest; ``prev`` points to the nearest suffix on the left in a lower group. Suffixes
    that a group points to move, by how often it does, into new groups just above their old ones.
    Phase 2 walks the array from the smallest suffix and places what stands left of each, along ``prev``.
    """
    n = len(s)
    sa = sorted(range(n), key=s.__getitem__)
    at, group, end, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    g = 0
    for i, p in enumerate(sa):
        if s[p] != s[sa[g]]:
            end[g] = i
            g = i
        at[p], group[p] = i, g
    end[g] = n
    hi = n
    while hi > 0:
        g = group[sa[hi - 1]]
        times: dict[int, int] = {}
        for p in sorted(sa[g:hi]):
            q = p - 1
            while q >= 0 and group[q] >= g:
                q = prev[q]
            prev[p] = q
            if q >= 0:
                times[q] = times.get(q, 0) + 1
        hi = g
        most = max(times.values(), default=0)
        if most <= 1:
            sets = [list(times)] if times else []
        else:
            by: dict[int, list[int]] = {}
            for q, k in times.items():
                by.setdefault(k, []).append(q)
            sets = [by[k] for k in sorted(by, reverse=True)]
        for found in sets:
            old_end: dict[int, int] = {}
            for q in found:
                o = group[q]
                e = end[o]
                if o not in old_end:
                    old_end[o] = e
                e -= 1
                end[o] = e
                i, r = at[q], sa[e]
                sa[i], sa[e] = r, q
                at[r], at[q] = i, e
            for o, e in old_end.items():
                b = end[o]
                for i in range(b, e):
                    group[sa[i]] = b
                end[b] = e
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
    return out


def contexts(bodies: list[bytes], only_anchors: bool = False) -> tuple[np.ndarray, ...]:
    """Of every run of windows with one anchor: document index, first window, windows, offset of the anchor,
    hash of the anchor, hash of the context (places in bytes of the document)."""
    values, _, base, _ = _tables()
    joined = b"".join(bodies)
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes)
    empty = np.empty(0, np.int64)
    if len(joined) < LENGTH or sizes.max(initial=0) < LENGTH:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    raw = np.frombuffer(joined, np.uint8)
    letters = values[raw]
    h, step, power = letters, 1, base
    while step < ANCHOR:
        h = h[:-step] * _U(power) + h[step:]
        step, power = step * 2, power * power % (1 << 64)
    h = mix(h)
    width = LENGTH - ANCHOR + 1
    low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    n = len(joined) - LENGTH + 1
    low = np.minimum(low[:n], low[width - step: width - step + n])
    inside = np.zeros(len(joined) + 1, np.int32)
    has = sizes >= LENGTH
    np.add.at(inside, (ends - sizes)[has], 1)
    np.add.at(inside, (ends - LENGTH + 1)[has], -1)
    start = np.flatnonzero(np.cumsum(inside[:n]))
    anchor = (low[start] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    a = anchor[new]
    if only_anchors:
        return (h[a],)
    up, down = _powers(1 << max(20, (len(joined) + 1).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[: len(raw)], dtype=np.uint64)])
    body = mix((total[last + LENGTH] - total[first]) * down[first] + (a - first).astype(np.uint64))
    doc = np.searchsorted(ends, first, side="right")
    return doc, first - (ends - sizes)[doc], last - first + 1, a - first, h[a], body


def _sliced(texts) -> Iterator[list[bytes]]:
    out, size = [], 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        out.append(b)
        size += len(b)
        if size >= HASHED_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for bodies in _sliced(pdf["text"]):
            yield pd.DataFrame({"h": contexts(bodies, only_anchors=True)[-1].view(np.int64)})


def _repeated(bits, with_body: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = np.frombuffer(bits.value, np.uint8)
        for pdf in batches:
            ids, marks, at = pdf["id"].to_numpy(), pdf["mark"].to_numpy(), 0
            for bodies in _sliced(pdf["text"]):
                doc, first, wins, off, h, body = contexts(bodies)
                bit = (h & _U(BITS - 1)).astype(np.int64)
                i = np.flatnonzero((have[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                doc, first, wins = doc[i], first[i], wins[i]
                out = {"id": ids[at + doc], "mark": marks[at + doc], "first": first, "wins": wins, "h": h[i].view(np.int64), "body": body[i].view(np.int64)}
                if with_body:
                    out["bytes"] = [bodies[d][f:f + w + LENGTH - 1] for d, f, w in zip(doc.tolist(), first.tolist(), wins.tolist())]
                yield pd.DataFrame(out)
                at += len(bodies)

    return run


def _windows_twice(strings: list[bytes]) -> list[tuple[int, int, int]]:
    """(string, first window, end) of the runs of windows that occur more than once among the strings of an anchor."""
    sizes = np.array([len(b) - LENGTH + 1 for b in strings])
    owner = np.repeat(np.arange(len(strings)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - begin[owner]
    joined = b"".join(strings)
    values, _, _, _ = _tables()
    up, down = _powers(1 << max(20, (len(joined) + 1).bit_length()))
    raw = np.frombuffer(joined, np.uint8)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[: len(raw)], dtype=np.uint64)])
    offset = begin + np.arange(len(strings)) * (LENGTH - 1)  # of each string in joined
    p = offset[owner] + place
    w = (total[p + LENGTH] - total[p]) * down[p]
    _, inv, count = np.unique(w, return_inverse=True, return_counts=True)
    twice = count[inv] > 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.where(twice, owner + 1, 0), [0]])))
    return [(int(owner[a]), int(place[a]), int(place[b - 1]) + 1) for a, b in zip(edge, edge[1:]) if twice[a]]


def equal_windows(strings: list[bytes]) -> Iterator[list[tuple[int, int]]]:
    """Groups of (string, window) with the same bytes, two or more each, from the suffix array of the strings."""
    text: list[int] = []
    start: list[int] = []
    for b in strings:
        start.append(len(text))
        text.extend(x + 2 for x in b)
        text.append(1)
    text.append(0)
    owner = np.repeat(np.arange(len(strings)), [len(b) + 1 for b in strings]).tolist()
    run: list[tuple[int, int]] = []
    body = None
    for p in suffix_array(text):
        if p == len(text) - 1:
            continue
        k = owner[p]
        w = p - start[k]
        if w + LENGTH > len(strings[k]):
            continue
        mine = strings[k][w:w + LENGTH]
        if mine != body:
            if len(run) > 1:
                yield run
            run, body = [], mine
        run.append((k, w))
    if len(run) > 1:
        yield run


OWNED = "h bigint, body bigint, wins int, k0 int, k1 int, own_id bigint, own_first bigint, window binary"


def _owners(group: list[tuple], runs: list[tuple[int, int, int, int]], same: dict[int, dict[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(context, first window, end, owner's id, owner's first window) of the contexts of one anchor.

    ``runs`` are (context, first window, end, string), ``same`` tells the windows of a string that other strings have.
    """
    earliest: dict[int, tuple[int, int]] = {}
    for k, a, _, i in runs:
        place = (group[k][3], group[k][4] + a)
        if i not in earliest or place < earliest[i]:
            earliest[i] = place
    shared: dict[int, tuple[int, int]] = {}
    for i, (id_, first) in earliest.items():
        for w, n in same.get(i, {}).items():
            place = (id_, first + w)
            if n not in shared or place < shared[n]:
                shared[n] = place
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    for _, a, b, i in runs:
        if i in parts:
            continue
        (id_, first), mine, parts[i], begin, now = earliest[i], same.get(i), [], 0, earliest[i]
        if mine:
            for w in range(1, b - a + 1):
                own = None if w == b - a else shared[mine[w]] if w in mine else (id_, first + w)
                if w == 1:
                    now = shared[mine[0]] if 0 in mine else earliest[i]
                if own is None or own != (now[0], now[1] + w - begin):
                    parts[i].append((begin, w, *now))
                    begin, now = w, own
        else:
            parts[i].append((0, b - a, *now))
    done = [0] * len(group)
    for k, a, b, i in runs:
        if a > done[k]:
            yield k, done[k], a, group[k][3], group[k][4] + done[k]
        for x, y, id_, first in parts[i]:
            yield k, a + x, a + y, id_, first
        done[k] = b
    for k, r in enumerate(group):
        if done[k] < r[2]:
            yield k, done[k], r[2], r[3], r[4] + done[k]


def _ordered(groups: list[list[tuple]]) -> pd.DataFrame:
    """Rows (h, body, wins, id, first, bytes, blocks) of whole anchors or blocks -> OWNED."""
    flat = [r[5] for g in groups for r in g]
    runs = _windows_twice(flat)
    out, at, base = [], 0, 0
    strings: dict[bytes, int] = {}
    held: list[tuple[list[tuple], list[tuple[int, int, int, int]]]] = []

    def emit() -> None:
        several = list(strings)
        same: dict[int, dict[int, int]] = {}
        for n, found in enumerate(equal_windows(several) if len(several) > 1 else ()):
            for i, w in found:
                same.setdefault(i, {})[w] = n
        for group, mine in held:
            for k, a, b, id_, first in _owners(group, mine, same):
                r = group[k]
                if r[6] == 1:
                    out.append((*r[:3], a, b, id_, first, None))
                else:
                    out.extend((*r[:3], w, w + 1, id_, first + w - a, hashlib.blake2b(r[5][w:w + LENGTH], digest_size=16).digest()) for w in range(a, b))
        strings.clear()
        held.clear()

    size = 0
    for group in groups:
        mine, cut = [], {}
        while at < len(runs) and runs[at][0] < base + len(group):
            k, a, b = runs[at]
            mine.append((k - base, a, b, group[k - base][5][a:b + LENGTH - 1]))
            at += 1
        base += len(group)
        for x in mine:
            cut.setdefault(x[3], len(cut))
        if len(cut) > 1:  # else equal windows are in equal strings
            for x in cut:
                cut[x] = strings.setdefault(x, len(strings))
                size += len(x)
        else:
            cut = dict.fromkeys(cut, -1)
        held.append((group, [(k, a, b, cut[x]) for k, a, b, x in mine]))
        if size > ARRAY_BYTES:
            emit()
            size = 0
    emit()
    return pd.DataFrame(out, columns=["h", "body", "wins", "k0", "k1", "own_id", "own_first", "window"])


def _order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts of anchors, an anchor's (or a block's) rows together -> the owner of each window, in runs; per
    window with its digest where the anchor is dealt over several blocks."""
    groups: list[list[tuple]] = []
    last, size = None, 0
    for pdf in batches:
        columns = [pdf[c].tolist() for c in ("h", "body", "wins", "id", "first", "bytes", "blocks", "block")]
        for r in zip(*columns):
            if last != (r[0], r[7]):
                if size > SLICE_BYTES:
                    yield _ordered(groups)
                    groups, size = [], 0
                groups.append([])
                last = (r[0], r[7])
            groups[-1].append(r)
            size += len(r[5])
    if groups:
        yield _ordered(groups)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for id_, text, found in zip(pdf["id"], pdf["text"], pdf["found"]):
            b = text.encode("utf-8", "surrogatepass")
            kept, at, spans, removed = hashlib.sha256(), 0, 0, 0
            for s, e in sorted((int(x["s"]), int(x["e"])) for x in found):
                if s > at or not spans:
                    kept.update(b[at:s])
                    spans += 1
                    at = s
                if e > at:
                    removed += e - at
                    at = e
            kept.update(b[at:])
            out.append((id_, len(b), removed, spans, kept.hexdigest()))
        yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _bitmap(spark, ids: DataFrame):
    """A bitmap of BITS bits, broadcast: its size does not depend on the number of ids."""
    p = F.col(ids.columns[0]).bitwiseAND(F.lit(BITS - 1))
    rows = ids.select(p.alias("p")).groupBy(F.floor(F.col("p") / MAP_ROW).cast("int").alias("row")).agg(F.bitmap_construct_agg(F.col("p") % MAP_ROW).alias("bits"))
    out = bytearray(BITS // 8)
    for r in rows.toLocalIterator():  # BITS / MAP_ROW rows at most
        out[r["row"] * MAP_ROW // 8:(r["row"] + 1) * MAP_ROW // 8] = r["bits"]
    return spark.sparkContext.broadcast(bytes(out))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of what is left)."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST))).withColumn("mark", F.xxhash64("text"))
    long = rows.filter(F.octet_length("text") >= LENGTH).select("id", "mark", "text")
    anchors = long.mapInPandas(_anchors, "h bigint")
    bits = _bitmap(spark, anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    fields = "id bigint, mark bigint, first bigint, wins int, h bigint, body bigint"
    places = written(long.mapInPandas(_repeated(bits, False), fields), "suffix-places")
    found = long.mapInPandas(_repeated(bits, True), fields + ", bytes binary").groupBy("h", "body", "wins").agg(
        F.min(F.struct("id", "first", "bytes")).alias("earliest"), F.count(F.lit(1)).alias("n"))
    found = written(found.select("h", "body", "wins", "n", "earliest.*"), "suffix-contexts")
    many = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "suffix-anchors")
    single = found.filter("n > 1").join(many, "h", "left_anti").select(
        "h", "body", "wins", F.lit(0).alias("k0"), F.col("wins").alias("k1"), F.col("id").alias("own_id"), F.col("first").alias("own_first"))
    blocks = F.ceil(F.col("contexts") / block)
    dealt = found.join(many, "h").withColumn("blocks", blocks).withColumn("block", F.pmod(F.col("body"), F.col("blocks")))
    ordered = dealt.select("h", "body", "wins", "id", "first", "bytes", "blocks", "block").repartition("h", "block").sortWithinPartitions("h", "block").mapInPandas(_order, OWNED)
    ordered = written(ordered, "suffix-ordered")
    columns = ["h", "body", "wins", "k0", "k1", "own_id", "own_first"]
    dealt_out = ordered.filter("window IS NOT NULL")
    first = dealt_out.groupBy("window").agg(F.min(F.struct("own_id", "own_first")).alias("own"))
    merged = dealt_out.drop("own_id", "own_first").join(first, "window").select("h", "body", "wins", "k0", "k1", "own.own_id", "own.own_first")
    owned = single.unionByName(ordered.filter("window IS NULL").select(columns)).unionByName(merged)
    here = F.col("first") + F.col("k0")
    late = places.join(owned, ["h", "body", "wins"]).filter((F.col("own_id") < F.col("id")) | ((F.col("own_id") == F.col("id")) & (F.col("own_first") < here)))
    spans = late.select("id", "mark", here.alias("s"), (F.col("first") + F.col("k1") + (LENGTH - 1)).alias("e"))
    spans = written(spans.groupBy("id", "mark").agg(F.collect_set(F.struct("s", "e")).alias("found")), "suffix-spans")
    marked = maybe_among(rows, "id", spans.select("id"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    cut = marked.filter("__maybe").select("doc_id", "id", "mark", "text").join(spans, ["id", "mark"], "left").select(
        F.col("doc_id").alias("id"), "text", F.coalesce("found", none).alias("found")).mapInPandas(_cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    whole = marked.filter("NOT __maybe").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
                                                F.lit(0).cast("bigint").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return cut.unionByName(whole).withColumnRenamed("id", id_col)
