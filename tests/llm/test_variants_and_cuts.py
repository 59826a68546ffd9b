"""Fill-in-middle, spelling variants and toxicity against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pagelens.llm")

from tests.llm.test_llm import table, words  # noqa: E402


@pytest.mark.parametrize("block", [1, 3, 64, 512])
def test_fenwick_cuts(block):
    from pagelens.llm.fim import cuts

    rng = random.Random(block)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "Z", " ", "é", "\n", "😀", "中", "9", "xyzzy" * 20]) for _ in range(rng.randrange(60)))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h1, h2 = rng.randrange(1 << 32), rng.randrange(1 << 32)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        assert cuts(np.frombuffer(text.encode(), np.uint8), h1, h2, block) == (len(units), len("".join(units[:a])), len("".join(units[:b])))


def test_fill_in_middle(spark):
    from pagelens.llm.fim import fill_in_middle, restored

    rng = random.Random(3)
    texts = [None, "", "a", "<P>", "x <S> y", "end <M>", "<", "<<S", "P>", "é" * 3000, "ab " * 200_000, "😀 é ñ\n" * 50] + [" ".join(words(rng, rng.randrange(1, 80))) + rng.choice(["<", "<P", ">", ""]) for _ in range(150)]
    ids = list(range(len(texts))) + [None, None, 5, 5]
    texts += ["null id one", None, "again", "again"]
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim_text, r.back) for r in
                              fill_in_middle(table(spark, texts, ids=ids)).withColumn("back", restored(F.col("fim_text"), F.col("form"))).collect())
    want = collections.Counter()
    for i, text in zip(ids, texts):
        text = text or ""
        d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
        u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want[(i, len(u), "plain", None, None, text, text)] += 1
        elif h[3] % 100 < 20:
            want[(i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)] += 1
        else:
            want[(i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)] += 1
    assert got == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    assert fill_in_middle(table(spark, [])).count() == 0


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(ids, texts, every=97, least_chars=5, least_n=3):
    count = collections.Counter()
    for i, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    v = {w: n for w, n in count.items() if n >= least_n and len(w) >= least_chars}
    near = {w: [x for x in v if x != w and one_edit(w, x)] for w in v}
    best = {w: min(near[w], key=lambda x: (-v[x], x)) if near[w] else None for w in v}
    form = {w: b if b and v[b] >= 2 * v[w] else None for w, b in best.items()}
    root = {}
    for w in v:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {w: (v[w], len(near[w]), form[w], v.get(form[w]), root[w]) for w in v}


@pytest.mark.parametrize("every", [97, 3])
def test_spelling_variants(spark, every):
    from pagelens.llm.spelling import spelling_variants

    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "ÀÉÎÕÜ", "x" * 3000, "x" * 3001]
    texts = [None, "", "12 34", "AAAAA aaaaa"]
    for _ in range(250):
        line = []
        for _ in range(rng.randrange(1, 25)):
            w = rng.choice(stems[:rng.randrange(1, len(stems) + 1)])
            if rng.random() < 0.3 and len(w) < 100:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcdé") + w[k:], w[:k] + rng.choice("abcdé") + w[k + 1:]])
            line.append(w if rng.random() < 0.8 else w.upper())
        texts.append(rng.choice([" ", ", ", "-", "\n"]).join(line))
    ids = [rng.choice([None, 7, k, k]) for k in range(len(texts))]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants(table(spark, texts, ids=ids), every=every).collect()}
    want = variants_by_hand(ids, texts, every)
    assert got == want
    assert sum(1 for x in want.values() if x[2]) > 20 and max(x[1] for x in want.values()) > 3
    assert spelling_variants(table(spark, [])).count() == 0


def test_reduced_alphabet_loses_no_pair(spark):
    """Whatever the alphabet's size, every pair one edit apart is met once."""
    from pagelens.llm.spelling import near_pairs

    rng = random.Random(2)
    v = sorted({"".join(rng.choice("abcñ") for _ in range(rng.randrange(4, 7))) for _ in range(700)})
    want = collections.Counter(frozenset((a, b)) for i, a in enumerate(v) for b in v[i + 1:] if one_edit(a, b))
    words_df = spark.createDataFrame([(w, 3) for w in v], "word string, n bigint").cache()
    for n_words in (1, 50, 700, 10**9):
        assert collections.Counter(frozenset((r.a, r.b)) for r in near_pairs(words_df, n_words).collect()) == want


def test_block_max_neighbours_are_exact():
    from pagelens.llm.toxicity import BlockMaxIndex

    rng = np.random.default_rng(4)
    dense = np.where(rng.random((700, 40)) < 0.08, rng.integers(1, 4, (700, 40)), 0).astype(float)
    dense[50:120] = dense[50]
    dense = dense[np.lexsort(dense.T)]
    norm = np.sqrt((dense ** 2).sum(axis=1))
    dense = np.divide(dense, norm[:, None], where=norm[:, None] > 0, out=np.zeros_like(dense))
    index = BlockMaxIndex([(np.flatnonzero(v), v[v > 0]) for v in dense], 40, block=16)
    opened = 0
    for i in range(0, 700, 7):
        sims = np.round(dense @ dense[i], 12)
        for skip in (-1, i):
            order = [j for j in np.lexsort((np.arange(700), -sims)) if sims[j] > 0 and j != skip][:9]
            at, found, n = index.nearest(np.flatnonzero(dense[i]), dense[i][dense[i] > 0], 9, skip)
            opened += n
            assert np.allclose(found, sims[order], atol=1e-9)
            # places are compared where similarities differ by more than rounding
            assert set(at[found > found[-1] + 1e-9] if len(at) else []) == {j for j in order if sims[j] > found[-1] + 1e-9}
    assert opened < 0.8 * 200 * index.n_blocks


def test_isotonic():
    from pagelens.llm.toxicity import isotonic

    at, mean = isotonic(np.array([0.1, 0.2, 0.2, 0.5, 0.7, 0.9]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert list(at) == [0.1, 0.2, 0.7] and np.allclose(mean, [0, 1 / 3, 1])


def test_toxicity(spark):
    from pagelens.llm.toxicity import toxicity

    rng = random.Random(8)
    insults = ["zorgface", "plonker", "nitwit", "lowequ"]
    texts, toxic = [], []
    for i in range(900):
        bad = rng.random() < 0.15
        w = words(rng, rng.randrange(5, 120), 400)
        if bad:
            for _ in range(rng.randrange(2, 5)):
                x = rng.choice(insults)
                w.insert(rng.randrange(len(w)), x + rng.choice(["", "chen", "ei"]) if x == "lowequ" else x.upper() if rng.random() < 0.3 else x)
        texts.append(" ".join(w))
        toxic.append(int(bad))
    texts += [None, "", "plonker nitwit", texts[0], "fine words", "zorgface " * 40_000]
    ids = list(range(900)) + [900, 901, None, 0, 903, 904]
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(0, toxic[0], 1), (None, 1, 1), (5, None, 0), (5, toxic[5], 0)], "doc_id bigint, toxic int, text int")
    docs = table(spark, texts, ids=ids)
    rows = toxicity(docs, labels).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(ids)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, r in by.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [i for i in range(900) if by[i].held_out]
    assert sum(by[i].predicted == toxic[i] for i in test) >= 0.97 * len(test)
    assert all(by[i].predicted for i in test if toxic[i] and texts[i].lower().count("zorgface") > 1)
    none = next(r for r in rows if r.doc_id is None)
    assert none.predicted == 1 and none.held_out and by[904].predicted == 1 and by[900].score == by[901].score < 0.5
    assert all(e is None or zlib.crc32(str(e).encode()) % 5 for r in rows for e in r.examples)
    again = {(r.doc_id, r.score) for r in toxicity(docs.repartition(7), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}
    # no labels, one class only, empty tables
    empty = labels.limit(0)
    assert {r.score for r in toxicity(docs.limit(5), empty).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).count() == 0
    assert toxicity(docs, labels.withColumn("toxic", F.lit(1))).filter("score < 0.5").count() == 0
