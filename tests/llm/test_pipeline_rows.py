"""Pipeline stages on null and repeated ids: decisions and copies hold for single rows."""

import collections
import random

import pytest

pytest.importorskip("pagelens.llm")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COMMON = [f"c{k}" for k in range(60)]


def prose(rng, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def run(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA).repartition(3)
    return collections.Counter((r.doc_id, r.text) for r in stage(spark, docs, "").collect())


@pytest.fixture()
def texts():
    rng = random.Random(11)
    return [prose(rng) for _ in range(60)]


def test_quality_rows(spark, texts):
    import corpus_pipeline

    rows = [(None if k % 3 else 7, t, "a") for k, t in enumerate(texts)]
    assert run(spark, corpus_pipeline.quality, rows + [(None, "too short", "a"), (7, "a b", "a")]) == collections.Counter((i, t) for i, t, _ in rows)


def test_exact_rows(spark, texts):
    import corpus_pipeline

    a, b, c, d = texts[:4]
    rows = [(None, a), (5, a), (5, a), (3, a), (None, b), (None, b.upper()), (5, c), (None, d), (9, None), (None, "")]
    got = run(spark, corpus_pipeline.exact, [(i, t, "s") for i, t in rows])
    kept_b = [k for k in got if k[1] in (b, b.upper())]
    assert len(kept_b) == 1 and got.pop(kept_b[0]) == 1
    assert got == collections.Counter([(5, a), (5, c), (None, d), (9, None)])


def test_near_rows(spark, texts):
    import corpus_pipeline

    a, b, c = texts[:3]
    rows = [(None, a + " x1"), (4, a + " x2"), (2, a + " x3"), (2, a + " x3"), (None, b + " x1"), (None, b + " x2"), (2, c), (None, texts[4]), (None, None)]
    got = run(spark, corpus_pipeline.near, [(i, t, "s") for i, t in rows])
    kept_b = [k for k in got if k[1] and k[1].startswith(b)]
    assert len(kept_b) == 1 and got.pop(kept_b[0]) == 1
    assert got == collections.Counter([(2, a + " x3"), (2, c), (None, texts[4]), (None, None)])


def test_mix_rows(spark, texts):
    import corpus_pipeline

    rows = [(None, t, "a") for t in texts[:20]] + [(1, t, "b") for t in texts[20:50]] + [(1, texts[50], "c")] * 10
    got = run(spark, corpus_pipeline.mix, rows)
    size, taken = collections.Counter(), collections.Counter()
    source = {t: s for _, t, s in rows}
    for _, t, s in rows:
        size[s] += len(t.split())
    for (_, t), n in got.items():
        taken[source[t]] += n * len(t.split())
    total, left = sum(size.values()), {}
    share = {s: total * w / 8 for s, w in {"a": 5, "b": 2, "c": 1}.items()}
    if share["a"] > 3 * size["a"]:
        share = {"a": 3 * size["a"], **{s: (total - 3 * size["a"]) * w / 3 for s, w in {"b": 2, "c": 1}.items()}}
    assert all(abs(taken[s] - share[s]) <= 60 for s in size), (taken, share, left)
    assert all(n <= 3 for (_, t), n in got.items() if source[t] != "c")
