"""What a worker and a reader hold beside their rows stays small, and results do not depend on it."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("pagelens.llm")


def _texts(n, words, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{k}" for k in range(5000)])
    return [" ".join(vocabulary[rng.integers(0, 5000, words)]) for _ in range(n)]


def test_signatures_hold_little():
    from pagelens.llm import shingles
    from pagelens.llm.ngram_join import _signatures

    shingles._kept_powers.cache_clear()
    batches = [pd.DataFrame({"id": range(400), "text": _texts(400, 450, seed)}) for seed in range(3)]
    tracemalloc.start()
    try:
        for pdf in _signatures(5, (80, 100))(iter(batches)):
            assert len(pdf) == 400
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 16 << 20 and most < 40 << 20


def test_long_text_leaves_no_tables(monkeypatch):
    from pagelens.llm import shingles

    shingles._kept_powers.cache_clear()
    monkeypatch.setattr(shingles, "KEPT_POWERS", 1 << 19)
    list(shingles.shingle_sets([b"a bc " * 200_000], 3))
    assert shingles._kept_powers.cache_info().currsize == 0


def test_sets_do_not_depend_on_slices():
    from pagelens.llm.shingles import shingle_sets, sliced

    texts = ["", "One", "two words", *_texts(40, 300), *_texts(2, 200_000)]
    of = lambda limit: [s for bodies in sliced(texts, limit) for s in shingle_sets(bodies, 3)]
    for limit in (1, 1 << 18, 1 << 20):
        assert all(np.array_equal(a, b) for a, b in zip(of(limit), of(1 << 30), strict=True))


def test_exact_dedup_batches():
    from pagelens.llm.exact_dedup import _local, _merge

    texts = [t.encode() for t in _texts(900, 800)]
    parts = list(_local("max", 1 << 30)(iter([pd.DataFrame({"body": texts, "id": range(900)})])))
    assert sum(len(p) for p in parts) == 900
    assert max(p["body"].map(len).sum() for p in parts) < 2 << 20
    merged = pd.concat(parts).sort_values("body").assign(bucket=1)
    whole = list(_merge("max", 1 << 30)(iter([merged])))
    assert sum(len(p) for p in whole) == 900 and max(p["n_bytes"].sum() for p in whole) < 2 << 20


def test_readers_decode_few_rows(spark):
    import corpus_pipeline
    from pagelens.llm.common import DECODED_ROWS

    keys = ("spark.sql.parquet.columnarReaderBatchSize", "parquet.hadoop.vectored.io.enabled")
    for key in keys:
        spark.conf.unset(key)
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.mix(spark, docs, "")
    assert [spark.conf.get(k) for k in keys] == [DECODED_ROWS, "false"]
