"""Rows with null or repeated ids are rows of their own; inclusion probabilities of the mix; the lasting cache."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pagelens.llm.license_scan import license_scan
from pagelens.llm.mixing import pareto_mix
from pagelens.llm.token_counts import read_cache, token_counts
from pagelens.session import scratch_path

MIT = "Released under the MIT License."


def _ids(n):
    """A third of the ids null, a third one id, the rest distinct."""
    return [None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i for i in range(n)]


def test_licences_of_null_and_repeated_ids_are_not_shared(spark):
    rows = [(i, MIT if k % 2 else "nothing to see in this text here") for k, i in enumerate(_ids(60))]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "licenses").collect()
    assert Counter((r[0], r[1]) for r in got) == Counter((i, "mit" if t == MIT else "") for i, t in rows)


def test_mix_meets_its_target_with_null_and_repeated_ids(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(1, 20), "a" if k % 4 else "b") for k, i in enumerate(_ids(1500))]
    out = pareto_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = out.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 2 and out.count() == len(rows)
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 20


def test_mix_inclusion_frequencies(spark):
    """Over many seeds a document's share of copies meets its inclusion probability, certain ones always."""
    draw = random.Random(5)
    rows = [(k, "w " * (400 if k % 50 == 0 else draw.randint(1, 40)), "ab"[k % 2]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    runs, seen, chance, whole = 10, Counter(), {}, {}
    for seed in range(runs):
        for r in pareto_mix(docs, seed=seed, weights=(9.0, 1.0)).collect():
            chance[r["doc_id"]] = r["inclusion"]
            whole[r["doc_id"]] = int(r["target"] // r["source_size"])
            seen[r["doc_id"]] += r["copies"] - whole[r["doc_id"]]
    assert all(0 <= c <= 1 for c in chance.values())
    words = {k: len(t.split()) for k, t, _ in rows}
    # the words expected are the words left
    for s in "ab":
        ids = [k for k, _, x in rows if x == s]
        size = sum(words[k] for k in ids)
        total = sum(words.values())
        target = min(3 * size, total * (0.9 if s == "a" else 0.1))
        assert abs(sum(chance[k] * words[k] for k in ids) - (target - target // size * size)) < 1e-6 * total
    certain = [k for k in chance if chance[k] == 1]
    assert all(seen[k] == runs for k in certain)
    groups = {}
    for k, c in chance.items():
        groups.setdefault(round(c, 9), []).append(k)
    for c, ids in groups.items():
        n = runs * len(ids)
        # four standard deviations, and the shift of a sample whose size is in words
        assert abs(sum(seen[k] for k in ids) / n - c) <= 4 * (c * (1 - c) / n) ** 0.5 + 0.04, (c, len(ids))


def test_token_cache_is_used_and_ids_play_no_role(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", "one text"] + [f"text number {k % 40}" for k in range(117)]
    rows = list(zip(_ids(120), texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cache = scratch_path(spark, "cache-test")
    want = Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    for _ in range(2):
        got = token_counts(docs, path, cache).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        # the second run appends nothing
        stored = read_cache(spark, cache)
        assert stored.count() == len({t or "" for t in texts}) == stored.select("digest").distinct().count()
    more = spark.createDataFrame([(1, "one text"), (2, "a new text")], "doc_id long, text string")
    assert token_counts(more, path, cache).count() == 2 and read_cache(spark, cache).count() == len({t or "" for t in texts}) + 1
