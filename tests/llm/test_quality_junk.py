"""Quality rules where much of one language and source is junk of one kind."""

import random

import pytest

pytest.importorskip("pagelens.llm")

SCHEMA = "doc_id bigint, text string, lang string, source string"


def test_forty_percent_junk(spark):
    from pagelens.llm.quality import quality_rules

    rng = random.Random(12)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 200))) for _ in range(180)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:120]]
    rows = quality_rules(spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], SCHEMA)).collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert not any(k in kept for k in range(180, 300))
    assert len(kept) >= 178
