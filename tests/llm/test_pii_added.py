"""Spans the boosted trees add: written-out addresses and dotted quads with blanks."""

import random

import pytest

pytest.importorskip("pagelens.llm")


def test_added_spans_of_generators(spark):
    from pagelens.llm.pii import listed, personal_data
    from pyspark.sql import functions as F

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("bcdefghklm") for _ in range(rng.randrange(3, 8)))
    texts = []
    for k in range(600):
        a, b = word(), word()
        quad = [str(rng.randrange(1, 255)) for _ in range(4)]
        texts.append([f"mail {a}@{b}.com now", f"mail {a} (at) {b} dot com now", f"mail {a} at {b}.com now", f"server {'.'.join(quad)} is up", f"server {' . '.join(quad)} is up",
                      f"we stay at {b}. {a.title()} came", f"we met at {rng.randrange(1, 12)}.30 and left", f"numbers 999 . {rng.randrange(300, 999)} . 1 . 2 here", f"{a} {b} {a}"][k % 9])
    rows = {r.doc_id: r.added for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).select("doc_id", listed(F.col("added")).alias("added")).collect()}
    for k, t in enumerate(texts):
        if k % 9 in (1, 2):
            assert rows[k] == f"email:5:{len(t) - 4}", t
        elif k % 9 == 4:
            assert rows[k] == f"ip:7:{len(t) - 6}", t
        else:
            assert rows[k] == "", t
