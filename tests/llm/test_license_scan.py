"""Licence notices inside lines and across line breaks, against brute force over all windows."""

import random
import re
import textwrap

import pytest

pytest.importorskip("pagelens.llm")

SCHEMA = "doc_id bigint, text string"


def words_of(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def grams(w):
    return set(zip(w, w[1:]))


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_inline_and_wrapped_notices(spark):
    from pagelens.llm.license_scan import TEMPLATES, license_scan

    mit = next(b for a, b in TEMPLATES if a == "mit" and len(b) > 100)
    gpl = "This work is licensed under the GNU General Public License, version 3."
    texts = ["Copyright (c) 2020 Foo. All rights reserved.", "This file is licensed under the MIT License.", textwrap.fill(mit, 80),
             "Some words before. " + "\n * ".join(textwrap.wrap("more of them here " + mit + " and after", 40)), f"See below for terms {gpl} Bye now", None, "", "all rights",
             "Words here. All rights\n# reserved. Words and words there, released under the MIT\n# License, and again words."]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    # the whole text of 3 matches as well as the better window in it, which is a unit of its own
    assert [(got[i].n_matches, got[i].license, got[i].best) for i in range(len(texts))] == [
        (1, "proprietary", "proprietary"), (1, "mit", "mit"), (1, "mit", "mit"), (2, "mit", "mit"), (1, "gpl-3.0", "gpl-3.0"), (0, None, ""), (0, None, ""), (0, None, ""),
        (2, "proprietary", "mit,proprietary")]
    assert all(got[i].dice == 1.0 for i in (0, 1, 2, 3, 4, 8))


def test_windows_against_brute_force(spark):
    from pagelens.llm.license_scan import TEMPLATES, TEXTS, license_scan

    rng = random.Random(7)
    known = [(a, grams(words_of(b))) for a, b in TEMPLATES + TEXTS]
    texts = []
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(1, 3)):
            t = words_of(rng.choice(TEMPLATES + TEXTS)[1])[:40]
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(t))
                t[k:k + rng.randrange(2)] = rng.choice([[], ["the"], ["x"], ["license", "of"]])
                t = t or ["x"]
            w += [rng.choice(["the", "license", "of", "a", "under"]) for _ in range(rng.randrange(6))] + t
        texts.append("".join(x + rng.choice([" ", ", ", "\n", "\n// "]) for x in w))
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    hit = 0
    for i, t in enumerate(texts):
        w, best = words_of(t), 0.0
        for a in range(len(w)):
            seen = set()
            for b in range(a + 1, len(w)):
                seen.add((w[b - 1], w[b]))
                best = max(best, max(dice(seen, g) if b - a <= len(g) * 3 // 2 else 0.0 for _, g in known))
        if best >= 0.8:
            hit += 1
            assert got[i].n_matches and got[i].dice == pytest.approx(best), t
        else:
            assert got[i].dice is None or got[i].dice < 1.0, t
    assert hit > 60
