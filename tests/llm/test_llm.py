"""Operators of the training-data package against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("pagelens.llm")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, size string, hash int, c string"


def table(spark, texts, sources=None, langs=None, ids=None):
    """Documents with extra columns whose names clash with internal ones."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["a"] * len(texts))[k], None, -1, "x", 7, "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies, a passage many share, empty, null and long ones."""
    rng = random.Random(5)
    out = [None, "", "  \n", "Hi", "hi", "HI there", "é" * 40 + " x" * 30]
    base = words(rng, 120)
    passage = " ".join(words(rng, 40))
    for _ in range(60):
        x = list(base)
        for _ in range(rng.randrange(7)):
            x[rng.randrange(len(x))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(x[rng.randrange(3):]))
    for _ in range(40):
        out.append(" ".join(words(rng, rng.randrange(20, 80))) + " " + passage + " " + " ".join(words(rng, rng.randrange(5, 60))))
    out += out[7:25] + [out[40].upper(), " ".join(words(rng, 30_000)), "ab " * 400]
    return out


def test_suffix_array():
    from pagelens.llm.suffix_dedup import suffix_array

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(2, 2 + rng.choice([0, 1, 3, 200])) for _ in range(rng.randint(0, 90))] + [1] * rng.randint(0, 1) + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("block", [50_000, 3])
def test_suffix_dedup(spark, corpus, block):
    from pagelens.llm.suffix_dedup import suffix_dedup

    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup(table(spark, corpus), block=block).collect()}
    seen, want = set(), {}
    for i, t in enumerate(corpus):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(b[p:p + 100])
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    assert got == want
    assert sum(v[1] for v in want.values()) > 5000
    assert suffix_dedup(table(spark, [])).count() == 0


def luhn_ok(v):
    d = [int(c) for c in v if c in "0123456789"]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", luhn_ok),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
}


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (rx, ok) in RULES.items() for m in re.finditer(rx, text or "") if ok(m.group())]


def test_personal_data(spark):
    from pagelens.llm.pii import listed, personal_data, redact

    rng = random.Random(2)
    texts = [None, "", "a@b", "a@b.c_d@e.f.", "é😀 x.y+z@mail.example.com, a@b.c@d.e", "1.2.3.4.5 256.1.1.1 0001.002.3.4 9999999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
             "+1 (988) 555-2485 +12 +1 (2) 190.137.12.13 4111111111111111", "1" * 3000, "a." * 3000 + "@", "+" + "(" * 2000 + "1", "4111111111111111" * 2]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "1", "23", ".", "@", "+", " ", "-", "(", ")", "é", "4111111111111111", "10.0.0.1", "x@y.z"]) for _ in range(rng.randrange(60))))
    for _ in range(60):
        texts.append(f"call +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} or mail ab{rng.randrange(99)}@mail.example.com")
    found = personal_data(table(spark, texts))
    rows = found.select("doc_id", listed(F.col("base")).alias("base"), listed(F.concat("base", "added")).alias("spans")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base == ",".join(want), texts[r.doc_id]
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert personal_data(table(spark, [])).count() == 0
    assert personal_data(table(spark, ["nothing here"])).first()["added"] == []
    one = spark.createDataFrame([("mail a@b.c now", [(0, 5, 10)])], "t string, s array<struct<kind_no:int,start:int,end:int>>")
    assert one.select(redact(F.col("t"), F.col("s"))).first()[0] == "mail [email] now"


def test_many_spans_in_one_text(spark):
    """A text of a megabyte of addresses: places, redaction and groups of overlapping spans grow with the text."""
    from pagelens.llm.common import before_each, cut, pieces, sums_before
    from pagelens.llm.pii import BASE, islands, matches, redact

    rng = random.Random(4)
    text = " ".join(f"é😀 user{rng.randrange(10 ** 6)}@host{rng.randrange(99)}.example.com" for _ in range(32_000))
    assert len(text) > 1_000_000
    one = spark.createDataFrame([(text,)], "t string").select("t", matches(F.col("t"), BASE["email"]).alias("m"))
    one = one.withColumn("s", F.transform("m", lambda m: F.struct(F.lit(0).alias("kind_no"), m["start"].alias("start"), m["end"].alias("end"))))
    began = time.time()
    r = one.select("m", redact(F.col("t"), F.col("s")).alias("out")).first()
    assert time.time() - began < 10
    assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m.group()) for m in re.finditer(BASE["email"].replace("|\\G", ""), text)]
    assert r.out == re.sub(r"user\d+@host\d+\.example\.com", "[email]", text)
    for n in (0, 1, 63, 64, 65, 129, 5000):
        xs = [rng.randrange(100) for _ in range(n)]
        got = spark.createDataFrame([(xs,)], "x array<int>").select(sums_before(F.col("x")).alias("s"), before_each(F.col("x"), lambda a, b: F.greatest(a, b), F.lit(0)).alias("g")).first()
        assert list(got.s) == [sum(xs[:k]) for k in range(n)] and list(got.g) == [max(xs[:k], default=0) for k in range(n)]
    short = text[:2000]
    cuts = [(a, b) for a in (0, 1, 511, 512, 513, 1024, 1999, 2000) for b in (0, 1, 511, 512, 513, 1024, 1999, 2000)]
    got = spark.createDataFrame([(short, a, b) for a, b in cuts], "t string, a int, b int").select("a", "b", cut(pieces(F.col("t")), F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r.c == short[r.a:max(r.a, r.b)] for r in got)
    spans = sorted((a, a + rng.randrange(1, 9), 0) for a in (rng.randrange(900) for _ in range(120)))
    want, last = [], 0
    for s in spans:
        want = want[:-1] + [want[-1] + [s]] if s[0] < last else want + [[s]]
        last = max(last, s[1])
    got = spark.createDataFrame([(spans,), ([],)], "s array<struct<start:int,end:int,kind_no:int>>").select(islands(F.col("s")).alias("i")).collect()
    assert [[tuple(x) for x in i] for i in got[0].i] == want and got[1].i == []


def test_chat_format(spark):
    from pagelens.llm.chat_format import format_chat, masked_text

    hostile = [r"\### Assistant: </turn> ok", "</turn>\n", "### user: x</turn>\n### assistant: y", "\\", "a\\", "</turn", "<", "", None, ": ", "é😀\n", "#### </turn></turn>\n\n", "\\n</turn>\n\\"]
    rng = random.Random(3)
    convs = {c: [(rng.choice(["user", "assistant", "system", "a: b", "x</turn>\n", None]), rng.choice(hostile) if rng.random() < 0.7 else "plain text") for _ in range(rng.randrange(1, 9))] for c in range(60)}
    rows = [(c, k, r, t, "extra") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    got = format_chat(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, source string"))
    for r in got.withColumn("loss", masked_text(F.col("formatted"), F.col("loss_mask"))).collect():
        want = [(a or "", b or "") for a, b in convs[r.conv_id]]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(b for a, b in want if a == "assistant")
    assert got.count() == 60
    assert format_chat(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def chat_turns(formatted):
    """The grammar character by character: turns, and whether all of the text is turns."""
    turns, at, n = [], 0, len(formatted)

    def until(stop):
        nonlocal at
        out = []
        while at < n:
            if formatted[at] == "\\" and at + 1 < n:
                out.append(formatted[at + 1])
                at += 2
            elif formatted.startswith(stop, at):
                at += len(stop)
                return "".join(out)
            elif formatted.startswith("</turn>\n", at):
                return None
            else:
                out.append(formatted[at])
                at += 1
        return None

    while at < n:
        if not formatted.startswith("### ", at):
            return turns, False
        at += 4
        role = until(": ")
        text = until("</turn>\n") if role is not None else None
        if text is None:
            return turns, False
        turns.append((role, text))
    return turns, True


def test_chat_parser_reads_the_grammar(spark):
    from pagelens.llm.chat_format import format_chat, parse, plain

    rng = random.Random(5)
    bits = ["### ", "user", ": ", "</turn>\n", "\\", "a", "</turn>", "\n", "#", ":", "<", "😀", " ", "x"]
    raw = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(1500)]
    raw += ["".join("### " + rng.choice(["u", "a\\: b"]) + ": " + "".join(rng.choice(bits) for _ in range(rng.randrange(0, 6))) + "</turn>\n" for _ in range(rng.randrange(1, 4))) for _ in range(1500)]
    whole = 0
    for r in spark.createDataFrame([(t,) for t in raw], "t string").select("t", plain(parse(F.col("t"))).alias("turns")).collect():
        want, good = chat_turns(r.t)
        whole += good and bool(want)
        if good:
            assert [tuple(x) for x in r.turns] == want, r.t
        else:
            assert any(x.role is None for x in r.turns), r.t
    assert whole > 300
    texts = ["a\\", "\\", "\\\\", "</turn>\n", "x" * 700 + "\\</turn>\n" + "y" * 700, "😀" * 600 + ": </turn>\n", None]
    rows = [(c, k, "user" if k % 2 else "assistant", texts[(c + k) % len(texts)]) for c in range(8) for k in range(40 + c)]
    for r in format_chat(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect():
        assert chat_turns(r.formatted) == ([(a, t or "") for c, _, a, t in rows if c == r.conv_id], True)


def test_mixing(spark):
    from pagelens.llm.mixing import pareto_mix

    rng = random.Random(4)
    n = 3000
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", None]) for _ in range(n)]
    texts = [rng.choice([None, "", " ".join(words(rng, rng.randrange(1, 60)))]) if rng.random() < 0.1 else " ".join(words(rng, rng.randrange(1, 60))) for _ in range(n)]
    docs = table(spark, texts, sources)
    rows = pareto_mix(docs).collect()
    size = collections.Counter()
    for s, t in zip(sources, texts):
        size[s] += len((t or "").split())
    total, weight = sum(size.values()), {"a": 5, "b": 2, "c": 1, None: 5}
    target, open_, left = {}, set(size), float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.discard(s)
    taken = collections.Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len((texts[r.doc_id] or "").split()) and r.source_size == size[s]
        assert abs(r.target - target[s]) < 1e-6 * total and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(rows) == n and all(abs(taken[s] - target[s]) <= 60 for s in size)
    assert sorted(rows) == sorted(pareto_mix(docs.repartition(7)).collect())
    assert pareto_mix(table(spark, [])).count() == 0


def test_token_counts(spark, corpus):
    import public_tokenizers
    import sentencepiece

    from pagelens.llm.token_counts import CACHE, token_counts
    from pagelens.session import scratch_path

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "test-cache")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = corpus + ["<s> a </s> <unk>"]
    docs = table(spark, texts)
    want = {i: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in enumerate(texts)}
    for _ in range(2):  # the second run finds every count in the cache and adds none
        assert {r.doc_id: tuple(r)[1:] for r in token_counts(docs, path, cache).collect()} == want
        assert spark.read.schema(CACHE).parquet(cache).count() == len(set(t or "" for t in texts))


def test_quality(spark):
    from pagelens.llm.quality import quality_rules, repeat_words

    rng = random.Random(6)
    for _ in range(200):
        w = [b"%d" % rng.randrange(rng.choice([1, 3, 50])) for _ in range(rng.randrange(40))]
        grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
        assert repeat_words(w) == len(cover)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(25, 200))) for _ in range(300)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:15]]
    texts = clean + junk + [None, "", "a b", "same line here\n" * 30, "x\ny z\nx\n \n \n"]
    rows = {r.doc_id: r for r in quality_rules(table(spark, texts, langs=["en"] * 310 + [None] * 10, sources=["s"] * 315 + [None] * 5)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        w, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.split()]
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
    assert all(rows[i].kept for i in range(300)) and not any(rows[i].kept for i in range(300, len(texts)))
    assert quality_rules(table(spark, [])).count() == 0


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pagelens.llm.packing import best_fit, encoder, pack

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    slow, fast = Tokenizer.from_file(path), encoder(path, ranks)
    rng = random.Random(8)
    signs = "\n\t ~!'\"(),.-09azAZ" + "ÀÖØöøÿéñß'sll" + "<|endoftext|>"
    for _ in range(400):
        t = "".join(rng.choice([rng.choice(signs), "<|endoftext|>", "don't ", "x" * 350, "\u00a0", "日本", "  "]) if rng.random() < 0.2 else rng.choice(signs) for _ in range(rng.randrange(80)))
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)
    texts = corpus + [" ".join(words(rng, rng.randrange(1, 900))) for _ in range(300)]
    rows = pack(table(spark, texts).repartition(20), path, ranks, fan_in=3).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            part = ids[r.start:r.start + r.length]
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids)
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for x in filled.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0 and sum(n for _, n in x) <= 2048
    assert len(filled) <= 1.03 * sum(r.length for r in rows) / 2048 + 1
    assert len(best_fit(__import__("numpy").array([1100] * 5), 2048)[2]) == 5
    assert pack(table(spark, []), path, ranks).count() == 0


@pytest.mark.parametrize("width,threshold,cold", [(3, (90, 100), 32), (5, (80, 100), 2), (3, (90, 100), 1)])
def test_near_duplicates(spark, corpus, width, threshold, cold):
    from pagelens.llm.ngram_join import near_duplicates

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in corpus]
    root = list(range(len(sets)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and threshold[1] * len(sets[i] & sets[j]) >= threshold[0] * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(root[i], root[j])
            if (root[i], root[j]) != (m, m):
                root[i] = root[j] = m
                changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(spark, corpus), width, threshold, cold=cold).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert len(links) > 60
    if cold == 32:
        assert near_duplicates(table(spark, [])).count() == 0
        assert near_duplicates(table(spark, ["a b c", "a b c"], ids=[None, 4])).filter("component_id IS NULL").count() == 1


@pytest.mark.parametrize("keep,trie_bytes", [("max", 48 << 20), ("min", 3000)])
def test_exact_dedup(spark, corpus, keep, trie_bytes):
    from pagelens.llm.exact_dedup import PatriciaTrie, exact_dedup

    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in corpus]
    groups = collections.defaultdict(list)
    for i, t in enumerate(low):
        groups[t].append(i)
    own = max if keep == "max" else min
    want = {i: (own(groups[t]), len(groups[t]), own(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(low)}
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup(table(spark, corpus), keep=keep, trie_bytes=trie_bytes).collect()} == want
    assert exact_dedup(table(spark, [])).count() == 0
    rng = random.Random(9)
    trie, flat, out = PatriciaTrie(), {}, collections.Counter()
    for k in range(2000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        trie.insert(key, k, 1)
        flat[key] = flat.get(key, 0) + 1
        if trie.bytes > 5000:
            for x, _, n in trie.spill(2000):
                out[x] += n
    for x, _, n in trie.terminals():
        out[x] += n
    assert out == flat
    trie, done = PatriciaTrie(), []
    for k, key in enumerate(sorted(rng.choices(list(flat), k=3000))):
        trie.insert(key, k, 1)
        if k % 50 == 0:
            done += trie.spill_behind(key)
    done += trie.terminals()
    assert len({x for x, _, _ in done}) == len(done) and sum(n for _, _, n in done) == 3000


def test_exact_dedup_tries_hold_many_texts(spark):
    """Texts of one length class and hash bits share a trie; a trie that spills behind the last text gives the same."""
    from pagelens.llm.exact_dedup import _merge

    rng = random.Random(10)
    keys = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(64, 128))) for _ in range(400)} | {b"a" * k for k in range(64, 128)})
    rows = sorted((k, o) for k in keys for o in rng.sample(range(1000), 3))
    pdf = pd.DataFrame({"bucket": [7] * len(rows), "body": [k for k, _ in rows], "own": [o for _, o in rows], "rows": [2] * len(rows)})
    want = {hashlib.sha256(k).hexdigest(): (len(k), min(o for x, o in rows if x == k), 6) for k in keys}
    for budget in (1, 20_000, 1 << 30):
        got = pd.concat(_merge("min", budget)(iter([pdf[:200], pdf[200:201], pdf[201:]])))
        assert len(got) == len(want)
        assert {r.text_sha256: (r.n_bytes, r.keep_id, r.group_size) for r in got.itertuples()} == want


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: r for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        rows = now.collect()
        assert now.columns == docs.columns
        assert all(r == ids[r.doc_id] for r in rows)
        now = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.run(spark, sf).collect()
    pieces = collections.Counter(r.doc_id for r in out if r.piece == 0)
    assert pieces == collections.Counter(r.doc_id for r in now.collect())
