import random
import re

import numpy as np
import pytest

from driftnet.llm import leakage as L

GOLD = "work string, text string, method_named string"
DOCS = "doc_id bigint, text string, work string, ids int, start int"


def brute(docs, gold, n=12):
    w = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = {}
    for g, t in gold:
        s = w(t or "")
        for i in range(len(s) - n + 1):
            grams.setdefault(tuple(s[i : i + n]), set()).add(g)
    out = set()
    for d, t in docs:
        s = w(t or "")
        for i in range(len(s) - n + 1):
            out |= {(d, g) for g in grams.get(tuple(s[i : i + n]), ())}
    return out


def corpus(seed, texts=40, docs=150):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(120)]
    rare = [f"r{i}x" for i in range(900)]
    say = lambda n: [rnd.choice(common) if rnd.random() < 0.8 else rnd.choice(rare) for _ in range(n)]
    gold = [(f"W{i}", say(rnd.randrange(30, 100))) for i in range(texts)]
    out = []
    for d in range(docs):
        words = say(rnd.randrange(20, 300))
        if rnd.random() < 0.5:
            g = rnd.choice(gold)[1]
            n = rnd.choice([11, 12, 12, 13, 20, len(g)])
            a = rnd.randrange(0, max(1, len(g) - n))
            at = rnd.randrange(len(words))
            words = words[:at] + g[a : a + n] + words[at:]
        out.append((d, rnd.choice([" ", "  ", ", ", "\n"]).join(words).title()))
    return out, [(g, " ".join(s)) for g, s in gold]


def found(spark, docs, gold, **kw):
    d = spark.createDataFrame([(i, t, "W", 1, 1) for i, t in docs], DOCS).repartition(3)
    g = spark.createDataFrame([(w, t, None) for w, t in gold], GOLD)
    return L.leaks(d, g, **kw)


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_against_all_word_runs(spark, seed):
    docs, gold = corpus(seed)
    got = {(r["doc_id"], r["work"]) for r in found(spark, docs, gold).filter("run >= 12").collect()}
    want = brute(docs, gold)
    assert got <= want
    assert len(got) >= 0.98 * len(want) and len(want) > 30


def test_blocks_of_evaluation_texts_give_the_same(spark):
    docs, gold = corpus(3, texts=20, docs=60)
    one = {(r["doc_id"], r["work"], r["run"]) for r in found(spark, docs, gold).collect()}
    for how in ({"block_chars": 2000}, {"block_chars": 2000, "scan_chars": 5000}):
        several = {(r["doc_id"], r["work"], r["run"]) for r in found(spark, docs, gold, **how).collect()}
        assert {x for x in one if x[2] >= 12} == {x for x in several if x[2] >= 12}


def test_paraphrase_and_answer(spark):
    g = [f"term{i}" for i in range(40)]
    changed = [w if i % 8 else "other" for i, w in enumerate(g)]
    docs = [(1, " ".join(changed)), (2, " ".join(g[::-1])), (3, None), (4, "")]
    gold = spark.createDataFrame([("W1", " ".join(g), "Term7 term9"), ("W2", "", None), (None, None, None)], GOLD)
    d = spark.createDataFrame([(i, t, "", 1, 1) for i, t in docs], DOCS)
    rows = L.leaks(d, gold).collect()
    assert [(r["doc_id"], r["work"], r["run"], r["answer"]) for r in rows] == [(1, "W1", 7, False)]
    assert rows[0]["lcs"] >= 20


def test_planted_paraphrases_at_the_defaults(spark):
    rnd = random.Random(11)
    _, gold = corpus(5, texts=30, docs=1)
    other = [f"zz{i}" for i in range(500)]
    docs, want = [], set()
    for d in range(60):
        words = [rnd.choice(other) for _ in range(rnd.randrange(10, 200))]
        if d % 2:
            work, text = rnd.choice(gold)
            own = text.split()[:30]
            changed = [w if i % 8 else rnd.choice(other) for i, w in enumerate(own)]  # no run of 8 words is left
            at = rnd.randrange(len(words))
            words = words[:at] + changed + words[at:]
            want |= {(d, work)} if len(own) == 30 else set()
        docs.append((d, " ".join(words)))
    rows = found(spark, docs, gold).collect()
    got = {(r["doc_id"], r["work"]) for r in rows}
    assert len(want) > 20 and want <= got and all(d % 2 for d, _ in got)
    assert all(r["run"] < 12 and r["lcs"] >= 18 for r in rows if (r["doc_id"], r["work"]) in want)


def test_shortest_runs_amid_other_evaluation_words(spark):
    rnd = random.Random(12)
    _, gold = corpus(6, texts=40, docs=1)
    every = sorted({w for _, t in gold for w in t.split()})
    docs = []
    for d in range(400):
        words, g = [rnd.choice(every) for _ in range(40)], rnd.choice(gold)[1].split()
        a, at = rnd.randrange(len(g) - 11), rnd.randrange(41)
        docs.append((d, " ".join(words[:at] + g[a : a + 12] + words[at:])))
    want = brute(docs, gold)
    got = {(r["doc_id"], r["work"]) for r in found(spark, docs, gold, gap=0).filter("run >= 12").collect()}
    print("shortest runs", len(got), len(want))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_lists_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 40))
    x = centres[rng.integers(0, 12, 900)] + 0.3 * rng.standard_normal((900, 40))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q = np.vstack([x[::9], np.zeros((1, 40), dtype=np.float32)])
    found_ = L._Lists(x).search(q, 0.8)
    want = set(zip(*(z.tolist() for z in np.nonzero(q @ x.T >= 0.8))))
    assert set(zip(found_[0].tolist(), found_[1].tolist())) == want


def test_edges(spark):
    docs, gold = corpus(4, texts=5, docs=5)
    assert found(spark, [], gold).count() == 0
    assert found(spark, docs, []).count() == 0
    assert found(spark, [(1, gold[0][1])] * 3, [gold[0], gold[0]]).select("doc_id", "work").collect() == [(1, gold[0][0])]
    long = " ".join(f"x{i}" for i in range(30_000)) + " " + gold[1][1]
    assert [r["work"] for r in found(spark, [(1, long)], gold).filter("run >= 12").collect()] == [gold[1][0]]


def test_subsequence_and_run():
    rnd = random.Random(0)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(1, 90))] for _ in "ab")
        masks = {}
        for p, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << p
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        r = np.zeros_like(t)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
                r[i + 1, j + 1] = r[i, j] + 1 if x == y else 0
        assert L.longest_subsequence(masks, b) == t[-1, -1]
        assert L.longest_run(masks, b) == r.max()
