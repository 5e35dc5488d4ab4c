import math
import random

import pytest

from driftnet.llm import mixing, tokens

DOCS = "doc_id bigint, text string, source string, tokens int, uses int"
TARGETS = "source string, weight double, max_repeats int, note string"


def docs_of(seed=1, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = rnd.choice(["big", "big", "big", " Big", "small", "mid", None, " "]) if i > 5 else "tiny"
        text = rnd.choice([None, "", "same text again"]) if rnd.random() < 0.1 else " ".join(rnd.choice(["lake", "of", "12", "storage,"]) for _ in range(rnd.randrange(1, 80)))
        out.append((i, text, s, 1, 1))
    return out


def run(spark, docs, targets, **kw):
    return mixing.mix(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame([(*t, "x") for t in targets], TARGETS), **kw)


TARGET = [("BIG ", 0.2, 1), ("small", 0.3, 4), ("tiny", 0.2, 3), ("mid", 0.3, 2), ("absent", 0.0, 1), ("gone", 0.05, 2)]


@pytest.mark.parametrize("slices", [1, 7, 4096])
def test_shares_and_caps(spark, slices):
    docs = docs_of()
    enc = tokens.encoding()
    size = {i: len(enc.encode_ordinary(t or "")) for i, t, *_ in docs}
    src = {i: (s or "").strip().lower() for i, _, s, *_ in docs}
    m = run(spark, docs, TARGET, slices=slices)
    shares = {r["source"]: r for r in m.shares.collect()}
    total = sum(n for i, n in size.items() if src[i])
    assert set(shares) == {"big", "small", "tiny", "mid", "absent", "gone"}
    rows = m.rows.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    texts = dict((i, t) for i, t, *_ in docs)
    for s, r in shares.items():
        own = [x for x in rows if x["source"] == s]
        assert r["target"] == pytest.approx(r["weight"] * total)
        assert sum(x["tokens"] * x["uses"] for x in own) == r["reached"] <= r["target"] + 1e-9
        assert all(1 <= x["uses"] <= r["max_repeats"] for x in own) and len({texts[x["doc_id"]] for x in own}) == len(own)
        held = sum(n for i, n in size.items() if src[i] == s)
        assert r["capped"] == (held * r["max_repeats"] < r["target"])
        once = {texts[i]: size[i] for i in size if src[i] == s and size[i]}
        if not r["capped"] and r["epochs"] < r["max_repeats"]:
            assert r["target"] - r["reached"] <= max(once.values(), default=0)
        elif r["epochs"] == r["max_repeats"]:
            assert r["reached"] == r["epochs"] * sum(once.values())
    assert sum(r["share"] for r in shares.values()) == pytest.approx(1)


def test_slices_make_no_difference(spark):
    docs = docs_of(2)
    want = None
    for slices in (1, 3, 512):
        got = {(r["doc_id"], r["uses"]) for r in run(spark, docs, TARGET, slices=slices).rows.collect()}
        want = got if want is None else want
        assert got == want


def test_better_texts_are_drawn_more_often(spark):
    junk = [(i, f"{i} 77 !! 9 ## 12 {i} $$ 5 ## 3", "s", 1, 1) for i in range(400)]
    good = [(i, f"storage lake number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} is fragile and cold", "s", 1, 1) for i in range(1000, 1400)]
    rows = run(spark, junk + good, [("s", 0.4, 1)]).rows.collect()
    assert sum(r["doc_id"] >= 1000 for r in rows) > 2 * sum(r["doc_id"] < 1000 for r in rows)


def test_edges(spark):
    m = run(spark, [], TARGET[:2])
    assert m.rows.count() == 0 and [r["reached"] for r in m.shares.collect()] == [0, 0]
    m = run(spark, docs_of(3, 20), [(None, 0.5, 1), ("big", None, None)])
    assert m.rows.count() == 0 and [(r["source"], r["weight"]) for r in m.shares.collect()] == [("big", 0.0)]
    m = run(spark, [(1, "one text here", "a", 1, 1)], [("a", 0.5, 3), ("a", 0.25, 3)], total=1000)
    assert m.rows.first()["uses"] == 3 and m.shares.first()["capped"] and math.isclose(m.shares.first()["target"], 750)


def test_a_source_of_equal_texts_says_how_much_it_falls_short(spark):
    docs = [(i, "the same eight tokens or so", "twice", 1, 1) for i in range(100)] + [(200 + i, f"text number {i} of its own", "own", 1, 1) for i in range(100)]
    m = run(spark, docs, [("twice", 0.5, 1), ("own", 0.5, 1)])
    got = {r["source"]: r for r in m.shares.collect()}
    one = got["twice"]["held"] // 100
    assert got["twice"]["texts"] == 1 and got["twice"]["reached"] == one and not got["twice"]["capped"]
    assert got["twice"]["short"] == pytest.approx(got["twice"]["target"] - one) and got["own"]["short"] < 20
