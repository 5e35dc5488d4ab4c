import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftnet.operators import vectors as V

DOCS = {"d1": "lake cold lake", "d2": "lake warm", "d3": "stone", "d4": "stone cold cold stone"}


@pytest.fixture(scope="module")
def tf(spark):
    rows = [(k, v, "x" if k in ("d1", "d2") else "y") for k, v in DOCS.items()]
    return V.doc_terms(spark.createDataFrame(rows, "id string, text string, dom string"), "id", F.split("text", " "), "dom").cache()


def brute(least=1):
    counts = {k: Counter(v.split()) for k, v in DOCS.items()}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for k, c in counts.items():
        raw = {w: (1 + math.log(n)) * (math.log((1 + len(DOCS)) / (1 + df[w])) + 1) for w, n in c.items() if df[w] >= least}
        size = math.sqrt(sum(x * x for x in raw.values()))
        out |= {(k, w): x / size for w, x in raw.items()}
    return out


@pytest.mark.parametrize("least", [1, 2])
def test_tfidf(tf, least):
    got = {(r["doc"], r["term"]): r["w"] for r in V.tfidf(tf, 4, least).collect()}
    assert got == pytest.approx(brute(least))


def test_max_share(tf):
    assert {r["term"] for r in V.tfidf(tf, 4, 1, 0.25).collect()} == {"warm"}


def test_cosines_and_dots(spark, tf):
    v, w = V.tfidf(tf, 4), brute()
    want = {(a, b): sum(w[a, t] * w[b, t] for t in {"lake", "cold", "stone", "warm"} if (a, t) in w and (b, t) in w) for a in DOCS for b in DOCS if a < b}
    got = {(r["a"], r["b"]): r["cosine"] for r in V.cosine_pairs(v, "doc").collect()}
    assert got == pytest.approx({k: x for k, x in want.items() if x})
    for size in (1, 3, 1000):
        assert {(r["a"], r["b"]): r["cosine"] for r in V.block_cosines(v, "doc", size).collect()} == pytest.approx({k: x for k, x in want.items() if x})
    pairs = spark.createDataFrame([("1", "d1", "d4"), ("2", "d1", "d3")], "pair string, p string, q string")
    assert {r["pair"]: r["dot"] for r in V.dots(pairs, v, "p", "q").collect()} == pytest.approx({"1": want["d1", "d4"], "2": 0.0})
    mean = V.mean_vectors(V.tfidf(tf, 4, keep=("dom",)), "dom")
    assert {r["dom"]: r["s"] for r in mean.groupBy("dom").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()} == pytest.approx({"x": 1, "y": 1})


@pytest.mark.parametrize("terms", [1, 5, 500_000])
def test_block_neighbours(spark, tf, monkeypatch, terms):
    monkeypatch.setattr(V, "BLOCK_TERMS", terms)
    v, w = V.tfidf(tf, 4, keep=("dom",)), brute()
    group = {"d1": "x", "d2": "x", "d3": "y", "d4": "y"}
    apart = spark.createDataFrame([("x", "y", 0.5)], "a string, b string, distance double")
    got = {(r["doc"], r["other"]): (r["similarity"], r["distance"], r["score"]) for r in V.block_neighbours(v, "dom", 3, apart).collect()}
    want = {}
    for a in DOCS:
        for b in DOCS:
            s = round(sum(w[a, t] * w[b, t] for t in {"lake", "cold", "stone", "warm"} if (a, t) in w and (b, t) in w), 6)
            if group[a] != group[b] and s > 0:
                want[a, b] = (s, 0.5, round(s / 2, 6))
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in want.items()}) and len(want) == 2
    assert all(v[1] == 0.5 and v[2] == pytest.approx(v[0] / 2, abs=1e-6) for v in got.values())
    assert V.block_neighbours(v.limit(0), "dom", 3, apart).count() == 0


@pytest.mark.parametrize("terms", [40, 500_000])
def test_neighbours_and_counts_against_brute_force(spark, monkeypatch, terms):
    monkeypatch.setattr(V, "BLOCK_TERMS", terms)
    rnd = random.Random(3)
    words = {f"d{i:02d}": {w: rnd.random() for w in rnd.sample([f"t{j}" for j in range(30)], rnd.randrange(1, 9))} for i in range(60)}
    group = {d: f"g{int(d[1:]) % 7}" if int(d[1:]) % 9 else d for d in words}
    v = spark.createDataFrame([(d, t, x, group[d]) for d, ts in words.items() for t, x in ts.items()], "doc string, term string, w double, g string")
    apart = {(f"g{i}", f"g{j}"): rnd.random() for i in range(7) for j in range(i + 1, 6)}
    s = {(a, b): round(sum(x * words[b].get(t, 0) for t, x in words[a].items()), 6) for a in words for b in words if a != b}
    far = lambda a, b: apart.get(tuple(sorted((group[a], group[b]))), 1.0)
    want = set()
    for a in words:
        near = [b for b in words if group[b] != group[a] and s[a, b] > 0]
        want |= {(a, b) for by in (lambda b: -s[a, b], lambda b: -round(s[a, b] * far(a, b), 6)) for b in sorted(near, key=lambda b: (by(b), b))[:4]}
    got = V.block_neighbours(v, "g", 4, spark.createDataFrame([(*p, x) for p, x in apart.items()], "a string, b string, distance double")).collect()
    assert {(r["doc"], r["other"]) for r in got} == want and len(got) == len(want)
    assert all(r["similarity"] == s[r["doc"], r["other"]] and r["distance"] == pytest.approx(far(r["doc"], r["other"])) for r in got)
    level = {d: round(rnd.random(), 6) for d in list(words)[::2]}
    for r in V.above(v, spark.createDataFrame(list(level.items()), "doc string, level double"), 0.01).collect():
        own = [s[r["doc"], b] for b in words if b != r["doc"] and s[r["doc"], b] > 0]
        fail = [x for x in own if round(x + 0.01, 6) >= level[r["doc"]]]
        assert (r["others"], r["failing"], r["least_failing"], r["most_passing"]) == (len(own), len(fail), min(fail, default=None), max([x for x in own if x not in fail], default=0))
    assert V.above(v.limit(0), spark.createDataFrame([], "doc string, level double"), 0.01).count() == 0


@pytest.mark.parametrize("rounds", [1, 3])
def test_neighbours_by_rounds_keep_what_may_count(spark, monkeypatch, rounds):
    """Many blocks, stripes and ties: the same as all pairs, and a round writes a row a document, not 2 k rows a block."""
    staged, stage = [], V.session.stage
    for name, value in (("BLOCK_TERMS", 60), ("ROUND_BLOCKS", -(-20 // rounds)), ("STRIPE", 5), ("ASKED", 7)):
        monkeypatch.setattr(V, name, value)
    monkeypatch.setattr(V.session, "stage", lambda df, label: staged.append((label, out := stage(df, label))) or out)
    rnd = random.Random(5)
    words = {f"d{i:03d}": {w: rnd.choice([0.1, 0.2, 0.30001]) for w in rnd.sample([f"t{j}" for j in range(25)], rnd.randrange(3, 9))} for i in range(200)}
    group = {d: f"g{int(d[1:]) % 5}" for d in words}
    v = spark.createDataFrame([(d, t, x, group[d]) for d, ts in words.items() for t, x in ts.items()], "doc string, term string, w double, g string")
    s = {(a, b): round(sum(x * words[b].get(t, 0) for t, x in words[a].items()), 6) for a in words for b in words if group[a] != group[b]}
    far = lambda a, b: 0.25 if {group[a], group[b]} == {"g0", "g1"} else 1.0
    want = set()
    for a in words:
        near = [b for b in words if s.get((a, b), 0) > 0]
        want |= {(a, b) for by in (lambda b: -s[a, b], lambda b: -round(s[a, b] * far(a, b), 6)) for b in sorted(near, key=lambda b: (by(b), b))[:3]}
    got = V.block_neighbours(v, "g", 3, spark.createDataFrame([("g0", "g1", 0.25)], "a string, b string, distance double")).collect()
    assert {(r["doc"], r["other"]) for r in got} == want and len(got) == len(want)
    written = [df for label, df in staged if label == "near"]
    assert len(written) >= rounds and all(df.count() == len(words) for df in written)


def test_common_terms_are_joined_the_same_way(spark, tf, monkeypatch):
    plain = {(r["doc"], r["term"]): r["w"] for r in V.tfidf(tf, 4).collect()}
    monkeypatch.setattr(V, "MOST_TERMS", 1)
    monkeypatch.setattr(V.skew, "HOT_ROWS", 2)
    assert {(r["doc"], r["term"]): r["w"] for r in V.tfidf(tf, 4).collect()} == pytest.approx(plain)


def test_distinctive_breaks_ties_by_the_word(tf):
    got = [(r["doc"], r["rank"], r["term"], r["score"]) for r in V.distinctive(tf, 4, 1).orderBy("doc").collect()]
    assert got == [("d1", 1, "lake", round(2 * math.log(2), 4)), ("d2", 1, "warm", round(math.log(4), 4)), ("d3", 1, "stone", round(math.log(2), 4)), ("d4", 1, "cold", round(2 * math.log(2), 4))]


def test_field_words(spark):
    rows = [(f"a{i}", "A", "everywhere only_a") for i in range(12)] + [(f"b{i}", "B", "everywhere") for i in range(12)] + [(f"c{i}", "C", "everywhere") for i in range(12)] + [("z", "A", "seldom common")]
    tf = V.doc_terms(spark.createDataFrame(rows, "id string, dom string, text string"), "id", F.split("text", " "), "dom")
    everyday = spark.createDataFrame([("seldom", 1.0), ("common", 6.0)], "term string, zipf double")
    assert {r["term"] for r in V.field_words(tf, "dom", everyday=everyday).collect()} == {"only_a", "seldom"}
    assert {r["term"] for r in V.field_words(tf, "dom", everyday=everyday, never=["seldom"]).collect()} == {"only_a"}


def test_search_and_shared_words(spark, tf):
    v = V.tfidf(tf, 4)
    asked = spark.createDataFrame([("stone", 1.0)], "term string, w double")
    assert [r["doc"] for r in V.search(v, asked, 5).collect()] == ["d3", "d4"]
    pairs = spark.createDataFrame([("d1", "d4"), ("d1", "d3")], "a string, b string")
    assert [(r["a"], r["b"], r["term"]) for r in V.shared_words(pairs, v, "a", "b").collect()] == [("d1", "d4", "cold")]
