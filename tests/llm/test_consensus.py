import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftnet.llm import consensus as C


def brute(ratings, rounds=20):
    """(labels, accuracy) by the same rule, written with dictionaries."""
    items = defaultdict(dict)
    for i, a, lab in ratings:
        items[i][a] = lab
    k = max(2.0, len({lab for _, _, lab in ratings}))
    w = {a: 1.0 for _, a, _ in ratings}

    def winner(votes, skip=None):
        t = defaultdict(float)
        for a, lab in votes.items():
            if a != skip:
                t[lab] += w[a]
        return min(t, key=lambda x: (-round(t[x], 9), x)) if t else None

    for _ in range(rounds):
        hit, n = Counter(), Counter()
        for votes in items.values():
            for a, lab in votes.items():
                best = winner(votes, a)
                if best is not None:
                    n[a] += 1
                    hit[a] += best == lab
        acc = {a: (hit[a] + 1) / (n[a] + 2) for a in w}
        new = {a: max(0.01, math.log(acc[a] * (k - 1) / (1 - acc[a]))) for a in w}
        done = max(abs(new[a] - w[a]) for a in w) < 1e-4
        w = new
        if done:
            break
    return {i: winner(v) for i, v in items.items()}, acc


def planted(rnd, n=250):
    skill = {"good1": 0.95, "good2": 0.92, "bad1": 0.35, "bad2": 0.35, "bad3": 0.3, "mid": 0.7}
    truth, out = {}, []
    for i in range(n):
        truth[f"w{i}"] = rnd.choice("abcd")
        trap = rnd.choice("abcd")
        for a, s in skill.items():
            if rnd.random() < 0.8:
                out.append((f"w{i}", a, truth[f"w{i}"] if rnd.random() < s else (trap if a.startswith("bad") else rnd.choice("abcd"))))
    return truth, out


def frame(spark, ratings):
    return spark.createDataFrame([(i, "f", a, lab) for i, a, lab in ratings], "item string, scope string, annotator string, label string")


def test_as_brute_force_and_better_than_a_majority(spark):
    truth, ratings = planted(random.Random(2))
    found = C.consensus(frame(spark, ratings))
    labels = {r["item"]: r["label"] for r in found.labels.collect()}
    want, acc = brute(ratings)
    assert labels == want
    got = {r["annotator"]: r["reliability"] for r in found.annotators.collect()}
    assert got == pytest.approx(acc)
    assert min(got["good1"], got["good2"]) > got["mid"] > max(got["bad1"], got["bad2"], got["bad3"])
    votes = defaultdict(Counter)
    for i, _, lab in ratings:
        votes[i][lab] += 1
    majority = sum(min(c, key=lambda x: (-c[x], x)) == truth[i] for i, c in votes.items())
    assert sum(labels[i] == truth[i] for i in labels) > majority


def alpha(ratings):
    units = defaultdict(list)
    for i, _, lab in ratings:
        units[i].append(lab)
    units = {i: v for i, v in units.items() if len(v) > 1}
    n = sum(map(len, units.values()))
    do = sum(sum(x != y for x in v for y in v) / (len(v) - 1) for v in units.values()) / n
    c = Counter(x for v in units.values() for x in v)
    de = sum(c[x] * c[y] for x in c for y in c if x != y) / (n * (n - 1))
    return 1 - do / de


def test_agreement_with_missing_ratings(spark):
    _, ratings = planted(random.Random(4), 60)
    ratings += [("lonely", "mid", "a")]
    row = C.consensus(frame(spark, ratings), rounds=1).agreement.first()
    assert row["alpha"] == pytest.approx(alpha(ratings))


def test_ties_nulls_repeats_and_empty(spark):
    schema = "work string, facet string, label string, who string, item int, weight int"
    rows = [("w", "f", " B\n", "m1"), ("w", "f", "b", "m1"), ("w", "f", "a", "m2"), ("w", "f", None, "m3"), ("w", "f", "  ", "m4"), (None, "f", "a", "m1"), ("v", "f", "c", None), ("u", None, "c", "m1")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], schema)
    ratings = C.ratings_of(df, ["work", "facet"], F.col("who"), F.col("label"), "facet")
    assert {(r["annotator"], r["label"]) for r in ratings.collect()} == {("m1", "b"), ("m2", "a")}
    assert [(r["label"], r["raters"]) for r in C.consensus(ratings).labels.collect()] == [("a", 2)]
    none = C.consensus(C.ratings_of(df.limit(0), ["work", "facet"], F.col("who"), F.col("label"), "facet"))
    assert none.labels.count() == none.annotators.count() == none.agreement.count() == 0


def test_descriptions_without_arrays(spark):
    schema = "work string, model struct<provider:string,id:string>, descriptions array<struct<facet:string,label:string>>"
    rows = [("w", ("p", m), [("goal", lab), ("method", None)]) for m, lab in (("1", "X"), ("2", "x "), ("3", "y"))] + [("w", None, [("goal", "y")]), ("w", ("p", "4"), None), ("w", ("p", "5"), [])]
    found = C.label_consensus(spark.createDataFrame(rows, schema))
    assert [(r["item"], r["label"], r["raters"]) for r in found.labels.collect()] == [("w\x1fgoal", "x", 3)]


def test_results_tell_whether_weights_became_stable(spark):
    _, ratings = planted(random.Random(4), 60)
    found = C.consensus(frame(spark, ratings))
    assert found.stable and found.moved < C.TOLERANCE and all(r["stable"] for r in found.agreement.collect())
    one = C.consensus(frame(spark, ratings), rounds=1)
    assert not one.stable and one.rounds == 1 and one.moved > C.TOLERANCE and not any(r["stable"] for r in one.agreement.collect())
