import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftnet.operators import metrics as M
from driftnet.operators import stats


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, k int, score double, label int")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [(rnd.choice("ab"), i, round(rnd.random(), 1), int(rnd.random() < 0.3)) for i in range(200)] + [("none", 1000, 0.5, 0), ("a", 1001, None, 1)]


def test_average_precision_with_ties(spark, rows):
    got = {r["g"]: r["ap"] for r in M.average_precision(scored(spark, rows), "score", "label", ["g"]).collect()}
    for g in "ab":
        own = [(s, y) for h, _, s, y in rows if h == g and s is not None]
        assert got[g] == pytest.approx(stats.weighted_ap(np.array([y for _, y in own], float), np.array([s for s, _ in own]), np.ones(len(own))))
    assert got["none"] is None
    hand = scored(spark, [("x", 1, 3.0, 1), ("x", 2, 2.0, 0), ("x", 3, 1.0, 1)])
    assert M.average_precision(hand, "score", "label").first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_auc(spark, rows):
    got = {r["g"]: r["auc"] for r in M.roc_auc(scored(spark, rows), "score", "label", ["g"]).collect()}
    for g in "ab":
        p, n = ([s for h, _, s, y in rows if h == g and y == c and s is not None] for c in (1, 0))
        assert got[g] == pytest.approx(sum((x > y) + (x == y) / 2 for x in p for y in n) / (len(p) * len(n)))
    assert got["none"] is None


def test_precision_at_k(spark, rows):
    own = sorted((-(s if s is not None else -9), k, y) for _, k, s, y in rows)[:20]
    assert M.precision_at(scored(spark, rows), "score", "label", 20, ["k"]).first()["precision"] == pytest.approx(sum(y for *_, y in own) / 20)


def test_histogram(spark):
    got = [r["n"] for r in M.histogram(spark.createDataFrame([(0.0,), (1.0,), (0.95,), (-3.0,), (7.0,), (0.049,), (None,)], "v double"), "v").orderBy("bin").collect()]
    assert got == [3, *[0] * 18, 3]
    assert [r["n"] for r in M.histogram(spark.createDataFrame([], "v double"), "v").collect()] == [0] * 20


def test_mean_and_population_sd(spark):
    got = M.mean_sd(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double"), ["x", "y"]).collect()
    assert {(r["feature"], r["mean"], r["sd"]) for r in got} == {("x", 2.0, 1.0), ("y", 5.0, 0.0)}


def test_ranks_without_gathering(spark, rows):
    df = scored(spark, [r for r in rows if r[2] is not None]).repartition(6)
    got = {r["k"]: r["rank"] for r in M.ranked(df, "score", ["k"]).collect()}
    want = {k: i + 1 for i, (_, k) in enumerate(sorted((-s, k) for _, k, s, _ in rows if s is not None))}
    assert got == want
    assert M.ranked(df.limit(0), "score", ["k"]).count() == 0


def test_retrieval(spark):
    near = spark.createDataFrame([("a1", "b1", 0.9), ("a1", "x", 0.5), ("b1", "a1", 0.1)], "query string, item string, s double")
    q = spark.createDataFrame([("a1", "f"), ("b1", "f"), ("lonely", "g")], "query string, qf string")
    p = spark.createDataFrame([("a1", "f"), ("b1", "f"), ("c1", "f"), ("x", "h")], "item string, pf string")
    got = {r["query"]: (r["ap"], r["first"]) for r in M.retrieval(near, q, p, F.col("qf") == F.col("pf")).collect()}
    # c1 shares no term with a1 and still is in its ranking, after x
    assert got == {"a1": (pytest.approx((1 + 2 / 3) / 2), 1), "b1": (pytest.approx(1.0), 1)}


def planted(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - 1)))).astype(int)
    return x, y


def test_fit_is_the_optimum_and_agrees_with_mllib(spark):
    x, y = planted()
    m = stats.fit(x, y, ["a", "b", "c"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(z @ m.coef + m.intercept)))
    assert np.abs(z.T @ (w * (p - y)) + m.coef).max() < 1e-6 and abs((w * (p - y)).sum()) < 1e-6
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, label int")
    d = stats.fit_distributed(df, ["a", "b", "c"], "label")
    assert d.coef == pytest.approx(m.coef, abs=1e-4) and d.intercept == pytest.approx(m.intercept, abs=1e-4)
    col = M.logit_score(dict(zip("abc", m.mean)), dict(zip("abc", m.scale)), dict(zip("abc", m.coef)), m.intercept)
    assert [r["s"] for r in df.select(col.alias("s")).limit(5).collect()] == pytest.approx(m.score(x)[:5])
    with pytest.raises(ValueError):
        stats.fit(x, np.zeros(len(y)), ["a", "b", "c"])


def test_weights_are_repetitions():
    x, y = planted(120)
    w = np.random.default_rng(1).integers(0, 3, len(y))
    a, b = stats.fit(x, y, ["a", "b", "c"], w.astype(float)), stats.fit(np.repeat(x, w, axis=0), np.repeat(y, w), ["a", "b", "c"])
    assert a.mean == pytest.approx(b.mean) and a.scale == pytest.approx(b.scale)
    assert stats.weighted_ap(y.astype(float), x[:, 0], w.astype(float)) == pytest.approx(stats.weighted_ap(np.repeat(y, w).astype(float), np.repeat(x[:, 0], w), np.ones(w.sum())))


def test_bootstrap(spark):
    import pandas as pd

    topics = {f"T{i}": "AB"[i % 2] for i in range(24)}
    x, y = planted(144)
    pairs = [(a, b) for a in topics for b in topics if topics[a] < topics[b]]
    df = pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs], "label": y, "x": x[:, 0], "noise": x[:, 1]})
    sets = {"good": ["x", "noise"], "poor": ["noise"]}
    draws = stats.bootstrap(spark, df, df, topics, sets, 30)
    got = {(r["draw"], r["model"]): r["ap"] for r in draws.collect()}
    assert len(got) == 60 and got == {(r["draw"], r["model"]): r["ap"] for r in stats.bootstrap(spark, df, df, topics, sets, 30).repartition(3).collect()}
    ci = {r["model"]: r for r in stats.intervals(draws).collect()}
    assert ci["good"]["median"] > ci["poor"]["median"] and all(c["low"] <= c["median"] <= c["high"] for c in ci.values())
    assert stats.bootstrap(spark, df.assign(label=0), df, topics, sets, 2).filter("ap is null").count() == 4
    assert [stats.decision(*c, 0.01) for c in ((0.1, 0.2), (-0.1, 0.001), (-0.1, 0.1), (None, 0.1))] == ["supported", "negative", "inconclusive", "incomplete"]


@pytest.mark.parametrize("seed", [1, 2])
def test_curves_are_those_of_both_measures(spark, seed):
    """Ties, groups without positives or without others, null groups and scores; no window over a group's rows."""
    rnd = np.random.default_rng(seed)
    rows = [("ab"[i % 2], float(rnd.integers(0, 300)) / 7, int(rnd.random() < 0.2)) for i in range(3000)]
    rows += [("none", float(i), 0) for i in range(5)] + [("all", 1.0, 1)] * 3 + [(None, float(i % 3), i % 2) for i in range(9)] + [("a", None, 1), ("a", float("nan"), 1), ("a", float("nan"), 0)]
    df = spark.createDataFrame(rows, "model string, score double, label int").repartition(7)
    got = M.curves(df, "score", "label", ["model"])
    ap, auc = M.average_precision(df, "score", "label", ["model"]), M.roc_auc(df, "score", "label", ["model"])
    want = {r["model"]: [r["ap"]] for r in ap.collect()}
    for r in auc.collect():
        want[r["model"]].append(r["auc"])
    said = {r["model"]: [r["ap"], r["auc"]] for r in got.collect()}
    assert said.keys() == want.keys() and len(said) == 5
    assert all(x == (None if y is None else pytest.approx(y, abs=1e-12)) for k in want for x, y in zip(said[k], want[k]))


def test_models_fitted_together_are_those_of_the_driver(spark):
    x, y = planted(300)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, label int").repartition(5)
    got = stats.fit_together(df, {"all": ["c", "a", "b"], "one": ["b"]}, "label")
    for m, cols in (("all", [2, 0, 1]), ("one", [1])):
        want = stats.fit(x[:, cols], y, ["abc"[i] for i in cols])
        assert got[m].names == want.names and got[m].coef == pytest.approx(want.coef, abs=1e-9) and got[m].intercept == pytest.approx(want.intercept, abs=1e-9)
    with pytest.raises(ValueError):
        stats.fit_together(df.filter("label = 1"), {"one": ["b"]}, "label")
