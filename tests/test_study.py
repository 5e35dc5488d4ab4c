import json

import numpy as np
import pandas as pd
import pytest

from driftnet import session
from driftnet.operators import graph, stats, study
from driftnet.sources import samples, writers

DOMAINS = {f"T{i}": graph.DOMAINS[i % 4] for i in range(24)}


def pairs(spark, seed=0, plain=False):
    """Pairs whose outcome hangs on the network features more than on the rest."""
    rng = np.random.default_rng(seed)
    names = [(a, b) for a in DOMAINS for b in DOMAINS if a < b and DOMAINS[a] != DOMAINS[b]]
    x = rng.standard_normal((len(names), len(graph.FEATURES)))
    at = graph.FEATURES.index
    z = 2.0 * x[:, at("cocite_cosine")] + 0.6 * x[:, at("log_size_hi")] - 2.0
    df = pd.DataFrame(x, columns=graph.FEATURES).assign(a=[p[0] for p in names], b=[p[1] for p in names], label=(rng.random(len(names)) < 1 / (1 + np.exp(-z))).astype(int))
    df["domain_pair"] = [" / ".join(sorted((DOMAINS[a], DOMAINS[b]))) for a, b in names]
    df["prior"], df["ab"], df["ba"] = 0, df["label"] * 5, df["label"] * (df.index % 2)
    return df if plain else session.stage(spark.createDataFrame(df), "pairs")


@pytest.fixture(scope="module")
def report(spark):
    later = pairs(spark, 2)
    strict = later.filter("label = 1").select("a", "b", (later["ab"]).alias("n"))
    return study.report(pairs(spark, 1), later, DOMAINS, 40, strict)


def test_report(report):
    m = report["models"]
    assert set(m) == {"popularity", "network", "semantic", "combined", "random"}
    assert m["network"]["average_precision"] > m["popularity"]["average_precision"] and m["network"]["average_precision"] > m["random"]["average_precision"]
    assert all(v["average_precision_ci"][0] <= v["average_precision_ci"][1] for k, v in m.items() if k != "random")
    assert report["hypotheses"]["H2"]["holds"] and report["decision"] in ("continue", "stop") and report["strict"]["positive"] > 0
    assert report["directions"]["both"] + report["directions"]["one_way"] == report["pairs"]["later_positive"]
    assert len(report["top_predictions"]) == min(200, report["pairs"]["later"]) and set(report["feature_shift"]) == set(graph.FEATURES)
    assert json.loads(writers.as_json(report))["pairs"] == report["pairs"]
    assert dict(study.flat(report))["/pairs/later"] == str(report["pairs"]["later"])


def test_no_strict_check_is_no_decision(spark):
    got = study.conclusions({"H1": (0.1, 0.01, 0.2), "H2": (0.1, 0.0, 0.2), "H3": (-0.1, -0.2, 0.0)}, 0.5, None)
    assert got["decision"] == "incomplete" and got["hypotheses"]["H1"]["outcome"] == "supported" and not got["hypotheses"]["H3"]["holds"]
    assert study.conclusions({"H1": (0.1, 0.01, 0.2), "H2": (0.1, 0.0, 0.2), "H3": (0, 0, 0)}, 0.5, {"holds": True})["decision"] == "continue"
    assert study.conclusions({"H1": (0.1, -0.01, 0.2), "H2": (0.1, 0.0, 0.2), "H3": (0, 0, 0)}, 0.5, {"holds": True})["decision"] == "stop"


def test_pairs_of_one_kind_are_refused(spark):
    later = pairs(spark, 3)
    for bad in (later.filter("label = 0"), later.filter("label = 1"), later.limit(0)):
        with pytest.raises(study.NotEnough):
            study.report(later, session.stage(bad, "bad"), DOMAINS, 2)


def test_robustness_and_publishing(report):
    def run(after):
        if after > 5:
            raise study.NotEnough("no pair is connected")
        return report

    seen = []
    checks = study.robustness(report, [("k2", "two", {"after": 2}), ("k9", "nine", {"after": 9})], run, lambda x: seen.append(len(x)))
    assert [c["key"] for c in checks] == ["main", "strict", "k2", "k9"] and checks[3]["skipped"] == "no pair is connected" and seen == [3, 4]
    assert study.replaced(checks, {"key": "k2", "x": 1})[-1] == {"key": "k2", "x": 1} and len(study.replaced(checks, {"key": "k2"})) == 4
    good = report | {"decision": "stop", "config": {"commit": "abc1234567", "code_changed": False}}
    assert study.publishable(good, checks)["commit"] == "abc1234567"
    for bad in ({"decision": "incomplete"}, {"config": {"commit": "", "code_changed": False}}, {"config": {"commit": "abc", "code_changed": True}}):
        with pytest.raises(ValueError):
            study.publishable(good | bad)
    with pytest.raises(ValueError, match="unknown"):
        study.publishable(good, known_commit=lambda c: False)
    with pytest.raises(ValueError, match="another run"):
        study.publishable(good, [{"key": "main", "hypotheses": {}}])
    assert "commit" in study.provenance() and study.provenance("/")["commit"] == ""


def test_models_on_the_driver_and_on_the_cluster_agree(spark):
    rows = pairs(spark, 4)
    one, two = study.fit_models(rows, {"m": graph.CONTENT}), study.fit_models(rows, {"m": graph.CONTENT}, most=10)
    assert two["m"].coef == pytest.approx(one["m"].coef, abs=1e-4)
    assert study.require_close(two["m"], dict(zip(one["m"].names, one["m"].coef)), 1e-3) < 1e-3
    with pytest.raises(ValueError):
        study.require_close(one["m"], {n: 9.0 for n in graph.CONTENT})
    assert all(abs(r["gradient"]) < 1e-6 for r in study.gradient(rows, one["m"]).collect())


def test_strict_draws_and_scores_without_refit(spark):
    df = pairs(spark, 5, plain=True).sort_values(["a", "b"], ignore_index=True)
    df["strict"], df["score"] = 0, df["cocite_cosine"]
    df.loc[df.index[df["label"] == 1][:1], "strict"] = 1
    got = stats.bootstrap(spark, df, df, DOMAINS, {"network": ["cocite_cosine"]}, 20, strict=True).toPandas()
    assert set(got["model"]) == {"network", "network_strict"} and got[got["model"] == "network_strict"]["ap"].isna().any() and got[got["model"] == "network"]["ap"].notna().all()
    plain = stats.bootstrap(spark, None, df, DOMAINS, {"s": ["score"]}, 5, refit=False, redraw=0).toPandas()
    assert len(plain) == 5 and plain["ap"].between(0, 1).all()


def test_replicates_by_passes_over_the_pairs_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(stats.bounded_pandas, "__defaults__", (100,))  # 216 pairs were refused
    fitting, later = pairs(spark, 1), pairs(spark, 2)
    df = pairs(spark, 2, plain=True)
    df["strict"] = 0
    df.loc[df.index[df["label"] == 1][:2], "strict"] = 1
    got = study.resampled(fitting, session.stage(spark.createDataFrame(df), "strict"), DOMAINS, 6, strict=True, models=study.fit_models(fitting, most=100), most=100).toPandas()
    take = lambda df: df.sort_values(["a", "b"], ignore_index=True)
    want = stats.bootstrap(spark, take(pairs(spark, 1, plain=True)), take(df), DOMAINS, graph.FEATURE_SETS, 6, strict=True).toPandas()
    both = want.merge(got, on=["draw", "model"], how="outer", suffixes=("", "_got"))
    assert len(both) == len(want) == len(got) == 36 and both["ap_got"].to_numpy() == pytest.approx(both["ap"].to_numpy(), abs=1e-7, nan_ok=True)
    none = study.resampled(fitting, later.withColumn("label", later["label"] * 0), DOMAINS, 2, models=study.fit_models(fitting, most=100), most=100).toPandas()
    assert len(none) == 8 and none["ap"].isna().all()


def test_sample_is_drawn_once(spark, tmp_path):
    topics = spark.createDataFrame([(t, d) for t, d in DOMAINS.items()] + [("T99", None)], "id string, domain string")
    first = samples.load_or_draw(spark, str(tmp_path), topics, 3, 1).collect()
    assert len(first) == 12 and [r["pos"] for r in sorted(first, key=lambda r: r["pos"])] == list(range(1, 13))
    assert sorted(samples.load_or_draw(spark, str(tmp_path), topics.limit(0), 3, 1).collect()) == sorted(first)
    with pytest.raises(ValueError, match="seed 1"):
        samples.load_or_draw(spark, str(tmp_path), topics, 3, 2)
    spark.createDataFrame([("T1", "x", 1)], "id string, domain string, pos int").write.mode("overwrite").parquet(str(tmp_path / "sample"))
    with pytest.raises(ValueError, match="changed"):
        samples.load_or_draw(spark, str(tmp_path), topics, 3, 1)


def test_largest_difference(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, 2.0)], "k string, p double, q double")
    b = spark.createDataFrame([("x", 1.0, 2.5), ("y", 1.0, 2.0)], a.schema)
    got = {r["feature"]: r["largest"] for r in study.largest_difference(a, b, ["k"], ["p", "q"]).collect()}
    assert got == {"p": 0.0, "q": 0.5}
    assert {r["largest"] for r in study.largest_difference(a, b.limit(1), ["k"], ["p"]).collect()} == {float("inf")}


def test_report_of_more_pairs_than_a_driver_takes(spark, monkeypatch):
    later = pairs(spark, 2)
    strict = later.filter("label = 1").select("a", "b", later["ab"].alias("n"))
    want = study.report(pairs(spark, 1), later, DOMAINS, 3, strict)
    monkeypatch.setattr(stats.bounded_pandas, "__defaults__", (100,))  # 216 pairs were refused
    monkeypatch.setattr(study.resampled, "__defaults__", (*study.resampled.__defaults__[:-1], 100))
    got = study.report(pairs(spark, 1), later, DOMAINS, 3, strict)
    for m in graph.FEATURE_SETS:
        assert got["models"][m]["average_precision_ci"] == pytest.approx(want["models"][m]["average_precision_ci"], abs=1e-6)
    assert got["strict"]["diff_ci"] == pytest.approx(want["strict"]["diff_ci"], abs=1e-6)
