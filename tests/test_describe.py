import json

import numpy as np

from driftnet.operators import describe as D
from driftnet.operators import layout, study
from tests.test_study import pairs


def test_one_retry_with_the_reason_and_units_that_fail(spark, tmp_path):
    calls = str(tmp_path)

    def ask(prompt):
        title = prompt.split("Title: ")[1].split("\n")[0]
        again = "could not be used" in prompt
        with open(f"{calls}/{title} {again}", "a") as f:
            f.write("x")
        if title == "broken":
            raise RuntimeError("no answer")
        if title == "late" and not again:
            return "sorry"
        if title == "avoids" and not again:
            return json.dumps({"problem": "lake and river and pond again", "approach": "we look at it"})
        return "<think>{}</think>" + json.dumps({"problem": f"what {title} does here", "approach": f"how {title} does it"})

    rows = [("u1", f"W{i}", t, None, ["lake", "river", "pond"]) for i, t in enumerate(["one", "two", "late", "avoids"])] + [("u2", "W5", "broken", None, None), ("u2", "W6", "six", None, None)] + [("u3", f"W{i}", f"t{i}", "text", []) for i in range(3)] + [("u3", "W9", "broken", None, None)]
    df = spark.createDataFrame(rows, "unit string, work string, title string, abstract string, avoid array<string>")
    got = {(r["unit"], r["work"]): r for r in D.describe(df, ask, "Describe it.").collect()}
    assert len(got) == len(rows)
    assert {k[1]: r["tries"] for k, r in got.items() if k[0] == "u1"} == {"W0": 1, "W1": 1, "W2": 2, "W3": 2}
    assert got["u1", "W3"]["fault"] is None and got["u2", "W5"]["fault"] == "no object" and got["u2", "W5"]["tries"] == 2
    assert all(len(p.read_text()) == 1 for p in tmp_path.iterdir() if not p.name.startswith("broken"))
    kept = D.whole_units(D.describe(df, ask, "Describe it."))
    assert sorted((r["unit"], r["work"]) for r in kept.collect()) == [("u1", f"W{i}") for i in range(4)] + [("u3", f"W{i}") for i in range(3)]
    assert D.describe(df.limit(0), ask, "").count() == 0


def points(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    side = np.arange(n) % 2
    return spark.createDataFrame([(f"d{i:03d}", (rng.standard_normal(5) + 8 * side[i]).tolist()) for i in range(n)], "doc string, coordinates array<double>")


def test_points_beyond_the_landmarks_go_to_their_like(spark):
    got = layout.layout(points(spark, 90), rounds=150, landmarks=60).toPandas()
    assert len(got) == 90 and got["doc"].is_unique and got[["x", "y"]].to_numpy().min() >= 0 and got[["x", "y"]].to_numpy().max() <= 1000
    side, at = got["doc"].str[1:].astype(int).to_numpy() % 2, got[["x", "y"]].to_numpy(float)
    apart = np.linalg.norm(at[:, None] - at, axis=2) + 1e9 * np.eye(90)
    assert (side[apart.argmin(axis=1)] == side).mean() > 0.95  # the nearest on the map is of the same kind


def test_a_map_is_made_again_only_for_other_vectors(spark, tmp_path):
    made = []

    def make(v):
        made.append(1)
        return v.selectExpr("doc", "0 as x", "0 as y")

    a = points(spark, 10)
    for v in (a, a.orderBy("doc", ascending=False), points(spark, 10, 2), a):
        assert layout.reused(str(tmp_path), v, make).count() == 10
    assert len(made) == 2
    assert layout.scaled(spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", 2.0, 5.0)], "doc string, x double, y double")).orderBy("doc").toPandas().values.tolist() == [["a", 0, 0], ["b", 1000, 0], ["c", 500, 0]]


def test_boosted_trees_find_what_matters(spark):
    got = study.measures(study.boosted(pairs(spark, 1), pairs(spark, 2), rounds=5), (10,)).first()
    assert got["model"] == "trees" and got["roc_auc"] > 0.7
