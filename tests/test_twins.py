import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftnet.operators import twins as TW
from driftnet.operators import vectors as V

DESC = "desc_id bigint, work string, model struct<provider:string,id:string>, problem string, approach string"
PAPERS = "work string, field string, domain string, family string, role string"


def world(spark, papers=40):
    """Papers of two fields, each of four words; papers 0 and 1 share theirs. A good second model, and a vague one."""
    rnd = random.Random(1)
    vocab = ["w" + "abcdefghij"[i // 4] + "klmn"[i % 4] * 3 for i in range(40)]
    vague = ["thing", "stuff", "item", "matter", "object", "aspect", "notion", "entity", "issue", "topic"]
    words = [rnd.sample(vocab, 4) for _ in range(papers)]
    words[1] = words[0]
    rows, k = [], 0
    for i, w in enumerate(words):
        for model, said in [("A", w), ("B", w[:3] + ["extra"]) if i < papers // 2 else ("vague", rnd.sample(vague, 4))]:
            k += 1
            rows.append((k, f"W{i:02d}", ("local", model), " ".join(said[:2]), " ".join(said[2:])))
    meta = [(f"W{i:02d}", "f0" if i % 2 else "f1", "D", None, None) for i in range(papers)]
    abstracts = [(f"W{i:02d}", "title", 2000, " ".join(["fish sea", "rock hill"][i % 2].split() + ["common", "word"])) for i in range(papers)]
    return spark.createDataFrame(rows, DESC), spark.createDataFrame(meta, PAPERS), spark.createDataFrame(abstracts, "work string, title string, year int, abstract string")


RULES = TW.TwinRules(most_share=1.0)


@pytest.fixture(scope="module")
def found(spark):
    return TW.combine(*world(spark), RULES)


def test_planted_twin_comes_first(found):
    rows = found["twins"].orderBy(F.desc("score")).collect()
    first = max((r for r in rows if r["trust"] == "two models agree"), key=lambda r: r["score"])
    assert {first["a"], first["b"]} == {"W00", "W01"}
    assert all(0 < r["distance"] <= 1 and r["score"] == pytest.approx(r["similarity"] * r["distance"], abs=1e-5) for r in rows)
    used = Counter(w for r in rows for w in (r["a"], r["b"]))
    assert max(used.values()) <= RULES.per_paper  # the quota is shared by both kinds
    sure = {w for r in rows if r["trust"] == "two models agree" for w in (r["a"], r["b"])}
    assert sure <= {f"W{i:02d}" for i in range(20)}


def test_models(found):
    got = {r["model"]: r for r in found["models"].collect()}
    assert got["local/A"]["descriptions"] == 40 and got["local/B"]["papers"] == 20
    assert got["local/B"]["agreement"] > 0.4 > got["local/vague"]["agreement"]


def test_neighbours_cross_fields(found):
    near = found["neighbours"].filter("work = 'W00'").orderBy("rank").collect()
    assert near[0]["other"] == "W01" and all(int(r["other"][1:]) % 2 == 1 for r in near)


def test_nested_rows(spark, found):
    _, papers, _ = world(spark)
    rows = TW.nested(found["twins"], V.shared_words(found["twins"], found["vectors"], "a", "b"), TW.field_of(papers)).collect()
    top = max(rows, key=lambda r: r["score"])
    shares = [w["share"] for w in top["why"]]
    assert shares == sorted(shares, reverse=True) and top["a"]["field"] == "f1" and len(shares) <= 6


def test_families_are_known_cases_not_twins(spark):
    d, p, a = world(spark)
    p = p.withColumn("family", F.when(F.col("work").isin("W00", "W01"), "fam")).withColumn("role", F.when(F.col("family").isNotNull(), "member"))
    out = TW.combine(d, p, a, RULES)
    assert [(r["a"], r["b"]) for r in out["known_cases"].collect()] == [("W00", "W01")]
    assert not out["twins"].filter("a = 'W00' and b = 'W01'").count()


def test_mean_likeness_equals_all_pairs(spark):
    d, _, _ = world(spark, 12)
    v = TW.paper_vectors(TW.description_vectors(TW.described(d), RULES)).collect()
    works = sorted({r["doc"] for r in v})
    terms = sorted({r["term"] for r in v})
    m = np.zeros((len(works), len(terms)))
    for r in v:
        m[works.index(r["doc"]), terms.index(r["term"])] = r["w"]
    s = m @ m.T
    want = (s.sum(axis=1) - np.diag(s)) / (len(works) - 1)
    got = {r["doc"]: r["likeness"] for r in TW.mean_likeness(spark.createDataFrame(v)).collect()}
    assert [got[w] for w in works] == pytest.approx(want, abs=1e-8)


def test_all_descriptions_by_different_models_are_paired(spark):
    said = [(1, "W1", "A", "red fish"), (2, "W1", "A", "blue fish"), (3, "W1", "B", "red fish"), (4, "W1", "B", "blue bird"), (5, "W1", "A", "red fish"), (6, "W2", "A", "red bird")]
    rows = TW.described(spark.createDataFrame([(i, w, ("local", m), t, "") for i, w, m, t in said], DESC))
    got = TW.agreements(rows, TW.description_vectors(rows, RULES))
    assert {(r["x"], r["y"]) for r in got.collect()} == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 5), (4, 5)}
    pairs = {r["model"]: r["pairs"] for r in TW.model_report(rows, got).collect()}
    assert pairs == {"local/A": 6, "local/B": 6}


def test_papers_described_by_common_words_alone_keep_their_vectors(spark):
    said = [(i, f"W{i}", "the same common words" if i < 4 else f"rare{'ab'[i % 2]} lone{'ab'[i % 2]}") for i in range(8)]
    rows = TW.described(spark.createDataFrame([(i, w, ("local", "A"), t, "") for i, w, t in said], DESC))
    docs = {r["doc"] for r in TW.paper_vectors(TW.description_vectors(rows)).select("doc").distinct().collect()}
    assert docs == {f"W{i}" for i in range(8)}


def test_missing_fields(spark):
    rows = [("W1", "a", "D", None, None), ("W2", "", "D", None, None), ("W3", None, None, None, None), (None, "x", "D", None, None), ("W1", "a", "D", None, None)]
    assert {tuple(r) for r in TW.field_of(spark.createDataFrame(rows, PAPERS)).collect()} == {("W1", "a"), ("W2", "D"), ("W3", "W3")}


def test_empty_tables(spark):
    out = TW.combine(*[df.limit(0) for df in world(spark, 4)], RULES)
    assert all(out[k].count() == 0 for k in out)


def test_quota(spark):
    df = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.7), ("c", "d", 0.6), ("e", "f", 0.6)], "a string, b string, score double")
    used = Counter()
    assert [x[:2] for x in TW.select_with_quota(df, 10, 2, used)] == [("a", "b"), ("a", "c"), ("c", "d"), ("e", "f")]
    assert TW.select_with_quota(df, 10, 2, used) == [("e", "f", 0.6)]
    assert len(TW.select_with_quota(df, 1, 2)) == 1


def test_small_views(spark):
    papers = spark.createDataFrame([("W1", "A", "f"), ("W2", "B", "f"), ("W3", None, "g"), ("W4", "A", "g")], "work string, domain string, field string")
    said = spark.createDataFrame([("W1",), ("W2",), ("W3",)], "work string")
    ids = lambda df: sorted(r["work"] for r in df.collect())
    assert ids(TW.visible(papers, said, ["B"])) == ["W1", "W3"] and ids(TW.visible(papers, said, field="f")) == ["W1", "W2"]
    pairs = spark.createDataFrame([("r", "x", "y", 0.1), ("r", "y", "x", 0.5), ("r", "a", "b", 0.4), ("r", "c", "d", None)], "run string, x string, y string, score double")
    assert [(r["a"], r["b"], r["pos"]) for r in TW.shown_once(pairs, "run", 2).orderBy("pos").collect()] == [("x", "y", 1), ("a", "b", 2)]
    agreed = spark.createDataFrame([("W", 1, 2, 0.5), ("W", 1, 3, 0.1), ("W", 2, 3, 0.4)], "work string, x bigint, y bigint, agreement double")
    assert [tuple(r) for r in TW.closest_descriptions(agreed).collect()] == [("W", 2, 0.45)]
