import math

import pytest

from driftnet.operators import graph as G
from driftnet.sources import readers
from tests.world import AFTER, record, records_frame, topics_frame


@pytest.fixture(scope="module")
def pairs(spark):
    outcome = spark.createDataFrame(AFTER, "cited string, citing string, n bigint")
    rules = G.PairRules(most_prior=2, least_after=4)
    return {(r["a"], r["b"]): r for r in G.pair_table(topics_frame(spark), records_frame(spark), rules, outcome).collect()}


def test_eligibility(pairs):
    assert all(a in "T1 T2 T3" and b in "T4 T5 T6" for a, b in pairs)
    assert not {("T1", "T4"), ("T3", "T5")} & set(pairs)  # nine links before the window, seven in it
    assert pairs["T2", "T5"]["prior"] == 2 and len(pairs) == 7


def test_labels_and_directions(pairs):
    said = {p: (pairs[p]["label"], pairs[p]["ab"], pairs[p]["ba"]) for p in (("T3", "T6"), ("T1", "T5"), ("T2", "T6"))}
    assert said == {("T3", "T6"): (1, 1, 4), ("T1", "T5"): (0, 0, 3), ("T2", "T6"): (0, 0, 0)}


def test_features(pairs):
    p = pairs["T2", "T5"]
    assert p["growth_hi"] == p["growth_lo"] == pytest.approx(math.log(381 / 221))
    assert p["log_size_hi"] == pytest.approx(math.log1p(600))
    assert p["log_common"] == pytest.approx(math.log(2)) and pairs["T1", "T6"]["log_common"] == 0
    # T2 is cited by T5 (2) and T8 (6), T5 by T8 (1) and T3 (7); T2's citations of itself don't count
    assert p["cocite_cosine"] == pytest.approx(6 / math.sqrt(40 * 50))
    assert p["jaccard"] == pytest.approx(1 / 3) and p["adamic_adar"] == pytest.approx(1 / math.log(3))
    # T6 cites T3, and T3 cites T1
    assert pairs["T1", "T6"]["log_two_hop"] == pytest.approx(math.log(2)) and p["log_two_hop"] == 0


def test_no_outcome_no_label(spark):
    rows = G.pair_table(topics_frame(spark), records_frame(spark), G.PairRules(most_prior=10**9)).collect()
    assert len(rows) == 9 and all(r["label"] is None for r in rows)


def test_usable_texts_and_size_limit_the_sample(spark):
    usable = spark.createDataFrame([(f"T{i}", 4 if i == 2 else 5) for i in range(1, 7)], "topic string, usable int")
    rows = G.pair_table(topics_frame(spark), records_frame(spark), G.PairRules(most_prior=10**9, least_usable=5), usable=usable).collect()
    assert {r["a"] for r in rows} == {"T1", "T3"}


def test_current_records_and_refusal(spark):
    rows = [record("T1", retrieved="2025-01-01", size=1), record("T1", retrieved="2025-02-01", size=2), record("T1", retrieved=None, size=3), record("T2", format=2)]
    df = spark.createDataFrame(rows, readers.RECORD + ", record string")
    assert [(r["topic"], r["size"]) for r in G.current_records(df).collect()] == [("T1", 2)]
    sample = spark.createDataFrame([("T1", 2017), ("T2", 2017)], "topic string, freeze int")
    assert [r["topic"] for r in G.missing_records(sample, df).collect()] == ["T2"]
    with pytest.raises(ValueError, match="T2"):
        G.require_complete(sample, df)
    G.require_complete(sample.limit(1), df)


def test_reference_papers(spark):
    rows = [("T", "new", 95, 4), ("T", "old", 80, 61), ("T", "later", 70, 0), ("T", "rare", 2, 2)]
    got = G.reference_papers(spark.createDataFrame(rows, "topic string, reference string, now bigint, asof bigint"), 3, 3)
    assert [(r["pos"], r["reference"]) for r in got.orderBy("pos").collect()] == [(1, "old"), (2, "new")]


def test_citing_works_count_once(spark):
    works = spark.createDataFrame([("w1", "B", 2015), ("w2", "B", 2019), ("w3", None, 2015)], "work string, topic string, year int")
    refs = spark.createDataFrame([("w1", "r1"), ("w1", "r2"), ("w1", "r1"), ("w2", "r1"), ("w3", "r1"), ("w1", "q")], "work string, reference string")
    owners = spark.createDataFrame([("A", "r1"), ("A", "r2"), ("C", "q")], "topic string, reference string")
    windows = spark.createDataFrame([("train", 2010, 2017), ("all", None, None)], "window string, first int, last int")
    got = {tuple(r) for r in G.citation_links(works, refs, owners, windows).collect()}
    assert got == {("A", "train", "B", 1), ("A", "all", "B", 2), ("C", "train", "B", 1), ("C", "all", "B", 1)}


def test_verdicts(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b"), ("b", "d")], "a string, b string")
    refs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("c", "b"), ("c", "b")], "work string, reference string")
    assert {(r["a"], r["b"]): r["cites"] for r in G.citation_verdict(pairs, refs).collect()} == {("a", "b"): "both", ("a", "c"): "b cites a", ("c", "b"): "a cites b", ("b", "d"): "neither"}


def test_seeded_sample(spark):
    df = spark.createDataFrame([(g, f"{g}{i}") for g in "xy" for i in range(50)] + [(None, "n")], "g string, k string")
    a = {tuple(r) for r in G.seeded_sample(df.repartition(7), "g", "k", 5, 1).collect()}
    assert a == {tuple(r) for r in G.seeded_sample(df.orderBy("k"), "g", "k", 5, 1).collect()} and len(a) == 10
    assert a != {tuple(r) for r in G.seeded_sample(df, "g", "k", 5, 2).collect()}


def test_empty_tables(spark):
    assert G.pair_table(topics_frame(spark).limit(0), records_frame(spark), G.PairRules()).count() == 0
    assert G.pair_table(topics_frame(spark), records_frame(spark).limit(0), G.PairRules()).count() == 0


def test_texts_counts_and_indicators(spark):
    topics = spark.createDataFrame([(1, "T1", "Health Sciences"), (2, "T2", "Social Sciences"), (3, "T3", "Life Sciences")], "pos int, id string, domain string")
    records = spark.createDataFrame([record("T1", usable_abstracts=20), record("T2", usable_abstracts=6), record("T3", usable_abstracts=None)], readers.RECORD + ", record string")
    near = spark.createDataFrame([("T2", "T1", 0.25, 0.5)], "a string, b string, centroid_cos double, top_pairs_cos double")
    got = {(r["a"], r["b"]): r for r in G.pair_table(topics, records, G.PairRules(most_prior=10**9), content=near).collect()}
    p = got["T1", "T2"]
    assert (p["centroid_cos"], p["top_pairs_cos"], got["T1", "T3"]["centroid_cos"]) == (0.25, 0.5, 0)
    assert p["log_usable_hi"] == pytest.approx(math.log(20)) and p["log_usable_lo"] == pytest.approx(math.log(6))
    assert [n for n in G.INDICATORS.values() if p[n]] == ["dp_health_social"] and not any(got["T1", "T3"][n] for n in G.INDICATORS.values())
    assert {n for n in G.FEATURES} <= set(p.asDict()) and len(G.FEATURES) == 24 and [len(v) for v in G.FEATURE_SETS.values()] == [11, 22, 13, 24]
    assert set(G.pair_table(topics, records, G.PairRules(most_prior=10**9, least_usable=5)).select("a", "b").toPandas().itertuples(index=False, name=None)) == {("T1", "T2")}


def test_hub_citers_give_the_same(spark, monkeypatch):
    near = spark.createDataFrame([(f"T{i}", f"c{j}", i + j) for i in range(9) for j in range(3) if (i + j) % 4], "topic string, citer string, n bigint")
    ends = spark.createDataFrame([(f"T{i}", i, "AB"[i % 2]) for i in range(9)], "id string, pos int, domain string")
    plain = sorted(map(tuple, G.common_neighbours(near, ends).collect()))
    monkeypatch.setattr(G, "HUB", 2)
    assert sorted((r["a"], r["b"], r["common"], pytest.approx(r["adamic_adar"]), r["dot"]) for r in G.common_neighbours(near, ends).collect()) == plain and len(plain) > 10
