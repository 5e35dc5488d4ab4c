"""Pairs of topics by blocks: the same for any blocks, and nothing of the pairs' number is shuffled or staged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftnet import session
from driftnet.operators import content as C
from driftnet.operators import graph as G
from driftnet.operators import study
from tests.world import AFTER, records_frame, topics_frame


@pytest.fixture(scope="module")
def vectors(spark):
    """T1 has more texts than count, T5 one, T6 none."""
    rng, rows = np.random.default_rng(1), []
    for topic, texts in (("T1", 23), ("T2", 2), ("T3", 7), ("T4", 20), ("T5", 1)):
        for i in range(texts):
            w = rng.random(4)
            rows += [(f"{topic}-{i:02}", topic, f"t{t}", float(x)) for t, x in zip(rng.choice(30, 4, replace=False), w / np.sqrt((w * w).sum()))]
    return session.stage(spark.createDataFrame(rows, "doc string, topic string, term string, w double"), "vectors")


def by_hand(vectors):
    docs = {}
    for r in vectors.collect():
        docs.setdefault(r["topic"], {}).setdefault(r["doc"], {})[r["term"]] = r["w"]
    dot = lambda x, y: sum(w * y[t] for t, w in x.items() if t in y)
    out = {}
    for a in docs:
        for b in docs:
            if a < b:
                s = [dot(docs[a][x], docs[b][y]) for x in sorted(docs[a])[:20] for y in sorted(docs[b])[:20]]
                if any(s):
                    best = sorted((round(x, 6) for x in s), reverse=True)[:5]
                    out[a, b] = sum(best) / len(best)
    return out


@pytest.mark.parametrize("topics", [1, 2, 1500])
def test_closest_texts_by_blocks(spark, vectors, monkeypatch, topics):
    monkeypatch.setattr(C, "BLOCK_TOPICS", topics)
    monkeypatch.setattr(C, "SLICE", 2)
    got = C.closest_texts(vectors)
    assert {(r["a"], r["b"]): r["closest"] for r in got.collect()} == pytest.approx(by_hand(vectors))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # a row for every pair of texts


@pytest.mark.parametrize("topics", [1, 4])
def test_pair_table_by_blocks(spark, vectors, monkeypatch, topics):
    outcome = spark.createDataFrame(AFTER, "cited string, citing string, n bigint")
    args = topics_frame(spark), records_frame(spark), G.PairRules(most_prior=2, least_after=4), outcome
    said = C.centroid_cosines(vectors).withColumnRenamed("cosine", "centroid_cos").join(C.closest_texts(vectors).withColumnRenamed("closest", "top_pairs_cos"), ["a", "b"], "full_outer")
    want = {(r["a"], r["b"]): r.asDict() for r in G.pair_table(*args, content=said).collect()}
    monkeypatch.setattr(C, "BLOCK_TOPICS", topics)
    table = G.pair_table(*args, cells=session.stage(C.topic_cells(vectors), "cells"))
    got = {(r["a"], r["b"]): r.asDict() for r in table.collect()}
    assert got.keys() == want.keys() and len(got) == 7 and any(r["top_pairs_cos"] for r in got.values())
    for k, r in got.items():
        assert {c: v for c, v in r.items() if c != "domain_pair"} == pytest.approx({c: v for c, v in want[k].items() if c != "domain_pair"})
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 1  # of topics' cells, none of pairs


@pytest.mark.parametrize("width", [2, 2048])
def test_set_features_by_blocks(spark, monkeypatch, width):
    """Sets of citers don't go to every pair; a count of 0 is an entry as well, a topic without any has none."""
    monkeypatch.setattr(study, "WIDTH", width)
    monkeypatch.setattr(C, "BLOCK_TOPICS", 2)
    near = {"A": {"x": 3, "y": 0, "z": 2}, "B": {"x": 5, "y": 1, "w": 4}, "C": {"z": 7}}
    recent = {"B": {"x": 1, "z": 1}, "C": {"z": 2, "x": 1}, "D": {"q": 1}}
    frame = lambda m: spark.createDataFrame([(t, c, n) for t, v in m.items() for c, n in v.items()], "topic string, citer string, n bigint")
    pairs = [(a, b) for a in "ABCDE" for b in "ABCDE" if a < b]
    table = study.set_features(spark.createDataFrame(pairs, "a string, b string"), frame(near), frame(recent))
    got = {(r["a"], r["b"]): r for r in table.collect()}
    assert sorted(got) == pairs and "map_from_entries" not in table._jdf.queryExecution().optimizedPlan().toString()
    for (a, b), r in got.items():
        x, y, rx, ry = near.get(a, {}), near.get(b, {}), recent.get(a, {}), recent.get(b, {})
        norm = lambda v: sum(n * n for n in v.values()) ** 0.5 or 1.0
        want = [np.log1p(max(len(x), len(y))), np.log1p(min(len(x), len(y))), np.log1p(len(x.keys() & y.keys())), np.log1p(len(rx.keys() & ry.keys())), len(x.keys() & y.keys()) / max(1, len(x.keys() | y.keys())), sum(x[k] * y[k] for k in x.keys() & y.keys()) / norm(x) / norm(y)]
        assert list(r)[2:] == pytest.approx(want)
    assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()  # of sets to pairs


def by_hand_of(vectors, first):
    """As by_hand, of each topic's `first` texts, or all with None."""
    docs = {}
    for r in vectors.collect():
        docs.setdefault(r["topic"], {}).setdefault(r["doc"], {})[r["term"]] = r["w"]
    out = {}
    for a, b in ((a, b) for a in docs for b in docs if a < b):
        x, y = ([docs[t][n] for n in sorted(docs[t])[:first]] for t in (a, b))
        s = sorted((round(sum(w * v[t] for t, w in u.items() if t in v), 6) for u in x for v in y), reverse=True)
        if any(u.keys() & v.keys() for u in x for v in y):
            out[a, b] = sum(s[:5]) / len(s[:5])
    return out


@pytest.mark.parametrize("rows, held", [(1, 3), (4, 7), (640, 8192)])
def test_all_texts_of_topics_count(spark, vectors, monkeypatch, rows, held):
    """Whichever texts are the closest, the last of the larger topic too; parts that topics are cut into make no difference."""
    monkeypatch.setattr(C, "TEXTS", rows)
    monkeypatch.setattr(C, "HELD_TEXTS", held)
    last = spark.createDataFrame([(d, t, f"own{i}", 1.0) for i in range(3) for d, t in ((f"T1-{20 + i}", "T1"), (f"T3-{i:02}", "T3"))], vectors.schema)
    both = vectors.filter("doc < 'T1-20' or topic <> 'T1'").unionByName(last)
    got = {(r["a"], r["b"]): r["closest"] for r in C.closest_texts(both, first=None).collect()}
    assert got == pytest.approx(by_hand_of(both, None))
    cells = C.topic_cells(both, first=None).toArrow()  # here, since tasks have the module's own values
    names, topics = cells.column("topic").to_pylist(), C.Topics(cells)
    for i, j, _, closest, shared in C.compared(topics, topics):
        for k in range(i, j):
            for m in range(len(names)):
                if names[k] < names[m]:
                    assert shared[k - i, m] == ((names[k], names[m]) in got) and closest[k - i, m] == pytest.approx(got.get((names[k], names[m]), 0))
    args = topics_frame(spark), records_frame(spark), G.PairRules(most_prior=2, least_after=4)
    table = G.pair_table(*args, cells=session.stage(C.topic_cells(both, first=None), "cells")).collect()
    assert {(r["a"], r["b"]): r["top_pairs_cos"] for r in table} == pytest.approx({(r["a"], r["b"]): got.get((min(r["a"], r["b"]), max(r["a"], r["b"])), 0) for r in table})
    assert got["T1", "T3"] > by_hand_of(both, 20)["T1", "T3"]


def test_queries_compare_all_texts(spark):
    """Queries and SQL that read how close topics' texts are look at all texts, where one topic has more than 20."""
    import duckdb

    import __spark_entry__ as e

    d = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        for t in ("topics", "papers", "abstracts", "records"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
        want = db.execute(e.oracle_sql()["pair_table"]).df().set_index(["a", "b"])["top_pairs_cos"].to_dict()
        few = db.execute(e.oracle_sql()["link_directions"].split(" SELECT count(*) FILTER (ab")[0] + " SELECT a, b, round(top_pairs_cos, 6) AS s FROM pt").df().set_index(["a", "b"])["s"].to_dict()
    got = {(r["a"], r["b"]): r["top_pairs_cos"] for r in e.queries()["pair_table"](spark, d).collect()}
    assert got == pytest.approx(want) and got != pytest.approx(few)


def test_feature_summary_is_of_all_texts(spark):
    import duckdb

    import __spark_entry__ as e

    d = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        for t in ("topics", "papers", "abstracts", "records"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
        whole = db.execute(e.oracle_sql()["pair_table"]).df()["top_pairs_cos"].mean()
        want = {r[0]: r[1:] for r in db.execute(e.oracle_sql()["feature_summary"]).fetchall()}
    got = {r["feature"]: (r["mean"], r["sd"]) for r in e.queries()["feature_summary"](spark, d).collect()}
    assert want["top_pairs_cos"][0] == pytest.approx(whole, abs=2e-6)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_models_are_fitted_on_all_texts(spark):
    """The earlier pairs' column is of all texts too; at this size three topics have more than 20."""
    from driftnet.plans import graph_queries as Q
    from driftnet.session import table

    d = "/root/testdata/sf0.1"
    texts = C.topic_texts(table(spark, d, "abstracts"), table(spark, d, "papers"), Q.FIT_FREEZE, 1)
    found = session.stage(C.topic_vectors(texts), "topic-vectors")
    many = [r["topic"] for r in found.select("topic", "doc").distinct().groupBy("topic").count().filter("count > 20").collect()]
    of_many = F.col("a").isin(many) | F.col("b").isin(many)
    whole, few = ({(r["a"], r["b"]): r["closest"] for r in C.closest_texts(found, first=n).filter(of_many).collect()} for n in (None, 20))
    pairs = Q._staged_pairs(spark, d, Q.FIT_FREEZE, Q.FIT_AFTER, ("a", "b")).filter(of_many)
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])): r["top_pairs_cos"] for r in pairs.collect()}
    want = {k: whole.get(k, 0) for k in got}
    assert got == pytest.approx(want) and want != pytest.approx({k: few.get(k, 0) for k in got})
