import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftnet import session
from driftnet.operators import layout
from driftnet.plans import skew
from driftnet.sources import feed, readers, writers


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"work": "W1", "year": 2000}\nnot json\n')
    rows = readers.lines(spark, str(tmp_path / "a.jsonl")).cache()
    assert [(r["work"], r["year"], r["_corrupt_record"]) for r in rows.collect()] == [("W1", 2000, None), (None, None, "not json")]
    (tmp_path / "p.json").write_text(json.dumps({"W1": {"field": "F", "domain": "D"}, "W2": {"topic": "T1"}}))
    assert {(r["work"], r["field"], r["topic"]) for r in readers.keyed_object(spark, str(tmp_path / "p.json")).collect()} == {("W1", "F", None), ("W2", None, "T1")}
    (tmp_path / "r.json").write_text(json.dumps({"topic": "T1", "works_by_year": {"2017": 3}}, indent=1))
    assert readers.whole_file(spark, str(tmp_path / "r.json"), readers.RECORD).first()["works_by_year"] == {"2017": 3}


def test_results_know_their_path(spark, tmp_path):
    for unit, issue in (("u-1", "7"), ("u-2", "import-1")):
        os.makedirs(tmp_path / unit, exist_ok=True)
        (tmp_path / unit / f"{issue}.json").write_text(json.dumps({"author": "me", "descriptions": [{"work": "W1"}]}, indent=1))
    assert {(r["unit"], r["issue"], r["author"]) for r in readers.results(spark, str(tmp_path)).collect()} == {("u-1", "7", "me"), ("u-2", "import-1", "me")}


def test_commented_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text('# note\nwork,id,family,field,role,method_named,domain\nW1,x,f,"A, B",member,,D\n# end\n')
    assert [(r["work"], r["field"], r["method_named"]) for r in readers.commented_csv(spark, str(tmp_path / "b.csv")).collect()] == [("W1", "A, B", None)]


WORKS = [("W1", "article", 2010, 64, [(2016, 9), (2019, 40), (2021, 3)]), ("W2", "review", 2015, 51, [(2018, 2)]), ("W3", "dataset", 2018, 6, [(2020, 8)]), ("W4", None, None, 3, None)]


def test_filter_language_and_citations(spark):
    df = spark.createDataFrame(WORKS, "id string, type string, publication_year int, cited_by_count bigint, counts_by_year array<struct<year:int,cited_by_count:bigint>>")
    ids = lambda **w: [r["id"] for r in readers.filtered(df, **w).orderBy("id").collect()]
    assert ids(type="article|review") == ["W1", "W2"] and ids(publication_year="<2015") == ["W1"] and ids(publication_year="2015-2018") == ["W2", "W3"]
    assert ids(type="true", publication_year=">2010") == ["W2", "W3"] and ids(type="false") == ["W4"] and ids(id="W3") == ["W3"]
    assert [r["c"] for r in df.orderBy("id").select(readers.citations_up_to(df, 2017).alias("c")).collect()] == [21, 49, 0, 3]


def test_strict_citing(spark):
    df = spark.createDataFrame([("article", [("a", ("X",))], "Y"), ("article", [("a", ("X",))], "X"), ("dataset", None, "Y"), ("review", None, "Y")], "type string, topics array<struct<id:string,subfield:struct<display_name:string>>>, other string")
    assert [r["s"] for r in df.select(readers.strict_citing(df, "other").alias("s")).collect()] == [True, False, False, True]


def test_paged_feed_stops_at_the_short_page(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(page):
        open(f"{folder}/{page}", "w").close()
        return [(page, i) for i in range(3 if page < 6 else 1 if page == 6 else 0)]

    feed.register(spark, "pages_of_test", "page int, i int", 3, fetch, 2)
    assert spark.read.format("pages_of_test").load().count() == 19
    assert max(int(p.name) for p in tmp_path.iterdir()) <= 8


def test_scan(spark):
    df = spark.createDataFrame([(f"W{i}", "ab"[i % 2] if i % 5 else None, 2000 + i) for i in range(20)], "id string, type string, year int")
    ids = lambda **k: [r["id"] for r in readers.scan(df, **k).collect()]
    assert ids(where={"year": "<2005"}, sort="year:desc", limit=2) == ["W4", "W3"] and len(ids(sample=7, seed=1)) == 7
    assert sorted(ids(sample=7, seed=1)) == sorted(r["id"] for r in readers.scan(df.repartition(3), sample=7, seed=1).collect())
    assert {tuple(r) for r in readers.scan(df, group_by="type").collect()} == {("a", 8), ("b", 8)}
    assert readers.scan(df, select=["year"]).columns == ["year"]


def test_model_file_and_digests(spark, tmp_path):
    model = ({"x": 1.0}, {"x": 2.0}, {"x": 3.0}, -0.5)
    writers.model_file({"m": model}, str(tmp_path / "model.json"))
    assert readers.stored_model(spark, str(tmp_path / "model.json"), "m") == model
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"abc")
    assert [tuple(r) for r in writers.digest(spark, str(tmp_path / "d")).collect()] == [("a.txt", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]


def test_writers(spark, tmp_path):
    out = str(tmp_path / "o")
    writers.ranking(spark.createDataFrame([(2, 0.25), (1, 0.5)], "rank int, score double"), out, "score")
    text = next(p for p in (tmp_path / "o" / "ranking.csv").iterdir() if p.suffix == ".csv").read_text()
    assert text.splitlines() == ["rank,score", "1,0.500000", "2,0.250000"]
    writers.table_and_csv(spark.createDataFrame([("b",), ("a",)], "x string"), out, "t", ["x"])
    assert spark.read.parquet(f"{out}/t").count() == 2
    writers.report({"a": float("nan"), "b": [1.0, float("inf")]}, f"{out}/r.json")
    assert json.load(open(f"{out}/r.json")) == {"a": None, "b": [1.0, None]}
    sums = writers.checksums(out)
    assert "r.json" in sums and len(open(f"{out}/SHA256SUMS").readlines()) == len(sums)
    d = spark.createDataFrame([("W1", "m", "p", "a"), ("W1", "l", "p", "a")], "work string, model string, problem string, approach string")
    writers.open_index(d, spark.createDataFrame([("W1", "F"), ("W2", "F")], "work string, field string"), out)
    assert [len(r["descriptions"]) for r in spark.read.json(f"{out}/index").collect()] == [2]


def test_upsert(spark):
    df = lambda rows: spark.createDataFrame(rows, "k string, at int, v string")
    got = writers.upsert(df([("a", 1, "old"), ("b", 5, "old")]), df([("a", 1, "new"), ("b", 4, "new"), ("c", None, "new")]), ["k"], "at")
    assert {tuple(r) for r in got.collect()} == {("a", 1, "new"), ("b", 5, "old"), ("c", None, "new")}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_with_hot_keys(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(skew, "PROBE", 1.0)
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None, "lost"] + [f"k{i}" for i in range(90)]), i) for i in range(1000)]
    big = spark.createDataFrame(rows, "k string, i int")
    dim = spark.createDataFrame([(k, f"v{k}") for k in {r[0] for r in rows} - {None, "lost"}], "k string, v string")
    assert "hot" in skew.hot_keys(big, "k") and None not in skew.hot_keys(big, "k")
    want = {(k, i, f"v{k}" if k not in (None, "lost") else None) for k, i in rows if how == "left" or k not in (None, "lost")}
    out = skew.lookup_join(big, dim, "k", how)
    assert {(r["k"], r["i"], r["v"]) for r in out.collect()} == want and out.count() == len(want)


def test_stage_keeps_schema_and_empty(spark):
    df = spark.createDataFrame([], "a int, b array<string>")
    staged = session.stage(df, "x")
    assert staged.schema == df.schema and session.is_empty(staged)
    assert session.shared_dir(spark)


def test_svd_and_layout(spark):
    rnd = random.Random(0)
    rows = [(f"d{i}", f"{'ab'[i % 2]}{rnd.randrange(20)}", 1.0) for i in range(80) for _ in range(6)]
    v = spark.createDataFrame(rows, "doc string, term string, w double").groupBy("doc", "term").agg(F.sum("w").alias("w"))
    at = {r["doc"]: np.array(r["coordinates"]) for r in layout.truncated_svd(v, 5).collect()}
    assert len(at) == 80 and all(len(x) == 5 for x in at.values())
    x = np.array([at[f"d{i}"] for i in range(80)])
    y = layout.tsne(x, rounds=250)
    assert y.min() >= 0 and y.max() <= 1000 and (y == layout.tsne(x, rounds=250)).all()
    near = [np.argsort(((y - p) ** 2).sum(axis=1))[1] for p in y]
    assert sum((i % 2) == (j % 2) for i, j in enumerate(near)) > 70  # the two vocabularies lie apart
    placed = layout.layout(spark.createDataFrame([(k, p.tolist()) for k, p in at.items()], "doc string, coordinates array<double>"), 50).collect()
    assert len(placed) == 80 and all(0 <= r["x"] <= 1000 for r in placed)
    with pytest.raises(ValueError):
        layout.tsne(np.zeros((layout.MOST_POINTS + 1, 2)))


def test_entry_and_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_flagship(spark):
    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
