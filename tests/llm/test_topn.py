import random
from collections import defaultdict

import pytest

from driftnet.llm import topn
from driftnet.plans import skew


def brute(rows, n):
    best = defaultdict(dict)
    for g, item, v in rows:
        if g is None or item is None or v is None or v != v:
            continue
        best[g][item] = max(v, best[g].get(item, v))
    return {(g, i + 1, item, v) for g, items in best.items() for i, (item, v) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n])}


@pytest.mark.parametrize("hot", [None, ["g0"], ["g0", "g3", "absent"]])
def test_against_brute_force(spark, hot):
    rnd = random.Random(3)
    rows = [(f"g{min(rnd.randrange(12), rnd.randrange(12))}", f"i{rnd.randrange(60)}", float(rnd.randrange(9))) for _ in range(3000)]
    rows += [("g0", f"i{rnd.randrange(500)}", float(rnd.randrange(9))) for _ in range(1500)]
    rows += [(None, "i1", 1.0), ("g1", None, 9.0), ("g1", "i2", None), ("g1", "i3", float("nan")), ("only nulls", "i", None), ("", "", -1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "grp string, item string, value double, g string, pos int").repartition(5)
    got = topn.top_n(df, ["grp"], "item", "value", 7, hot).collect()
    assert {(r["grp"], r["pos"], r["item"], r["value"]) for r in got} == brute(rows, 7)
    assert len(got) == len(brute(rows, 7))


def test_repeated_rows_ties_and_empty(spark):
    df = spark.createDataFrame([("a", "y", 2.0), ("a", "y", 2.0), ("a", "x", 2.0), ("a", "z", 1.0), ("a", "z", 5.0)], "g string, i string, v double")
    got = [(r["i" if "i" in r else "item"], r["pos"]) for r in topn.top_n(df, ["g"], "i", "v", 2).orderBy("pos").collect()]
    assert got == [("z", 1), ("x", 2)]
    assert topn.top_n(df.limit(0), ["g"], "i", "v", 2).count() == 0
    assert topn.top_n(df, ["g"], "i", "v", 0).count() == 0


def test_two_group_columns(spark):
    df = spark.createDataFrame([("a", "b", "i", 1.0), ("a", "", "j", 2.0), ("a", None, "k", 3.0)], "x string, y string, item string, v double")
    assert {(r["x"], r["y"], r["item"]) for r in topn.top_n(df, ["x", "y"], "item", "v", 1).collect()} == {("a", "b", "i"), ("a", "", "j")}


def test_lists(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    monkeypatch.setattr(skew, "PROBE", 1.0)
    near = spark.createDataFrame(
        [("W1", [("W2", 0.5), ("W1", 1.0), ("W3", None), ("W4", float("nan"))]), ("W1", [("W2", 0.9), ("W5", 0.9)]), ("W1", []), ("W1", None), (None, [("W9", 1.0)])],
        "work string, neighbours array<struct<work:string,similarity:double>>",
    )
    recs = spark.createDataFrame([("T1", 2017, ["W1", "W2", None], [3, None, 4]), ("T1", 2017, ["W2", "W3"], [3, 3]), ("T2", None, ["W1"], [1]), ("T3", 2017, None, None)], "topic string, freeze int, instrument array<string>, instrument_cites array<bigint>")
    got = {tuple(r) for r in topn.best_neighbours_and_references(near, recs).collect()}
    assert got == {("neighbours", "W1", 1, "W2"), ("neighbours", "W1", 2, "W5"), ("instrument", "T1:2017", 1, "W1"), ("instrument", "T1:2017", 2, "W2"), ("instrument", "T1:2017", 3, "W3")}


def test_lists_cut_within_their_row_keep_what_counts(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    lists = [[(rnd.choice([None, float("nan"), 0.5, 0.25, rnd.random()]), rnd.choice([None, *[f"i{j}" for j in range(rnd.choice([3, 30]))]])) for _ in range(rnd.choice([0, 3, 12, 200]))] for _ in range(150)]
    df = spark.createDataFrame([(f"g{i % 40}", x) for i, x in enumerate(lists)], "g string, x array<struct<v:double,item:string>>")
    cut = df.select("g", F.explode(topn.first_items(F.col("x"), 5)).alias("c")).select("g", "c.item", (-F.col("c.low")).alias("v"))
    got = {(r["g"], r["pos"], r["item"], r["value"]) for r in topn.top_n(cut, ["g"], "item", "v", 5).collect()}
    assert got == brute([(f"g{i % 40}", item, v) for i, x in enumerate(lists) for v, item in x], 5)
    assert cut.count() < sum(len(x) for x in lists) / 2
