import random

import pytest

from driftnet.llm.components import components, twin_groups
from driftnet.plans import skew


def brute(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {(x, root(x)) for x in up}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in pairs], "a bigint, b bigint, u int, v string").repartition(3)
    out = components(df, "a", "b")
    got = {tuple(r) for r in out.collect()}
    assert out.count() == len(got)
    return got


@pytest.mark.parametrize("seed,nodes,edges", [(1, 60, 40), (2, 200, 260), (3, 40, 300)])
def test_random_graphs(spark, seed, nodes, edges):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(edges)] + [(None, 3), (4, None), (5, 5), (5, 5)]
    assert run(spark, pairs) == brute(pairs)


def test_chain_in_bad_order_and_repeats(spark):
    order = list(range(150))
    random.Random(7).shuffle(order)
    pairs = list(zip(order, order[1:])) * 2
    assert run(spark, pairs) == brute(pairs)


def test_hub(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "PROBE", 1.0)
    pairs = [(500, i) for i in range(200)] + [(i + 1000, i + 1001) for i in range(0, 40, 2)] + [(1001, 1002)]
    assert run(spark, pairs) == brute(pairs)


def test_empty_and_only_ignored(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, 1), (None, 2), (None, None)]) == set()


def test_nested_pairs(spark):
    side = "struct<work:string,field:string>"
    rows = [([(("w1 ", "f"), ("W2", "f")), ((" W2", None), ("w3", "f")), (("W9", "f"), None), ((" ", "f"), ("W8", "f")), (("W4", "f"), ("w4", "f"))],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"twins array<struct<a:{side},b:{side}>>")
    assert {tuple(r) for r in twin_groups(df).collect()} == {("W1", "W1"), ("W2", "W1"), ("W3", "W1")}
