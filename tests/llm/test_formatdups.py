import random
from collections import defaultdict

import pytest

from driftnet import session
from driftnet.llm import formatdups
from driftnet.plans import skew


def canon(t):
    return None if t is None else "".join(c for c in t.lower() if c.isalnum())


def brute(rows):
    groups = defaultdict(list)
    for i, p, q in rows:
        a, b = canon(p), canon(q)
        groups[tuple(sorted((a, b))) if a and b and len(a) > 2 and len(b) > 2 else i].append(i)
    classes = {(min(g), len(g)) for g in groups.values()}
    return classes, {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def rows_of(rnd, n):
    out = []
    for i in range(n):
        p, q = (rnd.choice(["The lake", "a b", "Über cool", "", None, "12 34", "x", f"own text {rnd.randrange(80)}"]) for _ in "pq")
        if rnd.random() < 0.3:
            p, q = "Hot group!", "of many rows"
        if rnd.random() < 0.3:
            p, q = q, p
        fuzz = lambda t: t and "".join(c.upper() if rnd.random() < 0.3 else c for c in t).replace(" ", rnd.choice([" ", "  ", "-", ".\n"]))
        out.append((i + 1, fuzz(p), fuzz(q)))
    return out


@pytest.mark.parametrize("bits,hot", [(1 << 27, False), (1 << 10, False), (1 << 11, True), (1 << 27, True)])
def test_against_brute_force(spark, monkeypatch, bits, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 20)
        monkeypatch.setattr(skew, "PROBE", 1.0)
    rows = rows_of(random.Random(bits), 900)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "desc_id bigint, problem string, approach string, key string, h int").repartition(7)
    classes, members = formatdups.collapse(df, "desc_id", ["problem", "approach"], max_bits=bits)
    want = brute(rows)
    assert {tuple(r) for r in classes.collect()} == want[0] and classes.count() == len(want[0])
    assert {tuple(r) for r in members.collect()} == want[1] and members.count() == len(want[1])


@pytest.mark.parametrize("max_bits", [1 << 27, 1 << 12])
def test_filters_let_every_repeat_pass_and_few_others(spark, max_bits):
    """The smaller filters hold 256 keys at their design load; here are a hundred times as many."""
    rnd = random.Random(5)
    keys = [rnd.getrandbits(64) - (1 << 63) for _ in range(25_600)]
    rows = [(i, k.to_bytes(8, "big", signed=True), k) for i, k in enumerate(keys + keys[:500] + keys[:100])]
    df = session.stage(spark.createDataFrame(rows, "id bigint, key binary, h bigint").repartition(9 if max_bits > 1 << 12 else 2), "keys")
    shards, bits = formatdups.shards_of(len(rows), max_bits)
    assert shards == (128 if max_bits == 1 << 12 else 1) and bits <= max_bits
    flagged = formatdups.flag_repeats(df, len(rows), max_bits).collect()
    passed = {int.from_bytes(r["key"], "big", signed=True) for r in flagged if r["maybe"]}
    assert len(flagged) == len(rows) and all(r["maybe"] or r["key"] is None for r in flagged)
    assert set(keys[:500]) <= passed and len(passed) < 500 + 0.05 * len(keys)


def test_empty_and_only_nulls(spark):
    df = spark.createDataFrame([], "desc_id bigint, problem string, approach string")
    assert [x.count() for x in formatdups.collapse(df, "desc_id", ["problem", "approach"])] == [0, 0]
    df = spark.createDataFrame([(1, None, "abc def"), (2, None, "abc def"), (None, "same", "text"), (4, "same", "text")], df.schema)
    classes, members = formatdups.collapse(df, "desc_id", ["problem", "approach"])
    assert {tuple(r) for r in classes.collect()} == {(1, 1), (2, 1), (4, 1)} and members.count() == 0
