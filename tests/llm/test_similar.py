import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftnet.llm import similar
from driftnet.llm.quantiser import Quantiser, lists
from driftnet.plans import skew


def brute(rows, k, least=4):
    sets = defaultdict(set)
    for w, t in rows:
        if w is not None and t is not None:
            sets[w].update(x for x in re.findall(r"[^\W\d_]+", t.lower()) if len(x) >= least)
    sets = {w: s for w, s in sets.items() if s}
    out = {}
    for a, s in sets.items():
        c = sorted(((-len(s & t) / (len(s) * len(t)) ** 0.5, b) for b, t in sets.items() if b != a))[:k]
        out[a] = [(b, -x) for x, b in c]
    return out


def corpus(seed, n=400):
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = ["".join(rnd.choice(letters) for _ in range(7)) for _ in range(3000)]
    common = vocab[:60]
    say = lambda: [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(vocab) for _ in range(60)]
    rows, base = [], say()
    for i in range(n):
        if i % 5 == 0:
            base = say()
        words = base if i % 5 == 0 else [w if rnd.random() < 0.8 else rnd.choice(vocab) for w in base] if i % 2 else say()
        rows.append((f"W{i:05d}", " ".join(words[:30])))
        rows.append((f"W{i:05d}", "a an the " + " ".join(words[30:]).upper()))
    return rows


def got_of(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "work string, text string, sig string, a int").repartition(5)
    out = defaultdict(list)
    for r in sorted(similar.most_similar(df, **kw).collect(), key=lambda r: (r["work"], r["rank"])):
        out[r["work"]].append((r["neighbour"], r["cosine"]))
    return out


def test_recall_of_alike_pairs(spark):
    rows = corpus(1)
    want = {(a, b) for a, near in brute(rows, 5).items() for b, c in near if c >= 0.5}
    got = {(a, b): c for a, near in got_of(spark, rows, k=5, least_cosine=0.5).items() for b, c in near}
    assert len(want) > 100 and len(want & set(got)) >= 0.95 * len(want)
    exact = {(a, b): c for a, near in brute(rows, 400).items() for b, c in near}
    assert all(abs(exact[p] - c) < 1e-12 for p, c in got.items())


def near_copies(seed, copies=250, others=500):
    """A third of the papers near copies of one text, alike but for a few rare words."""
    rnd = random.Random(seed)
    say = lambda n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]
    base = say(80)
    texts = [rnd.sample(base, 64) + say(rnd.randint(10, 24)) for _ in range(copies)] + [say(80) for _ in range(others)]
    return [(f"W{i:05d}", " ".join(t)) for i, t in enumerate(texts)]


def test_recall_where_a_third_are_near_copies_of_one_text(spark):
    rows = near_copies(3)
    want = {(a, b) for a, near in brute(rows, 5).items() for b, c in near if c >= 0.53}
    got = {(a, b) for a, near in got_of(spark, rows, k=5, least_cosine=0.53, depth=1000).items() for b, _ in near}
    assert len(want) == 5 * 250 and len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize("hot", [False, True])
def test_copies_ties_and_a_hot_class(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 20)
        monkeypatch.setattr(skew, "PROBE", 1.0)
    rows = corpus(2, 60)
    rows += [(f"C{i:03d}", "exactly these words again" if i % 2 else "Again, WORDS; these exactly") for i in range(120)]
    rows += [("W00000", f"many rows of one work number {chr(97 + i % 26)}") for i in range(300)]
    rows += [("none", "a b c"), ("none2", ""), ("none3", None), (None, "exactly these words again")]
    want, got = brute(rows, 5), got_of(spark, rows, k=5, least_cosine=0.5)
    for i in range(120):
        w = f"C{i:03d}"
        assert [b for b, _ in got[w]] == [b for b, _ in want[w]]
    assert not {"none", "none2", "none3", None} & set(got)


def test_a_dense_group_is_not_cut_by_rank(spark):
    rows = near_copies(3)
    want = {(a, b) for a, near in brute(rows, 5).items() for b, c in near if c >= 0.53}
    got = {(a, b) for a, near in got_of(spark, rows, k=5, least_cosine=0.53, depth=8).items() for b, _ in near}
    assert len(want & got) >= 0.99 * len(want)


@pytest.mark.parametrize("block_rows", [10_000, 97])
def test_every_paper_has_its_nearest_without_a_floor(spark, monkeypatch, block_rows):
    monkeypatch.setattr(similar.best_of_all, "__defaults__", (block_rows,))
    rows = corpus(4, 300) + [(f"C{i:03d}", "exactly these words again") for i in range(9)]
    want = {a: [(b, c) for b, c in near if c > 0] for a, near in brute(rows, 5).items()}
    got = got_of(spark, rows, k=5, exact=True)
    assert {a: [b for b, _ in n] for a, n in got.items()} == {a: [b for b, _ in n] for a, n in want.items() if n}
    assert min(c for n in want.values() for _, c in n) < 0.3


def test_the_query_has_no_floor(spark, tmp_path):
    from driftnet.llm import queries

    rows = corpus(5, 60)
    spark.createDataFrame(rows, "work string, abstract string").write.parquet(str(tmp_path / "abstracts.parquet"))
    spark.createDataFrame([], "work string, problem string, approach string").write.parquet(str(tmp_path / "descriptions.parquet"))
    got = {(r["work"], r["neighbour"]) for r in queries.p1_neighbours(spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a, near in brute(rows, 5).items() for b, c in near if c > 0}


def test_few_rows_and_none(spark):
    assert got_of(spark, []) == {}
    assert got_of(spark, [("a", "lonely words here")]) == {}
    two = got_of(spark, [("a", "some shared words"), ("b", "some shared words too many"), ("a", "some shared words")])
    assert set(two) == {"a", "b"} and two["a"][0][0] == "b"


def test_quantiser_keeps_scores_of_alike_vectors():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = Quantiser.fit(x)
    codes = q.encode(x)
    assert (Quantiser.unpack(Quantiser.pack(codes)) == codes).all()
    y = q.table(codes)
    plain = Quantiser(q.books, 1.0)
    z = plain.table(plain.encode(x))
    along = lambda t: np.abs(((x - t) * x).sum(axis=1)).mean()
    assert along(y) < along(z)  # less is lost along the vector, where high scores are made
    c = lists(x, 20)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and len(c) == 20


def test_index_reaches_nine_tenths_of_the_nearest_at_any_cosine(spark, monkeypatch):
    from driftnet.llm import nearest

    monkeypatch.setattr(nearest, "BLOCK_ROWS", 150)
    rows = corpus(6, 1200) + near_copies(7, 100, 0)
    want, got = brute(rows, 5), got_of(spark, rows, k=5)
    assert set(got) == set(want) and all(len(n) == 5 for n in got.values())
    hit = sum(sum(c >= want[a][4][1] - 1e-12 for _, c in n) for a, n in got.items())
    assert hit >= 0.9 * 5 * len(want) and min(n[0][1] for n in want.values()) < 0.34
    exact = {a: dict(n) for a, n in brute(rows, 400).items()}
    assert all(abs(exact[a].get(b, c) - c) < 1e-12 for a, n in got.items() for b, c in n)


def test_long_texts_ties_and_copies_in_the_index(spark):
    say = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}word" for i in range(9000))
    rows = corpus(8, 40) + [("long1", say), ("long2", say + " other words"), ("same1", "one and the same text"), ("same2", "The same text and ONE"), ("same3", "same text"), (None, "x"), ("null", None)]
    want, got = brute(rows, 5), got_of(spark, rows, k=5)
    assert got == {a: [(b, c) for b, c in n if c > 0] for a, n in want.items() if n[0][1] > 0}


def test_asked_works_are_searched_among_all(spark):
    from pyspark.sql import functions as F

    rows = corpus(9, 120) + [(f"C{i}", "exactly these words again") for i in range(8)]
    want = brute(rows, 5)
    got = got_of(spark, rows, k=5, exact=True, asked=F.col("work").rlike("[05]$"))
    assert got == {a: [(b, c) for b, c in n if c > 0] for a, n in want.items() if a[-1] in "05"}


class Shared:
    def __init__(self, *value):
        self.value = value


def index_at_size(lists_=2500, blocks=500):
    """An index as of five million rows: the most lists there are, spread over many blocks."""
    rng = np.random.default_rng(5)
    out = similar._Index.__new__(similar._Index)
    out.idf, out.probes, out.blocks = np.ones(similar.BUCKETS), 100, blocks
    out.centroids = rng.standard_normal((lists_, similar.ROUTE_DIMS)).astype(np.float32)
    out.quantiser = Quantiser.fit(rng.standard_normal((500, similar.DIMS)).astype(np.float32))
    out.first, out.parts = np.arange(lists_) % blocks, np.ones(lists_, dtype=np.int64)
    return out


def word_rows(n, words=60, seed=6):
    flat = np.random.default_rng(seed).integers(-(2**62), 2**62, n * words)
    ends = np.arange(n + 1, dtype=np.int32) * words
    return pa.RecordBatch.from_arrays([pa.array([f"W{i:05d}" for i in range(n)]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["work", "words"])


def test_routing_holds_few_rows_at_once():
    index, batch, seen = index_at_size(), word_rows(4000), 0
    run = similar._route(Shared(index, np.arange(index.blocks)), similar.DIMS)
    tracemalloc.start()
    for out in run(iter([batch])):
        seen += out.num_rows if out.column(1)[0].as_py() == 0 else 0
        assert out.nbytes < 40e6
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 2 * batch.num_rows and peak < 150e6, peak


def test_scan_is_the_same_in_small_steps(monkeypatch):
    index = index_at_size(8, 1)
    rows = pa.concat_tables([pa.Table.from_batches([word_rows(60, seed=s)]) for s in (6, 6, 7)]).combine_chunks()
    names = pa.array([f"W{i:05d}" for i in range(len(rows))])
    batch = pa.RecordBatch.from_arrays([names, rows["words"].combine_chunks()], names=["work", "words"])
    routed = pa.Table.from_batches(list(similar._route(Shared(index, np.zeros(1, dtype=np.int64)), similar.DIMS)(iter([batch])))).sort_by("kind").combine_chunks()
    scan = lambda: {tuple(r.values()) for b in similar._scan(Shared(index, None), similar.DIMS, 3, 5, -1.0, -1.0)(iter(routed.to_batches())) for r in b.to_pylist()}
    want = scan()
    for name, value in (("SCORES", 100), ("RESCORED", 7), ("HELD", 50)):
        monkeypatch.setattr(similar, name, value)
    short = lambda found: {(a, b, round(s, 5)) for a, b, s in found}
    assert len(want) >= 5 * len(rows) and short(scan()) == short(want)


def test_blocks_are_filled_so_that_a_query_is_copied_to_few():
    rng = np.random.default_rng(8)
    sample = rng.standard_normal((4000, similar.ROUTE_DIMS)).astype(np.float32)
    sample[:3000] += 3 * sample[0]  # groups of very unequal size
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    sketches = rng.standard_normal((500, similar.DIMS)).astype(np.float32)
    for rows, parallel in ((60_000, 6), (4000, 6), (400_000, 6)):
        index = similar._Index(np.ones(similar.BUCKETS), sample, sketches, rows, parallel)
        full = max(parallel, 2 * rows / similar.BLOCK_ROWS)
        assert index.blocks <= 1.3 * full + 1, (rows, index.blocks)
        first = np.concatenate([np.arange(f, f + n) for f, n in zip(index.first, index.parts)])
        assert set(first) == set(range(index.blocks))  # each block has a list


def test_no_pair_is_lost_by_signs(spark):
    """Pairs around the floor, small sets and large, saturated ones: what is left is exact."""
    rng, rows = np.random.default_rng(9), []
    for g, (size, shared) in enumerate([(3, 2), (60, 32), (60, 31), (4000, 2120), (4000, 2119)]):
        pool = rng.integers(-(2**62), 2**62, 2 * size - shared)
        rows += [(f"x{g}", sorted(int(w) for w in pool[:size])), (f"y{g}", sorted(int(w) for w in pool[size - shared :]))]
    sets = spark.createDataFrame(rows, "work string, words array<bigint>")
    pairs = spark.createDataFrame([(f"x{i}", f"y{j}") for i in range(5) for j in range(5)], "a string, b string")
    got = {(r["a"], r["b"]): r["cosine"] for r in similar.cosines(pairs, sets, 0.53).collect()}
    assert got == {("x0", "y0"): 2 / 3, ("x1", "y1"): 32 / 60, ("x3", "y3"): 0.53}


@pytest.mark.parametrize("share", [0.0, 0.02, 2.0])
def test_pairs_that_pass_whether_gathered_or_multiplied(monkeypatch, share):
    """Scores of sketches are the same for few pairs that pass and for many; none that passes both is lost."""
    monkeypatch.setattr(similar, "DENSE", share)
    monkeypatch.setattr(similar, "RESCORED", 7)
    rng = np.random.default_rng(5)
    mine, vectors = (rng.integers(-8, 8, (n, 32)).astype(np.float32) for n in (40, 60))
    table = vectors + rng.integers(-1, 2, vectors.shape).astype(np.float32)
    i, j, s = similar._passing(mine, table, vectors, 150, 200)
    coarse, fine = mine @ table.T, mine @ vectors.T
    want = np.nonzero((coarse >= 150) & (fine >= 200))
    assert len(i) and (i.tolist(), j.tolist(), s.tolist()) == (want[0].tolist(), want[1].tolist(), fine[want].tolist())
    assert not len(similar._passing(mine, table, vectors, 1e9, 0)[0])


def test_many_pairs_that_pass_are_not_gathered(monkeypatch):
    """A fifth of the pairs pass: no row is gathered for a pair, as it was before."""
    monkeypatch.setattr(np, "einsum", None)
    rng = np.random.default_rng(6)
    mine, vectors = (rng.normal(size=(n, 32)).astype(np.float32) for n in (40, 60))
    assert len(similar._passing(mine, vectors, vectors, 5.0, 5.0)[0]) > 100
