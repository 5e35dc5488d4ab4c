import random
import re
from collections import Counter

from driftnet.llm.termcount import TermCounts, count_terms, signed


def brute(texts, least):
    occ, rec = Counter(), Counter()
    for t in texts:
        if t is not None:
            w = [x for x in re.findall(r"[^\W\d_]+", t.lower()) if len(x) >= least]
            occ.update(w)
            rec.update(set(w))
    return {w: (occ[w], rec[w]) for w in occ}


def frame(spark, texts):
    return spark.createDataFrame([(t, i, 0) for i, t in enumerate(texts)], "text string, term int, sign int")


def read(state):
    return {r["term"]: (r["occurrences"], r["records"]) for r in state.counts().collect()}


def sample(rnd, n):
    words = ["alpha", "Beta", "gamma", "d", "éclair", "日本", "x2y", "ALPHA"]
    return [rnd.choice([None, "", " ".join(rnd.choice(words) for _ in range(rnd.randrange(12))), "alpha " * 400]) for _ in range(n)]


def test_deltas_equal_a_recount(spark):
    rnd = random.Random(1)
    first = sample(rnd, 60)
    state = TermCounts(spark, least=2).apply(frame(spark, first))
    assert read(state) == brute(first, 2) and state.n_records == sum(t is not None for t in first)
    second = [t for t in first if rnd.random() < 0.7] + sample(rnd, 20)
    second[3] = "changed to something new"
    state.apply(frame(spark, second), frame(spark, first))
    assert state.version == 2 and read(state) == brute(second, 2) and state.n_records == sum(t is not None for t in second)
    state.apply(frame(spark, []), frame(spark, second))
    assert read(state) == {} and state.n_records == 0


def test_another_session_goes_on(spark, tmp_path):
    path = str(tmp_path / "terms")
    TermCounts(spark, path).apply(frame(spark, ["a b", "b"]))
    again = TermCounts(spark, path)
    assert (again.version, again.n_records, read(again)) == (1, 2, {"a": (1, 1), "b": (2, 2)})
    again.apply_changes(spark.createDataFrame([("b", -1), ("c", 1), (None, 1)], "text string, sign int"))
    assert read(TermCounts(spark, path)) == {"a": (1, 1), "b": (1, 1), "c": (1, 1)}


def test_only_touched_buckets_are_rewritten_and_old_files_go(spark, tmp_path):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    path = tmp_path / "terms"
    state = TermCounts(spark, str(path), bucket_terms=10).apply(frame(spark, words))
    assert state.buckets == 64 and len(state.at) == 64
    state.apply_changes(spark.createDataFrame([(words[0], 1), (words[1], -1)], "text string, sign int"))
    assert len({b for b, v in state.at.items() if v == 2}) <= 2 and read(state) == brute(words[2:] + [words[0]] * 2, 1)
    state.apply_changes(spark.createDataFrame([("a" * 3 + f"x{chr(97 + i % 26)}" * (i // 26 + 1), 1) for i in range(3000)], "text string, sign int"))
    assert state.buckets == 512 and len(read(state)) == 3599 and set(state.at.values()) == {3}
    state.apply_changes(spark.createDataFrame([(words[5], 1)], "text string, sign int"))
    assert sorted(p.name for p in path.iterdir() if not p.name.startswith(".")) == ["meta-3", "meta-4", "v3", "v4"]
    assert TermCounts(spark, str(path), bucket_terms=10).n_records == 600 + 3000 + 1


def test_unchanged_records_give_no_delta(spark):
    a = frame(spark, ["x", "x", "y", None])
    assert signed(a, a).count() == 0
    assert {tuple(r) for r in signed(frame(spark, ["x", "z"]), a).collect()} == {("x", -1), ("y", -1), ("z", 1)}


def test_marks(spark):
    texts = ["common word"] * 9 + ["common once", "twice", "twice", "thrice", "thrice", "thrice"] + ["filler"] * 50 + [None]
    state = TermCounts(spark, least=3).apply(frame(spark, texts))
    marks = {r["term"]: r["mark"] for r in state.marked(3, 0.12).collect()}
    assert marks == {"common": "common", "word": "common", "once": "rare", "twice": "rare", "thrice": None, "filler": "common"}


def test_empty_tables(spark):
    a = spark.createDataFrame([], "work string, abstract string")
    d = spark.createDataFrame([], "desc_id bigint, problem string")
    assert count_terms(a, d).marked().count() == 0
