import json

import pytest
from pyspark.sql import functions as F

from driftnet.operators import intake as I
from driftnet.operators import units as U
from driftnet.sources import readers
from driftnet.streaming import intake as stream
from tests.world import record


@pytest.mark.parametrize("change,fault", [
    ({}, None), ({"format": 2}, "format"), ({"freeze": None}, "freeze"), ({"train_window": [2011, 2017]}, "train_window"), ({"recent_window": None}, "recent_window"),
    ({"instrument": ["W1", "x"]}, "instrument"), ({"instrument": ["W1"] * 101}, "instrument"), ({"instrument": ["W1", None]}, "instrument"), ({"instrument": []}, None),
    ({"usable_abstracts": 41}, "usable_abstracts"), ({"usable_abstracts": None}, "usable_abstracts"), ({"works_by_year": {"2009": 600}}, "works_by_year"), ({"works_by_year": {"2017": -1}}, "works_by_year"),
    ({"works_by_year": None}, "works_by_year"), ({"size": 601}, "size"), ({"cited_by_train": {"T1": -1}}, "cited_by_train"), ({"cited_by_before": {"x": 1}}, "cited_by_before"), ({"topic": "W1"}, "topic"),
])
def test_record_faults(spark, change, fault):
    base = dict(zip([c.strip().split()[0] for c in (readers.RECORD + ", record string").split(", ")], record("T1"))) | change
    got = spark.createDataFrame([tuple(base.values())], readers.RECORD + ", record string").select(I.record_fault().alias("f")).first()["f"]
    assert (got is None) if fault is None else got.startswith(fault)


DESC = "desc_id bigint, work string, unit string, issue string, author string, model struct<provider:string,id:string>, problem string, approach string, arrived timestamp"
OK = dict(desc_id=1, work="W1", unit="u-1", issue="1", author="me", model=("p", "m"), problem="what is the lake", approach="we ask the lake", arrived=None)


@pytest.mark.parametrize("change,fault", [
    ({}, None), ({"work": "T1"}, "work is no work ID"), ({"author": None}, "no author"), ({"model": ("p", None)}, "no model"), ({"model": None}, "no model"), ({"problem": None}, "a part is missing"),
    ({"problem": ""}, "a part is too short"), ({"approach": "word " * 61}, "a part is too long"), ({"problem": "TODO write this part"}, "a placeholder"),
])
def test_description_faults(spark, change, fault):
    assert spark.createDataFrame([tuple((OK | change).values())], DESC).select(I.description_fault().alias("f")).first()["f"] == fault


def test_near_duplicates_compare_with_accepted_rows_only(spark):
    rows = [("r", 1, "lake storage cold fish"), ("r", 2, "lake storage cold fish river"), ("r", 3, "lake storage cold river stone fish"), ("r", 4, None), ("r", 5, "the of and"), ("s", 6, "lake storage cold fish")]
    got = {r["n"]: r["repeats"] for r in I.near_duplicates(spark.createDataFrame(rows, "g string, n bigint, t string"), "g", "n", "t").collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: None}
    assert I.near_duplicates(spark.createDataFrame([], "g string, n bigint, t string"), "g", "n", "t").count() == 0


SUBS = [("u1", "2", "x", "A"), ("u1", "10", "y", "A"), ("u1", "import-1", "z", "B"), ("u2", "5", "x", "A"), ("u3", "1", "x", "A"), ("u3", "2", "x", "B"), ("u3", "3", "y", "C"), ("u4", "1", "x", None)]
STATES = {"u1": ("done", ["A", "B"], 2, 1), "u2": ("check", ["A"], 1, 0), "u3": ("done", ["A", "B"], 2, 1)}


def states(df):
    return {r["unit"]: (r["status"], list(r["models"]), r["accepted"], r["refused"]) for r in df.collect()}


def test_unit_states(spark):
    df = spark.createDataFrame(SUBS, "unit string, issue string, author string, model string")
    assert states(I.unit_states(df)) == STATES
    assert I.unit_states(df.limit(0)).count() == 0


def test_the_stream_comes_to_the_same_states(spark, tmp_path):
    rows = spark.createDataFrame([(u, i, a, m, None) for u, i, a, m in SUBS * 2], stream.SUBMISSION)
    folder = str(tmp_path / "s")
    assert states(stream.replay(spark, rows, folder, files=5)) == STATES
    store = stream.Store(spark, f"{folder}/store")
    assert store.submissions().count() == len(SUBS)  # repeated issues counted once
    before = store.head()
    store.apply(rows, 0)  # a batch that comes again changes nothing
    assert store.head() == before
    assert stream.accepted_by_day(rows).count() >= 0


def test_map_units(spark):
    ids = [f"u-{i:06d}" for i in range(400)]
    from driftnet.functions import text as T

    flagged = {r["unit"] for r in spark.createDataFrame([(i,) for i in ids], "unit string").filter(T.needs_check(F.col("unit"))).collect()}
    checked, plain = sorted(flagged)[0], next(i for i in ids if i not in flagged)
    rows = [(plain, 1, "x", False, True), (plain, 2, "x", True, True), (plain, 3, "y", True, True)]
    rows += [(checked, 1, "x", True, True), (checked, 2, "x", True, True), (checked, 3, "y", True, False)]
    got = {r["unit"]: (r["status"], list(r["outcomes"])) for r in I.map_unit_states(spark.createDataFrame(rows, "unit string, n int, author string, valid boolean, agrees boolean")).collect()}
    assert got == {plain: ("done", ["invalid", "accepted", "complete"]), checked: ("disputed", ["accepted", "another volunteer is needed", "accepted"])}


def test_drift(spark):
    a = [f"W{i}" for i in range(20)]
    frame = lambda rows: spark.createDataFrame(rows, "topic string, instrument array<string>, cited_by_train map<string,bigint>")
    first = frame([("T1", a, {"T2": 100}), ("T2", a, {"T1": 100}), ("T3", a, None), ("T4", None, {"T1": 1})])
    second = frame([("T1", a[:19], {"T2": 105}), ("T2", a[:15], {"T1": 100}), ("T3", a, {"T1": 6}), ("T4", None, {"T1": 1})])
    assert {r["topic"]: r["agrees"] for r in I.drift(first, second, ["topic"]).collect()} == {"T1": True, "T2": False, "T3": False, "T4": False}


def test_parse_submissions(spark):
    good = {"unit": "u-1", "prompt": "p", "model": {"provider": "x", "id": "y"}, "descriptions": [{"work": "W1", "problem": "a", "approach": "b"}]}
    fence = lambda x: f"Hello\n```json\n{x}\n```\n"
    rows = [("1", fence(json.dumps(good))), ("2", "nothing"), ("3", fence("{oops")), ("4", fence(json.dumps({"descriptions": good["descriptions"]}))), ("5", fence(json.dumps(good | {"descriptions": []}))), ("6", None)]
    got = {r["issue"]: r["fault"] for r in I.parse_submissions(spark.createDataFrame([(i, "me", b) for i, b in rows], "issue string, author string, body string")).collect()}
    assert got == {"1": None, "2": "no fenced JSON block", "3": "the block is not JSON", "4": "no unit", "5": "no descriptions", "6": "no fenced JSON block"}


def test_relevance(spark):
    abstracts = spark.createDataFrame([(f"W{i}", f"subject{i} lake common") for i in range(6)], "work string, abstract string")
    right = [("u", "1", i, f"W{i}", f"about subject{i} common") for i in range(6)]
    wrong = [("u", "2", 10 + i, f"W{i}", f"about subject{(i + 1) % 6} common") for i in range(6)]
    few = [("u", "3", 20 + i, f"W{i}", f"about subject{i}") for i in range(3)]
    got = {r["issue"]: (r["known"], r["relevance"]) for r in I.relevance(spark.createDataFrame(right + wrong + few, "unit string, issue string, desc_id bigint, work string, text string"), abstracts).collect()}
    assert got == {"1": (6, 1.0), "2": (6, 0.0), "3": (3, None)}


def test_contributors_and_merge(spark):
    rows = spark.createDataFrame([("u1", "a"), ("u1", "a"), ("u2", "b"), ("u3", None)], "unit string, who string")
    c = I.contributors(rows, "who")
    assert [tuple(r) for r in c.collect()] == [("a", 1, 2), ("b", 1, 1)]
    other = spark.createDataFrame([("b", 2, 5), ("c", 1, 1)], "name string, units bigint, descriptions bigint")
    assert {tuple(r) for r in I.merge_contributors(c, other).collect()} == {("a", 1, 2), ("b", 3, 6), ("c", 1, 1)}


def test_rejections_come_latest_first(spark):
    rows = spark.createDataFrame([(1, "9"), (2, "10"), (3, "import-a"), (4, "10")], "desc_id bigint, issue string")
    assert [r["desc_id"] for r in I.latest_rejections(rows, 3).collect()] == [3, 4, 2]


def test_units(spark):
    ids = spark.createDataFrame([(f"W{i}",) for i in range(45)] * 2 + [(None,)], "work string")
    got = U.chunks(ids.repartition(5), "work", 20, 1).collect()
    assert sorted(r["work"] for r in got) == sorted(f"W{i}" for i in range(45))
    assert {r["unit"]: 0 for r in got}.keys() == {"u-000000", "u-000001", "u-000002"}
    assert {(r["unit"], r["position"], r["work"]) for r in got} == {(r["unit"], r["position"], r["work"]) for r in U.chunks(ids.orderBy("work"), "work", 20, 1).collect()}
    assert U.chunks(ids.limit(0), "work", 20, 1).count() == 0
    made = U.shuffled_units([f"T{i}" for i in range(4516)], 10, 2026)
    assert len(made) == 452 and made == U.shuffled_units([f"T{i}" for i in range(4515, -1, -1)], 10, 2026)


def test_benchmark_units(spark):
    gold, filler = (spark.createDataFrame([(f"{k}{i}",) for i in range(n)], "work string") for k, n in (("G", 12), ("F", 200)))
    rows = U.mix_benchmark(gold, filler.union(gold), "work").collect()
    per = {}
    for r in rows:
        per.setdefault(r["unit"], []).append(r["is_gold"])
    assert sorted((sum(v), len(v)) for v in per.values()) == [(2, 17), (5, 20), (5, 20)]


def test_pick_unit(spark):
    units = spark.createDataFrame([("u1", "open", []), ("u2", "check", ["m"]), ("u3", "check", ["n"]), ("u4", "check", ["n"]), ("u5", "done", [])], "unit string, status string, models array<string>")
    done = spark.createDataFrame([("u3",)], "unit string")
    assert U.pick_unit(units, done, "m").first()["unit"] == "u4"
    assert U.pick_unit(units, done, "n").first()["unit"] == "u2"


def test_results_are_checked_whole(spark):
    at = lambda **k: tuple((OK | k).values())
    say = lambda x: {"problem": f"which {x} holds the {x} best", "approach": f"we measure each {x} twice a {x} year"}
    good = lambda unit, issue, first, m="m", **k: [at(desc_id=first + i, unit=unit, issue=issue, work=f"W{i}", model=("p", m), **(say(w) | k)) for i, w in enumerate(("lake", "river", "pond", "brook"))]
    rows = good("u-1", "1", 10) + good("u-1", "2", 20)[:3] + good("u-1", "3", 30)[:2] + good("u-1", "4", 40, "n") + good("u-1", "5", 50, "o")
    rows += [at(desc_id=60, unit="u-1", issue="6", work="W9"), *good("u-1", "7", 70), at(desc_id=79, unit="u-1", issue="7", work="W0")]
    rows += good("u-1", "8", 80)[:3] + [at(desc_id=88, unit="u-1", issue="8", work="W3", **say("lake"))]
    rows += good("u-1", "9", 90)[:3] + [at(desc_id=99, unit="u-1", issue="9", work="W3", author=None)]
    rows += good("u-2", "1", 100) + [at(desc_id=200, unit=None), at(desc_id=201, issue=None)]
    works = spark.createDataFrame([(u, f"W{i}") for u in ("u-1", "u-2") for i in range(4)], "unit string, work string")
    avoid = spark.createDataFrame([("W0", ["lake", "year", "measure"]), ("W1", None)], "work string, avoid array<string>")
    texts = spark.createDataFrame([(f"W{i}", t) for i, t in enumerate(("lake", "river", "pond", "brook"))], "work string, abstract string")
    df = spark.createDataFrame(rows, DESC)
    loose = I.checked_results(df, works, avoid.limit(0), texts)
    got = {(r["unit"], r["issue"]): r["fault"] for r in loose.collect()}
    assert got == {
        ("u-1", "1"): None, ("u-1", "2"): None, ("u-1", "3"): "too few papers are described", ("u-1", "4"): None, ("u-1", "5"): None, ("u-1", "6"): "a paper isn't the unit's",
        ("u-1", "7"): "a paper is described twice", ("u-1", "8"): "two descriptions are alike", ("u-1", "9"): "a description is at fault", ("u-2", "1"): None,
    }
    said = {(r["unit"], r["issue"]): (r["outcome"], r["reason"]) for r in I.outcomes(loose).collect()}
    assert said["u-1", "1"] == ("stored", None) and said["u-1", "2"] == ("refused", "the unit has a result of this model") and said["u-1", "4"] == ("stored", None)
    assert said["u-1", "5"] == said["u-1", "6"] == ("complete", None) and said["u-1", "3"][0] == "refused" and said["u-2", "1"][0] == "stored"
    strict = {r["issue"]: r["fault"] for r in I.checked_results(df.filter("unit = 'u-1'"), works, avoid, texts).collect()}
    assert strict["1"] == "too many avoided words"
    other = I.checked_results(df.filter("unit = 'u-2'"), works, avoid.limit(0), texts.withColumn("abstract", F.element_at(F.create_map(*[F.lit(x) for kv in zip(("lake", "river", "pond", "brook"), ("river", "pond", "brook", "lake")) for x in kv]), F.col("abstract"))))
    assert other.first()["fault"] == "descriptions of other papers"
    asked = I.checked_results(df.withColumn("prompt", F.lit("old")), works, avoid.limit(0), texts, I.SubmissionRules(prompt="new"))
    assert {r["fault"] for r in asked.collect()} == {"made with another prompt"}
    assert I.checked_results(df.limit(0), works, avoid, texts).count() == 0 and I.outcomes(loose.limit(0)).count() == 0


def test_a_batch_goes_through_the_same_rules(spark):
    stored = spark.createDataFrame([("u-1", "1", "A")], "unit string, issue string, model string")
    batch = spark.createDataFrame([("u-1", "b.json", "A", None), ("u-1", "c.json", "B", None), ("u-1", "d.json", "C", None), ("u-2", "a.json", "A", "too short")], "unit string, file string, model string, fault string")
    got = {r["id"]: (r["accepted"], r["reason"]) for r in I.import_batch(batch, stored, "x").collect()}
    assert got == {"import-x-001": (False, "too short"), "import-x-002": (False, "the unit has a result of this model"), "import-x-003": (True, None), "import-x-004": (False, "the unit is complete")}


def test_record_results(spark):
    import hashlib

    names = [c.strip().split()[0] for c in (readers.RECORD + ", record string").split(", ")]
    rec = lambda t, **k: dict(zip(names, record(t, **k)))
    body = lambda *r, unit="m-1", freeze=2017: json.dumps({"unit": unit, "freeze": freeze, "records": list(r)})
    sent = {"ok": body(rec("T1"), rec("T2")), "order": body(rec("T2"), rec("T1")), "unit": body(rec("T1"), rec("T2"), unit="m-2"), "bad": body(rec("T1"), rec("T2", size=1)), "text": "not json", "sum": body(rec("T1"), rec("T2"))}
    rows = [(k, "m-1", v, hashlib.sha256((v if k != "sum" else "x").encode()).hexdigest()) for k, v in sent.items()] + [("none", "m-9", "{}", None)]
    units = spark.createDataFrame([("m-1", 2017, ["T1", "T2"])], "unit string, freeze int, topics array<string>")
    got = {r["result"]: r["fault"] for r in I.checked_record_results(spark.createDataFrame(rows, "result string, unit string, content string, sha256 string"), units).collect()}
    assert got == {"ok": None, "order": "its topics aren't the unit's, in order", "unit": "it is for another unit or freeze", "bad": "T2: size isn't the sum of the years' counts", "text": "it isn't JSON", "sum": "the checksum is another", "none": "there is no such unit"}


def test_a_part_without_its_head_does_not_count(spark, tmp_path):
    store = stream.Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("u1", "1", "x", "A", None)], stream.SUBMISSION)
    store.apply(rows, 0)
    spark.createDataFrame([("u9", "9", "x", "A", None)], stream.SUBMISSION).write.parquet(f"{store.folder}/part-2")  # a crash before the head
    assert store.head() == {"version": 1, "batch": 0} and store.submissions().count() == 1
    store.apply(rows.unionByName(spark.createDataFrame([("u1", "2", "y", "B", None)], stream.SUBMISSION)), 1)
    assert store.head() == {"version": 2, "batch": 1} and {r["issue"] for r in store.submissions().collect()} == {"1", "2"}


def test_small_reports(spark):
    rated = I.bridge_ratings(spark.createDataFrame([("W2", "W1", 1.0, "expert"), ("W1", "W2", 0.0, "?")], "a string, b string, rating double, expertise string"), {"expert": 3.0})
    assert [tuple(r) for r in rated.collect()] == [("b-W1-W2", 2, 0.5, 0.75)]
    w = {r["model"]: r["weight"] for r in I.shrunk_weights(spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 1)], "model string, hit int")).collect()}
    assert w["b"] == 0 and w["a"] > 0
    assert [r["f"] for r in spark.createDataFrame([(None,), ("",), ("abc",)], "c string").select(I.content_fault(F.col("c"), 2).alias("f")).collect()] == ["no content", "nothing in it", "larger than 2 bytes"]


def test_what_hangs_on_submissions_follows_each_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", str(i), "x", "AB"[i % 2], None) for i in range(6)], stream.SUBMISSION)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, seen = stream.Store(spark, str(tmp_path / "store")), []
    stream.run(source, store, str(tmp_path / "c"), lambda s, i: seen.append((i, s.states().count()))).awaitTermination()
    assert [i for i, _ in seen] == [0, 1, 2] and seen[-1][1] == 6 and seen == sorted(seen)


def test_rankings_and_rehearsals(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "a"],), (["a", "c"],), (["a"],), ([],), (None,)], "r array<string>")
    got = [r["f"] for r in df.select(I.ranking_fault(F.col("r"), F.array(F.lit("b"), F.lit("a"))).alias("f")).collect()]
    assert got == [None, "an item is ranked twice", "an item isn't the unit's", "an item isn't ranked", "nothing is ranked", "nothing is ranked"]
    papers = spark.createDataFrame([("W1", " ".join(f"word{i}" for i in range(20))), ("W2", "short")], "work string, abstract string")
    rows = I.rehearsal(papers).withColumns({"author": F.lit("me"), "model": F.struct(F.lit("p").alias("provider"), F.lit("m").alias("id"))})
    assert {(r["kind"], r["work"]): r["f"] for r in rows.select("kind", "work", I.description_fault().alias("f")).collect()} == {("sound", "W1"): None, ("sound", "W2"): "a part is too short", ("junk", "W1"): "a part is too short", ("junk", "W2"): "a part is too short"}


def test_word_lists_and_clearing(spark, tmp_path):
    from driftnet import session
    from driftnet.functions import text as T

    (tmp_path / "stops.txt").write_text("The of # common\n# more\nand\n")
    assert T.word_list(str(tmp_path / "stops.txt")) == ["the", "of", "and"]
    assert T.changed_list(["the", "of", "and"], ["of"], ["ltd", "the"]) == ["the", "and", "ltd"]
    path = session.stage_path(spark, "x")
    spark.range(3).write.parquet(path)
    folder = path.rsplit("/", 1)[0].removeprefix("file:")
    import os

    assert os.path.isdir(folder)
    session.clear_staged(spark)
    assert not os.path.isdir(folder)
