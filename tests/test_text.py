import hashlib
import json

import pytest
from pyspark.sql import functions as F

from driftnet.functions import text as T


def one(spark, column, **values):
    """The column's value on one row of string columns."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("Über-cool x² 3D don't", ["über", "cool", "x²", "d", "don", "t"]), ("", []), (None, None), ("123 _", []), ("Ⅷ naïve", ["ⅷ", "naïve"])])
def test_words(spark, text, want):
    assert one(spark, T.words(F.col("t")), t=text) == want


def test_token_classes(spark):
    assert one(spark, T.tokens(F.col("t")), t="covid19 a bb_c é2") == ["covid19", "bb_c", "é2"]
    assert one(spark, T.letter_tokens(F.col("t")), t="covid19 and trials in x2y") == ["and", "trials", "in"]
    assert one(spark, T.terms(F.col("t")), t="The lake is on the Fir tree") == ["lake", "fir", "tree"]


def test_clean_and_squeeze(spark):
    text = "Background: a background of \t things. METHODS : done © 2020 (c) All rights reserved end"
    assert one(spark, T.squeeze(T.clean(F.col("t"))), t=text) == "a background of things. done 2020 end"
    assert one(spark, T.word_count(F.col("t")), t="   a b\n") == 2
    assert one(spark, T.word_count(F.col("t")), t=" \n ") == 0


def test_usable(spark):
    english = "this is about the lake and it was found to be cold " * 4
    for text, want in [(english, True), (english[:90], False), ("le lac est froid et il a été trouvé ainsi " * 8, False), ("湖水冷 " * 60, False), (None, False), ("", False)]:
        assert one(spark, T.usable(F.col("t")), t=text) is want


@pytest.mark.parametrize("word,want", [("bus", "bus"), ("gas", "gas"), ("gass", "gas"), ("lakes", "lake"), ("s", "s"), ("moss", "mos")])
def test_stem(spark, word, want):
    assert one(spark, T.stem(F.col("w")), w=word) == want


def test_avoided(spark):
    avoid = T.literal_array(["Lake", "storage", "gases", "none"])
    assert one(spark, T.avoided(F.col("t"), avoid), t="Storages near two LAKES; gase") == ["Lake", "storage", "gases"]


def test_identities(spark):
    assert one(spark, T.short_id(F.col("u")), u="https://x.org/W12") == "W12"
    assert one(spark, T.bridge_id(F.lit("T9"), F.lit("T10"))) == "b-T10-T9"
    assert one(spark, T.safe_name(F.lit("a b/c-d.e"))) == "a_b_c-d.e"
    assert one(spark, T.fingerprint(F.col("a"), F.col("b")), a="The Lake!", b="is, cold") == "the lake is cold"
    model = F.struct(F.lit("m-1").alias("id"), F.lit("local").alias("provider"))
    assert one(spark, T.model_name(model)) == "m-1 (local)"


def test_inverted_text(spark):
    inverted = F.from_json("m", "map<string,array<int>>")
    assert one(spark, T.abstract_text(inverted), m='{"b": [1], "a": [0, 9]}') == "a b a"
    assert one(spark, T.abstract_text(inverted), m=None) == ""


def test_needs_check_is_sha_modulo_twenty(spark):
    ids = [f"u-{i:06d}" for i in range(600)]
    got = {r["u"] for r in spark.createDataFrame([(i,) for i in ids], "u string").filter(T.needs_check(F.col("u"))).collect()}
    assert got == {i for i in ids if int(hashlib.sha256(i.encode()).hexdigest(), 16) % 20 == 0}


@pytest.mark.parametrize("link,key", [
    ("https://arxiv.org/abs/2101.01234v2", "doi:10.48550/arxiv.2101.01234"), ("arxiv.org", None), ("cond-mat/9901001", "doi:10.48550/arxiv.cond-mat/9901001"), ("1234.56789", "doi:10.48550/arxiv.1234.56789"),
    ("https://x.org/articles/PMC123/", "pmcid:PMC123"), ("https://doi.org/10.1000/Ab.1", "doi:10.1000/ab.1"), ("nothing", None), (None, None),
])
def test_link_key(spark, link, key):
    assert one(spark, T.link_key(F.col("l")), l=link) == key


GOOD = {"problem": "what is the lake", "approach": "we ask the lake"}


@pytest.mark.parametrize("said,fault", [
    ("<think>{ }</think> Sure: " + json.dumps(GOOD) + " Bye", None), ("no braces", "no object"), ('{"problem": "a b c d"', "no object"), ("{not json}", "not JSON"),
    (json.dumps({"problem": "what is the lake"}), "a part is missing or no text"), (json.dumps(GOOD | {"problem": 3}), "a part is missing or no text"), (json.dumps([GOOD["problem"]]), "no object"),
    (json.dumps(GOOD | {"approach": "too short"}), "a part is too short"), (None, "no object"), (json.dumps(GOOD | {"problem": None}), "a part is missing or no text"),
])
def test_answers(spark, said, fault):
    got = one(spark, T.answer(F.col("t")), t=said)
    assert got["fault"] == fault
    assert (got["problem"], got["approach"]) == ((GOOD["problem"], GOOD["approach"]) if fault is None else (None, None))


def test_fenced_block_round_trip(spark):
    assert one(spark, T.json_block(T.fenced(F.col("t"))), t='{"a": 1}') == '{"a": 1}'
    assert one(spark, T.json_block(F.col("t")), t="```\n{}\n```") is None
    assert one(spark, T.json_block(F.col("t")), t="x\n```json\r\n{1}\r\n```\n```json\n{2}\n```") == "{1}"


def test_prompt_skips_what_is_missing(spark):
    got = one(spark, T.prompt(F.lit("Do."), F.col("a"), F.col("b"), T.literal_array(["x", "y"])), a="A", b=None)
    assert got == "Do.\n\nTitle: A\n\nDo not use: x, y"
