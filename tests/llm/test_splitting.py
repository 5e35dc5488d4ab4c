import random

import pytest

from driftnet.llm import splitting, tokens


def texts(rnd):
    words = ["lake", "storage", "of", "naïve", "湖", "x" * 30, "3.14", "don't"]
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 25))).capitalize() + rnd.choice([". ", "! ", "。", "? "])
    paragraph = lambda: "".join(sentence() for _ in range(rnd.randrange(1, 8)))
    yield "\n\n".join(paragraph() for _ in range(30))
    yield "# One\n\n" + "\n\n\n## Two\n\n".join("\n\n".join(paragraph() for _ in range(5)) for _ in range(6))
    yield paragraph() * 40
    yield "湖水冷" * 700
    yield "".join(rnd.choice("abcdef0123456789") for _ in range(6000))
    yield "🙂👩‍👩‍👧" * 400
    yield "| a | b |\n" * 500
    yield " " * 5000 + "end" + "\n" * 3000
    yield "short text"
    yield "word " * 127 + "word"


@pytest.mark.parametrize("limit,overlap", [(128, 16), (200, 0), (64, 31)])
def test_pieces_cover_overlap_and_fit(limit, overlap):
    s, enc = splitting.Splitter(limit, overlap), tokens.encoding()
    for text in texts(random.Random(limit)):
        raw, spans, at = text.encode(), s.spans(text), 0
        for k, (a, b, n, again) in enumerate(spans):
            piece = raw[a:b].decode()
            assert len(enc.encode_ordinary(piece)) <= limit and (n < 0 or n == len(enc.encode_ordinary(piece)))
            assert a + again == at and b > at
            if k and overlap:
                repeated = raw[a:at].decode()
                ids = enc.encode_ordinary(text)
                ends, here = [0], 0
                for i in ids:
                    here += len(enc.decode_single_token_bytes(i))
                    ends.append(here)
                first, last = ends.index(a), ends.index(at)
                assert overlap <= last - first <= overlap + 4 and repeated
            at = b
        assert at == len(raw)
        assert (len(spans) > 1) == (len(enc.encode_ordinary(text)) > limit)


def test_natural_boundaries_come_first():
    s = splitting.Splitter(60, 8)
    text = "\n\n".join("Every sentence here is plain and short. " * 3 for _ in range(8))
    raw = text.encode()
    for _, b, _, _ in s.spans(text)[:-1]:
        assert raw[:b].rstrip().endswith(b".")
    words = " ".join(f"word{i}" for i in range(300)).encode()
    for _, b, _, _ in s.spans(words.decode())[:-1]:
        assert words[b : b + 1] == b" "


def test_frame(spark):
    rows = [(1, "word " * 3000, "x", 1), (2, "short", "x", 1), (3, None, "x", 1), (4, "", "x", 1), (1, "word " * 3000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, first string, piece int")
    out = splitting.split(df).collect()
    assert {(r["doc_id"], r["piece"], r["pieces"]) for r in out} == {(1, 1, 2), (1, 2, 2), (2, 1, 1)} and len(out) == 5
    assert all(r["tokens"] <= 2048 for r in out) and [r["text"] for r in out if r["doc_id"] == 2] == ["short"]
    big = splitting.split(df, oversized_only=True, with_text=False).collect()
    assert {(r["doc_id"], r["piece"], r["text"]) for r in big} == {(1, 1, None), (1, 2, None)}
    assert splitting.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.Splitter(64, 32)
