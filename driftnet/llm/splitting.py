"""Splitting oversized texts at natural boundaries into overlapping pieces under a token limit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm import tokens

LIMIT, OVERLAP = 2048, 64
#: From coarse to fine, over UTF-8 bytes; a cut lies at a match's end. Sections: blank lines before a
#: heading, rules and page breaks; paragraphs; lines and sentences; words; then any character.
SEPARATORS = [
    re.compile(rb"\n[ \t\r]*\n(?=[ \t]*(?:#{1,6} |[=\-*_]{3,}|\d+(?:\.\d+)*\.? [A-Z]))|\f|\n[ \t\r]*\n[ \t\r]*\n+"),
    re.compile(rb"\n[ \t\r]*\n+"),
    re.compile(rb"\n|[.!?]+[\"')\]]*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f"),
    re.compile(rb"(?<=\S)(?=\s)"),
]


class Splitter:
    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = tokens.FOLDER):
        if not 0 <= overlap < limit // 2:
            raise ValueError("the overlap must be under half the limit")
        self.limit, self.overlap, self.enc, self.lengths = limit, overlap, tokens.encoding(folder), tokens.byte_lengths(folder)

    def _atoms(self, raw: bytes, starts: np.ndarray, whole: np.ndarray) -> list[int]:
        """Token positions at which atoms end, each at most limit - overlap tokens long."""
        most, count = self.limit - self.overlap, len(starts) - 1
        ends: list[int] = []

        def split(a: int, b: int, level: int) -> None:
            if b - a <= most:
                ends.append(b)
                return
            if level == len(SEPARATORS):
                at = a
                while b - at > most:
                    cut = at + most
                    while cut > at + 1 and not whole[cut]:  # not inside a character
                        cut -= 1
                    ends.append(cut)
                    at = cut
                ends.append(b)
                return
            cuts = np.fromiter((m.end() for m in SEPARATORS[level].finditer(raw, int(starts[a]), int(starts[b]))), dtype=np.int64)
            # a cut inside a token moves to the token's start
            cuts = np.unique(np.searchsorted(starts, cuts, "right") - 1) if len(cuts) else cuts
            cuts = cuts[(cuts > a) & (cuts < b)]
            cuts = cuts[whole[cuts]] if len(cuts) else cuts
            last = a
            for cut in [*cuts.tolist(), b]:
                if cut - last <= most:
                    ends.append(cut)
                else:
                    split(last, cut, level + 1)
                last = cut

        split(0, count, 0)
        return ends

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(first byte, end byte, tokens, bytes repeated from the piece before) of each piece, in order.

        A text within the limit is one piece; an empty one has none. Pieces cover the text; each but the
        first starts with the last `overlap` tokens of the one before (a few bytes more where those
        would start inside a character). Each piece's own token count is within the limit.
        """
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return []
        if len(raw) <= self.limit:  # a token has a byte at least
            return [(0, len(raw), -1, 0)]
        ids = np.asarray(self.enc.encode_ordinary(text), dtype=np.int64)
        if len(ids) <= self.limit:
            return [(0, len(raw), len(ids), 0)]
        starts = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        view = np.frombuffer(raw + b"\0", dtype=np.uint8)
        whole = (view[starts] & 0xC0) != 0x80
        ends = self._atoms(raw, starts, whole)
        out, begin, done, k = [], 0, 0, 0
        while k < len(ends):
            j = k
            while j + 1 < len(ends) and ends[j + 1] - begin <= self.limit:
                j += 1
            while True:
                end, a, b = ends[j], int(starts[begin]), int(starts[ends[j]])
                # counted again: a piece on its own can tokenise otherwise at its edges
                n = len(self.enc.encode_ordinary(raw[a:b].decode("utf-8", "surrogatepass")))
                if n <= self.limit:
                    break
                if j > k:
                    j -= 1
                    continue
                half = (done + ends[j]) // 2
                while half > done + 1 and not whole[half]:
                    half -= 1
                ends.insert(j, half)
            out.append((a, b, n, int(starts[done]) - a))
            done, k = end, j + 1
            begin = max(0, end - self.overlap)
            while begin > 0 and not whole[begin]:
                begin -= 1
        return out


def _pieces(limit: int, overlap: int, folder: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(limit, overlap, folder)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("first", pa.int64()), ("tokens", pa.int32()), ("repeated", pa.int32()), ("text", pa.string())])
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                spans = splitter.spans(text)
                raw = text.encode("utf-8", "surrogatepass") if with_text and spans else b""
                for i, (a, b, n, again) in enumerate(spans):
                    n = n if n >= 0 else len(splitter.enc.encode_ordinary(text)) if with_text else None
                    body = raw[a:b].decode("utf-8", "surrogatepass") if with_text else None
                    for column, value in zip(rows, (doc, i + 1, len(spans), a, n, again, body)):
                        column.append(value)
                    held += b - a
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
                    rows, held = [[] for _ in schema], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return run


def split(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = tokens.FOLDER, oversized_only: bool = False, with_text: bool = True) -> DataFrame:
    """Cut texts into pieces: (doc_id, piece, pieces, first, tokens, repeated, text).

    piece counts from 1, first is the piece's first byte in the UTF-8 text, repeated the number of its
    bytes that repeat the piece before. A text within the limit is one piece, left out with
    oversized_only; null and empty texts give no piece. Rows that repeat give pieces that repeat.
    Without with_text the column text is null, and so is the count of texts too short to need one.

    Each text is cut on its own, so nothing is shuffled. Rows are spread over tasks as they are
    scanned; very long texts make a batch smaller only in rows, and pieces leave in bounded batches.
    """
    rows = documents.select("doc_id", "text").filter("text is not null and text <> ''")
    if oversized_only:
        rows = rows.filter(F.octet_length("text") > limit)  # a token has a byte at least
    out = rows.mapInArrow(_pieces(limit, overlap, folder, with_text), "doc_id bigint, piece int, pieces int, first bigint, tokens int, repeated int, text string")
    return out.filter("pieces > 1") if oversized_only else out
