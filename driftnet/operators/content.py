"""What topics' texts say: usable texts, their vectors, and how close two topics' texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.functions import text as T
from driftnet.operators import vectors as V


def topic_texts(abstracts: DataFrame, papers: DataFrame, through: int | None = None, least: int = 5, kinds: DataFrame | None = None) -> DataFrame:
    """(work, topic, text): cleaned usable texts, the longest of a work, of topics with `least` or more.

    With `through`, texts of that year and before only; with kinds (work), of those works only.
    """
    said = abstracts.filter("abstract is not null and abstract <> '' and work is not null")
    if through is not None:
        said = said.filter(F.col("year") <= through)
    if kinds is not None:
        said = said.join(kinds.select("work").distinct(), "work", "left_semi")
    said = said.select("work", F.concat_ws(" ", "title", "abstract").alias("text"))
    one = said.groupBy("work").agg(F.min(F.struct(-F.length("text"), "text")).alias("x")).select("work", F.col("x.text").alias("text")).filter(T.usable(F.col("text")))
    topic = papers.filter("work is not null and topic is not null").groupBy("work").agg(F.min("topic").alias("topic"))
    rows = one.join(topic, "work")
    if least > 1:
        many = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        rows = rows.join(many, "topic", "left_semi")
    return rows.select("work", "topic", T.clean(F.col("text")).alias("text"))


def usable_counts(texts: DataFrame) -> DataFrame:
    """(topic, usable): how many usable texts each topic has; topics without any have no row."""
    return texts.groupBy("topic").agg(F.count(F.lit(1)).alias("usable"))


def topic_vectors(texts: DataFrame) -> DataFrame:
    """(doc, topic, term, w): TF-IDF vectors of topics' texts, fitted on these texts only."""
    tf = V.doc_terms(texts, "work", T.without(T.letter_tokens(F.col("text")), [*T.STOP_WORDS, *T.BOILERPLATE]), "topic")
    return V.tfidf(tf, texts.agg(F.count(F.lit(1)).alias("n")), 2, 0.5, ("topic",))


def centroid_cosines(vectors: DataFrame) -> DataFrame:
    """(a, b, cosine), a < b, of topics' mean vectors; topics that share no term aren't listed."""
    return V.block_cosines(V.mean_vectors(vectors, "topic"), "topic")


#: Texts of a topic that closest_texts compares with other topics' by default, and how many of the highest cosines count.
FIRST, HIGHEST = 20, 5
#: Topics in a block, which bounds what a task keeps of pairs of topics.
BLOCK_TOPICS = 1500
#: Blocks that tables of fewer topics are cut into, so that there are enough tasks; a topic goes to as many.
FEW_BLOCKS = 6
#: Topics of a block that are compared with another block at once.
SLICE = 32
#: Texts of a block that are compared at once with how many of another's: what bounds a task's matrices, however many a topic has.
TEXTS, HELD_TEXTS = 640, 8192


def blocks_of(n: int) -> int:
    """How many blocks n topics are cut into."""
    return max(1, -(-n // BLOCK_TOPICS), min(FEW_BLOCKS, n // 100))


def in_tiles(rows: DataFrame, own: Column, blocks: int) -> DataFrame:
    """rows with their block `own`, once for every pair of blocks (x, y), x <= y, that has it."""
    each = rows.select("*", own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_to"))
    return each.withColumns({"x": F.least("own", "_to"), "y": F.greatest("own", "_to")}).drop("_to")


def topic_cells(vectors: DataFrame, centres: bool = True, first: int | None = FIRST) -> DataFrame:
    """(topic, tt, tw, tn, ct, cw): the vectors of each topic's `first` texts by name, or of all with None, one after another,
    with their lengths, and its mean vector; terms stand for themselves by 64-bit hashes. Without `centres` ct and cw are null."""
    lists = [F.collect_list(F.xxhash64("term")).alias("t"), F.collect_list("w").alias("w")]
    docs = vectors.groupBy("topic", "doc").agg(*lists)  # a document's own terms
    if first is not None:
        docs = docs.withColumn("r", F.row_number().over(W.partitionBy("topic").orderBy("doc"))).filter(F.col("r") <= first)
    texts = docs.groupBy("topic").agg(F.collect_list(F.struct("t", "w")).alias("v"))  # a topic's own texts
    texts = texts.select("topic", F.flatten("v.t").alias("tt"), F.flatten("v.w").alias("tw"), F.transform("v", lambda v: F.size(v["t"])).alias("tn"))
    if not centres:
        return texts.withColumns({"ct": F.lit(None).cast("array<bigint>"), "cw": F.lit(None).cast("array<double>")})
    mean = V.mean_vectors(vectors, "topic").groupBy("topic").agg(lists[0].alias("ct"), lists[1].alias("cw"))  # a topic's own terms
    return texts.join(mean, "topic")


class Topics:
    """A block of topics' vectors as flat arrays, from columns tt, tw, tn, ct, cw; topics may lack them."""

    def __init__(self, rows: pa.Table):
        flat = lambda c: np.asarray(rows.column(c).combine_chunks().flatten())
        lengths = lambda c: np.asarray(rows.column(c).combine_chunks().value_lengths().fill_null(0)).astype(np.int64)
        self.n = rows.num_rows
        self.texts, self.sizes = (flat("tt"), flat("tw")), flat("tn").astype(np.int64)
        self.centres, self.terms = (flat("ct"), flat("cw")), lengths("ct")
        at = lambda n: np.concatenate([[0], np.cumsum(n)])
        self.text_at, self.term_at = at(lengths("tn")), at(self.terms)
        self.word_at = at(self.sizes)

    def some_texts(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return *(x[self.word_at[a] : self.word_at[b]] for x in self.texts), self.sizes[a:b]

    def parts(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(topic, first, end) of the topics that texts a to b are of, counted from a."""
        for k in range(int(np.searchsorted(self.text_at, a, side="right")) - 1, int(np.searchsorted(self.text_at, b))):
            first, end = max(a, int(self.text_at[k])) - a, min(b, int(self.text_at[k + 1])) - a
            if first < end:
                yield k, first, end

    def some_centres(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return *(x[self.term_at[i] : self.term_at[j]] for x in self.centres), self.terms[i:j]


def compared(left: Topics, right: Topics, top: int = HIGHEST) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, centre, closest, shared) for left's topics i to j against all of right's: the cosine of their mean
    vectors, the mean of the `top` highest cosines of their texts, and whether any two texts share a term.

    Cosines of texts are rounded to six digits. With fewer pairs of texts than `top` the mean is over all.
    """
    best, shared = np.full((left.n, right.n, top), -np.inf), np.zeros((left.n, right.n), dtype=bool)
    for lo in range(0, len(right.sizes), HELD_TEXTS):
        hi = min(lo + HELD_TEXTS, len(right.sizes))
        texts, of = V._Block(*right.some_texts(lo, hi)), np.array(list(right.parts(lo, hi)))
        many = of[:, 2] - of[:, 1]
        alike = [of[many == c] for c in np.unique(many)]  # topics of as many texts, compared at once
        alike = [(x[:, 0], x[:, 1:2] + np.arange(x[0, 2] - x[0, 1])[None, :]) for x in alike]
        for a in range(0, len(left.sizes), TEXTS):
            b = min(a + TEXTS, len(left.sizes))
            s = texts.products(*left.some_texts(a, b))
            for k, first, end in left.parts(a, b):
                most, own = s[first:end].max(axis=0), np.round(s[first:end], 6)
                for js, at in alike:
                    v = own[:, at].transpose(1, 0, 2).reshape(len(js), -1)
                    if v.shape[1] > top:
                        v = np.partition(v, v.shape[1] - top, axis=1)[:, -top:]
                    v = np.concatenate([best[k, js], v], axis=1)  # what other parts of the two had
                    best[k, js] = np.sort(v, axis=1)[:, : -top - 1 : -1]
                    shared[k, js] |= most[at].max(axis=1) > 0
    centres, pairs = V._Block(*right.centres, right.terms), np.multiply.outer(np.diff(left.text_at), np.diff(right.text_at))
    for i in range(0, left.n, SLICE):
        j = min(i + SLICE, left.n)
        centre = centres.products(*left.some_centres(i, j))
        closest = np.where(np.isfinite(best[i:j]), best[i:j], 0).sum(axis=2) / np.clip(pairs[i:j], 1, top)
        yield i, j, centre, closest, shared[i:j]


def closest_texts(vectors: DataFrame, first: int | None = FIRST, top: int = HIGHEST) -> DataFrame:
    """(a, b, closest), a < b: mean of the `top` highest cosines of the `first` texts of two topics, by name, or of all with None.

    Pairs of texts that share no term count as 0; with fewer pairs than `top`, the mean is over all. Topics
    without any such pair aren't listed. No row is made for a pair of texts: blocks of topics meet in pairs.
    """
    cells = session.stage(topic_cells(vectors, False, first), "cells")
    blocks = blocks_of(cells.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        own, x, y = (np.asarray(rows.column(c)) for c in ("own", "x", "y"))
        one, two = (rows.filter(pa.array(own == side[0])) for side in (x, y))
        p, q = (np.array(t.column("topic").to_pylist(), dtype=object) for t in (one, two))
        for i, j, _, closest, shared in compared(Topics(one), Topics(two), top) if len(p) and len(q) else ():
            low = p[i:j, None] < q[None, :]
            r, c = np.nonzero(shared & (low if x[0] == y[0] else True))
            a, b, low = p[i:j][r], q[c], low[r, c]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(low, a, b), pa.string()), pa.array(np.where(low, b, a), pa.string()), pa.array(closest[r, c])], names=["a", "b", "closest"])

    return in_tiles(cells, F.pmod(F.xxhash64("topic"), F.lit(blocks)), blocks).groupBy("x", "y").applyInArrow(run, "a string, b string, closest double")


def content(texts: DataFrame) -> DataFrame:
    """(a, b, centroid_cos, top_pairs_cos), a < b, of topics that share a term in either way, staged."""
    vectors = session.stage(topic_vectors(texts), "topic-vectors")
    centre = centroid_cosines(vectors).withColumnRenamed("cosine", "centroid_cos")
    return session.stage(centre.join(closest_texts(vectors).withColumnRenamed("closest", "top_pairs_cos"), ["a", "b"], "full_outer"), "content")
