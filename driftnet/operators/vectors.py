"""TF-IDF vectors in long form, and what is computed from them. A vector is a set of rows (doc, term, w)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.plans import skew


def doc_terms(docs: DataFrame, doc: str, tokenised: Column, *keep: str) -> DataFrame:
    """(doc, term, tf, and the columns kept); a document without terms has no row."""
    exploded = docs.select(F.col(doc).alias("doc"), *keep, F.explode(tokenised).alias("term"))
    return exploded.groupBy("doc", "term", *keep).agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Terms whose numbers may be sent to all tasks: some 40 MB.
MOST_TERMS = 1_000_000


def with_terms(tf: DataFrame, per_term: DataFrame) -> DataFrame:
    """Rows of tf with their term's row of per_term (term, df, ...); terms that aren't there are dropped.

    Counted first: few terms are broadcast, so that no row of tf moves. More are joined by a shuffle,
    except that rows of the most common terms stay where they are.
    """
    per_term = session.stage(per_term, "terms")
    if per_term.count() <= MOST_TERMS:
        return tf.join(F.broadcast(per_term), "term")
    most = per_term.filter(F.col("df") >= skew.HOT_ROWS).orderBy(F.desc("df"), "term").limit(int(1 / skew.HOT_SHARE)).select("term").collect()
    return skew.lookup_join(tf, per_term, "term", hot=[r["term"] for r in most])


def tfidf(tf: DataFrame, n: DataFrame | int, min_df: int = 1, max_share: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, term, w, and the columns kept): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), rows of unit length.

    n is the number of documents, a number or a one-row frame with column n. Terms in fewer than
    min_df documents or in more than max_share of them are dropped before lengths are taken.
    """
    tf = session.stage(tf, "tf")
    df = document_frequency(tf)
    df = df.withColumn("n", F.lit(n)) if isinstance(n, int) else df.crossJoin(F.broadcast(n))  # one row
    df = df.filter((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_share))
    raw = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    weighted = with_terms(tf, df).select("doc", "term", *keep, raw.alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("doc")))  # a document's own terms
    return weighted.select("doc", "term", (F.col("raw") / length).alias("w"), *keep)


def mean_vectors(vectors: DataFrame, group: str, sizes: DataFrame | None = None) -> DataFrame:
    """(group, term, w): the groups' mean vectors, of unit length.

    The length of a mean doesn't depend on how many documents share it, so sizes only matter where the
    unnormalised mean is wanted, and aren't needed here.
    """
    sums = vectors.groupBy(group, "term").agg(F.sum("w").alias("s"))
    length = sums.groupBy(group).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("len"))
    return sums.join(length, group).select(group, "term", (F.col("s") / F.col("len")).alias("w"))


def cosine_pairs(vectors: DataFrame, key: str, condition: Column | None = None, payload: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, cosine) of all keys a < b that share a term; pairs that share none have cosine 0 and no row.

    A self-join of the postings on the term. condition, over columns <payload>_a and <payload>_b, is
    part of the join, so pairs that don't matter are never formed.
    """
    left = vectors.select("term", F.col(key).alias("a"), F.col("w").alias("wa"), *[F.col(c).alias(f"{c}_a") for c in payload])
    right = vectors.select("term", F.col(key).alias("b"), F.col("w").alias("wb"), *[F.col(c).alias(f"{c}_b") for c in payload])
    both = left.join(right, (left["term"] == right["term"]) & (F.col("a") < F.col("b")) & (condition if condition is not None else F.lit(True)))
    return both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


#: Groups in a block of block_cosines: what bounds a task's matrices.
BLOCK_DOCS = 1000
#: Groups whose pairs block_cosines gives, one row each; more are refused.
MOST_GROUPS = 20_000
#: Terms of the vectors that are sent to all tasks at once, some 10 MB.
BLOCK_TERMS = 500_000
#: Distances of groups that may be sent to all tasks.
MOST_DISTANCES = 1_000_000
#: Vectors that are multiplied at once: asked for, and held.
ASKED, STRIPE = 512, 1000


def _cells(vectors: DataFrame, key: str, block_docs: int, *keep: str) -> DataFrame:
    """(doc, g, t, w, own, x, y): each key's vector as arrays, once for every pair of blocks that has its own."""
    docs = vectors.groupBy(F.col(key).alias("doc"), *keep).agg(F.collect_list(F.xxhash64("term")).alias("t"), F.collect_list("w").alias("w"))  # a document's own terms
    n = vectors.select(key).distinct().count()
    blocks = max(1, -(-n // block_docs))
    own = F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int")
    cells = docs.select("doc", *[F.col(c).alias("g") for c in keep], "t", "w", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to"))
    return cells.withColumns({"x": F.least("own", "to"), "y": F.greatest("own", "to")}).drop("to")


def _dense(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both blocks as matrices over the terms they share."""
    flat = [np.concatenate([np.asarray(t) for t in side["t"]]) for side in (left, right)]
    terms = np.intersect1d(*flat)
    out = []
    for side, ids in zip((left, right), flat):
        m = np.zeros((len(side), len(terms)))
        if len(terms):
            row = np.repeat(np.arange(len(side)), [len(t) for t in side["t"]])
            at = np.minimum(np.searchsorted(terms, ids), len(terms) - 1)
            ok = terms[at] == ids
            m[row[ok], at[ok]] = np.concatenate([np.asarray(w) for w in side["w"]])[ok]
        out.append(m)
    return out[0], out[1]


def block_cosines(vectors: DataFrame, key: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """As cosine_pairs without a condition, for dense vectors such as centroids: pairs of blocks are matrix products.

    Where vectors share most of their terms, a join makes a row for each pair and shared term; this
    makes one for each pair. Keys are strings, MOST_GROUPS at most. Cosines of 0 are left out.
    """
    if vectors.select(key).distinct().count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups, whose pairs are a row each")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
        left, right = pdf[pdf["own"] == x], pdf[pdf["own"] == y]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "cosine": pd.Series(dtype=float)})
        one, two = _dense(left, right)
        s = one @ two.T
        i, j = np.nonzero(s)
        p, q, c = left["doc"].to_numpy()[i], right["doc"].to_numpy()[j], s[i, j]
        once = p < q if x == y else np.ones(len(p), dtype=bool)
        low = p < q
        return pd.DataFrame({"a": np.where(low, p, q)[once], "b": np.where(low, q, p)[once], "cosine": c[once]})

    return _cells(vectors, key, block_docs).groupBy("x", "y").applyInPandas(product, "a string, b string, cosine double")


class _Block:
    """Vectors held by every task, to be multiplied with others: common terms as a matrix, rare ones as postings."""

    def __init__(self, flat: np.ndarray, w: np.ndarray, sizes: np.ndarray, most_dense: int = 1024):
        self.n = len(sizes)
        rows = np.repeat(np.arange(self.n), sizes)
        self.known, ids = np.unique(flat, return_inverse=True)
        df = np.bincount(ids, minlength=len(self.known))
        common = np.flatnonzero(df * 50 > self.n)
        common = common[np.argsort(-df[common], kind="stable")[:most_dense]]
        self.column = np.full(len(self.known), -1)
        self.column[common] = np.arange(len(common))
        dense = self.column[ids] >= 0
        self.matrix = np.zeros((len(common), self.n))
        self.matrix[self.column[ids[dense]], rows[dense]] = w[dense]
        order = np.flatnonzero(~dense)[np.argsort(ids[~dense], kind="stable")]
        self.row, self.w = rows[order], w[order]
        self.size = np.bincount(ids[order], minlength=len(self.known))
        self.start = np.cumsum(self.size) - self.size

    def products(self, flat: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(rows, n) products of the given vectors with those held."""
        m = len(sizes)
        if not len(self.known) or not len(flat):
            return np.zeros((m, self.n))
        rows, at = np.repeat(np.arange(m), sizes), np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        ok = self.known[at] == flat
        rows, at, w = rows[ok], at[ok], w[ok]
        c = self.column[at]
        left = np.zeros((m, len(self.matrix)))
        left[rows[c >= 0], c[c >= 0]] = w[c >= 0]
        out = left @ self.matrix
        rows, at, w = rows[c < 0], at[c < 0], w[c < 0]
        n = self.size[at]
        ends = np.cumsum(n)
        post = np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return out + np.bincount(np.repeat(rows * self.n, n) + self.row[post], weights=np.repeat(w, n) * self.w[post], minlength=m * self.n).reshape(m, self.n)


class _Stripes:
    """As _Block, of positive weights. Products come a stripe of the vectors held at a time, so that what is multiplied stays in a core's
    cache, and in single precision; those that matter can be had exactly."""

    def __init__(self, known: np.ndarray, ids: np.ndarray, w: np.ndarray, sizes: np.ndarray, most_dense: int = 1024):
        self.known, self.ids, self.w, self.sizes, self.n = known, ids, w, sizes, len(sizes)
        df = np.bincount(ids, minlength=len(known))
        common = np.flatnonzero(df * 50 > self.n)
        common = common[np.argsort(-df[common], kind="stable")[:most_dense]]
        self.column = np.full(len(known), -1)
        self.column[common] = np.arange(len(common))
        ends, self.stripes = np.concatenate([[0], np.cumsum(sizes)]), []
        self.first, self.length = ends[:-1], self._length(np.repeat(np.arange(self.n), sizes), w, self.n)
        for lo in range(0, self.n, STRIPE):
            hi = min(self.n, lo + STRIPE)
            own, own_w, rows = ids[ends[lo] : ends[hi]], w[ends[lo] : ends[hi]], np.repeat(np.arange(hi - lo), sizes[lo:hi])
            dense = self.column[own] >= 0
            matrix = np.zeros((len(common), hi - lo), dtype=np.float32)
            matrix[self.column[own[dense]], rows[dense]] = own_w[dense]
            order = np.flatnonzero(~dense)[np.argsort(own[~dense], kind="stable")]
            count = np.bincount(own[order], minlength=len(known))
            self.stripes.append((lo, hi, matrix, rows[order], own_w[order].astype(np.float32), count, np.cumsum(count) - count))

    @staticmethod
    def numbered(flat: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the constructor takes, small enough to be sent."""
        known, ids = np.unique(flat, return_inverse=True)
        return known, ids.astype(np.int32), w, sizes

    @staticmethod
    def _length(rows: np.ndarray, w: np.ndarray, n: int) -> float:
        return float(np.sqrt(np.bincount(rows, weights=w * w, minlength=n).max(initial=0)))

    def products(self, flat: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float]]:
        """(lo, hi, products of the given vectors with those held at lo to hi, by how much one may err); 0 only where no term is shared."""
        m = len(sizes)
        rows, at = np.repeat(np.arange(m), sizes), np.minimum(np.searchsorted(self.known, flat), max(0, len(self.known) - 1))
        # a sum of n products of single precision errs by less than n + 3 units of roundoff; twice that is allowed for
        margin = 1e-9 + (min(sizes.max(initial=0), self.sizes.max(initial=0)) + 8) * 2.0**-23 * self._length(rows, w, m) * self.length
        ok = self.known[at] == flat
        rows, at, w = rows[ok], at[ok], w[ok]
        some = np.unique(at)
        slot = np.zeros(len(self.known), dtype=np.int32)
        slot[some] = np.arange(1, len(some) + 1)
        self.asked = (m, rows, slot[at], w, len(some) + 1, slot[self.ids])
        c = self.column[at]
        left = np.zeros((m, int(self.column.max(initial=-1)) + 1), dtype=np.float32)
        left[rows[c >= 0], c[c >= 0]] = w[c >= 0]
        rows, at, w = rows[c < 0], at[c < 0], w[c < 0].astype(np.float32)
        for lo, hi, matrix, row, post_w, count, start in self.stripes:
            out = left @ matrix
            n = count[at]
            ends = np.cumsum(n)
            post = np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            np.add.at(out.reshape(-1), np.repeat(rows * (hi - lo), n) + row[post], np.repeat(w, n) * post_w[post])
            yield lo, hi, out, margin

    def exact(self, i: np.ndarray, j: np.ndarray, cells: int = 4_000_000, pairs: int = 4000) -> np.ndarray:
        """Products in double precision of rows i, in order, of the vectors last given to products() with those held at j."""
        m, rows, slot, w, wide, held = self.asked
        out, step = np.empty(len(i)), max(1, cells // wide)
        for lo in range(0, m, step):
            table, mine = np.zeros(min(step, m - lo) * wide), (rows >= lo) & (rows < lo + step)
            table[(rows[mine] - lo) * wide + slot[mine]] = w[mine]
            a, b = np.searchsorted(i, [lo, lo + step])
            for x in range(a, b, pairs):
                y = min(b, x + pairs)
                n = self.sizes[j[x:y]]
                ends = np.cumsum(n)
                own = np.repeat(self.first[j[x:y]] - (ends - n), n) + np.arange(ends[-1])
                found = table[np.repeat((i[x:y] - lo) * wide, n) + held[own]] * self.w[own]
                out[x:y] = np.bincount(np.repeat(np.arange(y - x), n), weights=found, minlength=y - x)
        return out


def _by_doc(vectors: DataFrame, *keep: str) -> tuple[DataFrame, int]:
    """(doc, kept, t, w): each document's vector as two arrays, staged; and how many blocks of BLOCK_TERMS they make."""
    docs = session.stage(vectors.groupBy("doc", *keep).agg(F.collect_list(F.xxhash64("term")).alias("t"), F.collect_list("w").alias("w")), "by-doc")  # a document's own terms
    terms = docs.agg(F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("n")).first()["n"]
    return docs, max(1, -(-terms // BLOCK_TERMS))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, w = batch.column("t"), batch.column("w")
    return np.asarray(t.flatten()), np.asarray(w.flatten()), np.asarray(t.value_lengths())


def _in_blocks(docs: DataFrame, blocks: int, first: int = 0, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """docs a block at a time, by a hash of the document; a block is about BLOCK_TERMS terms. Of `most` blocks from the first on, or all."""
    own = F.pmod(F.xxhash64("doc"), F.lit(blocks))
    for b in range(first, blocks if most is None else min(blocks, first + most)):
        table = docs.filter(own == b).orderBy("doc").toArrow().combine_chunks()
        if table.num_rows:
            yield table.to_batches()[0]


#: Blocks that are sent to all tasks at once, some 6 MB each. What a document has found in earlier ones bounds what it keeps of later ones.
ROUND_BLOCKS = 16
#: Bits of a document's place among those sent at once.
PLACE_BITS = 24


def _raise(keys: np.ndarray, i: np.ndarray, new: np.ndarray, with_: np.ndarray | None = None, new_with: np.ndarray | None = None) -> None:
    """Replace rows of keys by the largest of them and of the new keys of rows i, which are in order; with_ goes with them."""
    count = np.bincount(i, minlength=len(keys))
    wide = int(count.max(initial=0))
    if not wide:
        return
    at = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    both = np.concatenate([keys, np.zeros((len(keys), wide), dtype=np.int64)], axis=1)
    both[i, keys.shape[1] + at] = new
    best = np.argpartition(both, wide, axis=1)[:, wide:]
    if with_ is not None:
        carried = np.concatenate([with_, np.zeros((len(keys), wide), dtype=np.int64)], axis=1)
        carried[i, keys.shape[1] + at] = new_with
        with_[:] = np.take_along_axis(carried, best, 1)
    keys[:] = np.take_along_axis(both, best, 1)


def _nearest_in_round(shared, k: int, more: bool):
    """Per document of (doc, g, t, w, least, least_score): its k best among the documents sent, by similarity and by score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, names, name_place, place, apart = shared.value
        most = (1 << PLACE_BITS) - 1
        names = pa.array(names, pa.string())
        for whole in batches:
            groups = whole.column("g").to_pylist()
            mine = np.array([place.get(g, len(place)) for g in groups], dtype=np.int64)
            least, least_score = (whole.column(c).to_numpy().copy() for c in ("least", "least_score"))
            near, best, best_near = (np.zeros((whole.num_rows, k), dtype=np.int64) for _ in range(3))
            for held, ranks, theirs in blocks:
                block, code = _Stripes(*held), {g: i for i, g in enumerate(dict.fromkeys(theirs))}
                gr, pf = np.array([code[g] for g in theirs]), np.array([place.get(g, len(place)) for g in code])
                own = np.array([code.get(g, -1) for g in groups])
                for at in range(0, whole.num_rows, ASKED):
                    to = min(at + ASKED, whole.num_rows)
                    dist, other = apart[mine[at:to, None], pf[None, :]], own[at:to, None] != np.arange(len(pf))
                    for lo, hi, s, margin in block.products(*_arrays(whole.slice(at, ASKED))):
                        # a similarity must reach the lower of what its own rank and, by its group's distance, that of its score asks for
                        low = np.maximum(np.maximum(least[at:to], near[at:to].min(axis=1) >> PLACE_BITS), 1)[:, None]
                        low_score = np.maximum(np.maximum(least_score[at:to], best[at:to].min(axis=1) >> PLACE_BITS), 1)[:, None]
                        by_score = np.where(dist > 0, (low_score - 0.5) / 1e6 / np.where(dist > 0, dist, 1) - 0.5e-6, np.inf)
                        bound = np.where(other, np.clip(np.minimum((low - 0.5) / 1e6, by_score) - margin, 1e-30, 1e30), np.inf).astype(np.float32)
                        i, j = np.divmod(np.flatnonzero(s >= bound[:, gr[lo:hi]]), hi - lo)
                        if len(i) > 8 * k * len(s):  # as at first, when nothing is known
                            kth = lambda v: np.partition(v, -k, axis=1)[:, -k:].min(axis=1)
                            allowed, err = np.where(other[:, gr[lo:hi]], s, np.float32(0)), 2 * margin * max(1.0, dist.max())
                            scores = allowed * dist.astype(np.float32)[:, gr[lo:hi]]
                            i, j = np.divmod(np.flatnonzero((allowed > 0) & ((allowed >= (kth(allowed) - err - 1.1e-6)[:, None]) | (scores >= (kth(scores) - err - 2.2e-6)[:, None]))), hi - lo)
                        if not len(i):
                            continue
                        sim = np.rint(block.exact(i, j + lo) * 1e6).astype(np.int64)
                        score = np.rint(sim / 1e6 * dist[i, gr[lo:hi][j]] * 1e6).astype(np.int64)
                        back = most - ranks[lo:hi][j]  # names are in order, so equal values fall to the smaller
                        _raise(near[at:to], i, np.where(sim > 0, sim << PLACE_BITS | back, 0))
                        _raise(best[at:to], i, np.where((sim > 0) & (score > 0), score << PLACE_BITS | back, 0), best_near[at:to], sim)
            least = np.maximum(least, near.min(axis=1) >> PLACE_BITS)
            least_score = np.maximum(least_score, best.min(axis=1) >> PLACE_BITS)
            for at in range(0, whole.num_rows, 2000):
                to = min(at + 2000, whole.num_rows)
                (x, y), (u, v) = np.nonzero(near[at:to]), np.nonzero(best[at:to])
                found, once = np.unique(np.concatenate([x << PLACE_BITS | most - (near[at:to][x, y] & most), u << PLACE_BITS | most - (best[at:to][u, v] & most)]), return_index=True)
                row, rank = found >> PLACE_BITS, found & most
                sim = np.concatenate([near[at:to][x, y] >> PLACE_BITS, best_near[at:to][u, v]])[once] / 1e6
                dist = apart[mine[at:to][row], name_place[rank]]
                ends = pa.array(np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, c) for c in (names.take(pa.array(rank)), pa.array(sim), pa.array(dist), pa.array(np.round(sim * dist, 6)))]
                kept = [whole.slice(at, to - at).column(c) for c in (("doc", "g", "t", "w") if more else ("doc",))]
                floors = [pa.array(least[at:to]), pa.array(least_score[at:to])] if more else []
                yield pa.RecordBatch.from_arrays([*kept, *floors, *lists], names=[*(("doc", "g", "t", "w", "least", "least_score") if more else ("doc",)), "other", "similarity", "distance", "score"])

    return run


def block_neighbours(vectors: DataFrame, group: str, k: int, distances: DataFrame | None = None) -> DataFrame:
    """(doc, other, similarity, distance, score): each document's k nearest of other groups, by similarity and by score.

    vectors (doc, term, w, group), doc a string, w positive. similarity is the cosine, rounded to six digits and
    positive; score is similarity times the distance of the two groups, from (a, b, distance) with
    a < b, 1 where unknown; more than MOST_DISTANCES of them are refused. Rows are those among a
    document's k best by either, ties by name.

    All documents are compared with all, so the work is quadratic. No vector is shuffled for it: blocks
    of about BLOCK_TERMS terms are sent to all tasks, ROUND_BLOCKS at a time, and meet the documents where
    they lie, in single precision; what may beat a document's best so far is multiplied exactly. At most 2 k rows a document
    and round are written, and later rounds write what beats the earlier ones only. Terms stand for themselves by 64-bit hashes.
    """
    spark = vectors.sparkSession
    far = spark.createDataFrame([], "a string, b string, distance double") if distances is None else distances
    if far.limit(MOST_DISTANCES + 1).count() > MOST_DISTANCES:
        raise ValueError(f"more than {MOST_DISTANCES} distances")
    known = far.select("a", "b", "distance").toArrow().to_pydict()
    place = {g: i for i, g in enumerate(sorted({*known["a"], *known["b"]}))}
    apart = np.ones((len(place) + 1, len(place) + 1))  # the last place is for groups without a distance
    for x, y, d in zip(known["a"], known["b"], known["distance"]):
        apart[place[x], place[y]] = apart[place[y], place[x]] = d
    docs, blocks = _by_doc(vectors, group)
    docs = docs.withColumnRenamed(group, "g")
    asked, lists = docs.withColumns({"least": F.lit(0).cast("bigint"), "least_score": F.lit(0).cast("bigint")}), "other array<string>, similarity array<double>, distance array<double>, score array<double>"
    rounds = []
    for first in range(0, blocks, ROUND_BLOCKS):
        more = first + ROUND_BLOCKS < blocks
        held = [(_Stripes.numbered(*_arrays(b)), b.column("doc").to_pylist(), b.column("g").to_pylist()) for b in _in_blocks(docs, blocks, first, ROUND_BLOCKS)]
        names = sorted(n for _, own, _ in held for n in own)
        rank, of_name = {n: i for i, n in enumerate(names)}, {n: g for _, own, gs in held for n, g in zip(own, gs)}
        name_place = np.array([place.get(of_name[n], len(place)) for n in names], dtype=np.int64)
        shared = spark.sparkContext.broadcast(([(v, np.array([rank[n] for n in own], dtype=np.int64), gs) for v, own, gs in held], names, name_place, place, apart))
        schema = ("doc string, g string, t array<bigint>, w array<double>, least bigint, least_score bigint, " if more else "doc string, ") + lists
        asked = session.stage(asked.mapInArrow(_nearest_in_round(shared, k, more), schema), "near")
        shared.destroy()
        rounds.append(asked)
    each = [r.select("doc", F.explode(F.arrays_zip("other", "similarity", "distance", "score")).alias("x")).select("doc", "x.*") for r in rounds]
    if len(each) == 1:
        return each[0]
    found = each[0]
    for r in each[1:]:
        found = found.unionByName(r)
    rank = lambda by: F.row_number().over(W.partitionBy("doc").orderBy(F.desc(by), "other"))
    return found.withColumns({"r": rank("similarity"), "q": rank("score")}).filter((F.col("r") <= k) | (F.col("q") <= k)).drop("r", "q")


def above(vectors: DataFrame, asked: DataFrame, tie: float) -> DataFrame:
    """(doc, others, failing, least_failing, most_passing): for each document asked for (doc, level), of the documents it shares
    a term with: how many there are, how many have a similarity of level - tie or more, the least of these, and the
    largest of the others (0 if there are none). Similarities and levels are rounded to six digits; weights are positive.

    The documents asked for are sent to all tasks a block at a time; a task leaves one row for each.
    """
    spark = vectors.sparkSession
    docs, _ = _by_doc(vectors)
    wanted, blocks = _by_doc(vectors.join(asked.select("doc", "level"), "doc"), "level")
    path, schema = session.stage_path(spark, "above"), "doc string, others bigint, failing bigint, least_failing double, most_passing double"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block-none")
    for b, held in enumerate(_in_blocks(wanted, blocks)):
        level = np.round(np.asarray(held.column("level")) * 1e6).astype(np.int64)
        shared = spark.sparkContext.broadcast((_Stripes.numbered(*_arrays(held)), held.column("doc").to_pylist(), level))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held, names, level = shared.value
            block, at_name, from_ = _Stripes(*held), {n: i for i, n in enumerate(names)}, np.maximum(level - round(tie * 1e6), 1)
            others, failing = np.zeros(block.n, dtype=np.int64), np.zeros(block.n, dtype=np.int64)
            least, most = np.full(block.n, np.inf), np.zeros(block.n)
            bound = (from_ - 0.5) / 1e6
            for whole in batches:
                places = np.array([at_name.get(n, -1) for n in whole.column("doc").to_pylist()], dtype=np.int64)
                for at in range(0, whole.num_rows, ASKED):
                    own = places[at : at + ASKED]
                    for lo, hi, s, margin in block.products(*_arrays(whole.slice(at, ASKED))):
                        here = np.flatnonzero((own >= lo) & (own < hi))
                        s[here, own[here] - lo] = 0
                        margin += 2.0**-23 * (float(s.max(initial=0)) + bound.max())
                        fails = s >= (bound[lo:hi] + margin).astype(np.float32)
                        passes = s < np.maximum(bound[lo:hi] - margin, 1e-30).astype(np.float32)
                        shares = s >= np.float32(0.5e-6 + margin)
                        # what single precision can't tell, and what may be the least that fails or the most that passes, is multiplied exactly
                        low = np.minimum(np.where(fails, s, np.float32(np.inf)).min(axis=0) + 2 * margin, least[lo:hi])
                        high = np.maximum(np.where(passes, s, np.float32(0)).max(axis=0) - 2 * margin, np.maximum(most[lo:hi], 1e-30))
                        i, j = np.divmod(np.flatnonzero(np.where(fails, s <= (low + margin).astype(np.float32), s >= np.maximum(high - margin, 1e-30).astype(np.float32)) | ((s > 0) & ~shares)), hi - lo)
                        others[lo:hi] += np.count_nonzero(shares, axis=0) - np.bincount(j[shares[i, j]], minlength=hi - lo)
                        failing[lo:hi] += np.count_nonzero(fails, axis=0) - np.bincount(j[fails[i, j]], minlength=hi - lo)
                        x = np.rint(block.exact(i, j + lo) * 1e6).astype(np.int64)
                        fail = (x > 0) & (x >= from_[lo:hi][j])
                        others[lo:hi] += np.bincount(j[x > 0], minlength=hi - lo)
                        failing[lo:hi] += np.bincount(j[fail], minlength=hi - lo)
                        np.minimum.at(least, j[fail] + lo, x[fail] / 1e6)
                        np.maximum.at(most, j[~fail] + lo, x[~fail] / 1e6)
            if block.n:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(others), pa.array(failing), pa.array(np.where(failing > 0, least, 0), mask=failing == 0), pa.array(most)], names=["doc", "others", "failing", "least_failing", "most_passing"])

        docs.mapInArrow(run, schema).write.parquet(f"{path}/block-{b}")
        shared.destroy()
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    return rows.groupBy("doc").agg(F.sum("others").alias("others"), F.sum("failing").alias("failing"), F.min("least_failing").alias("least_failing"), F.max("most_passing").alias("most_passing"))


def dots(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `dot`: the product of the vectors of columns a and b, 0 where they share no term.

    pairs must have a unique column `pair`.
    """
    va = vectors.select(F.col("doc").alias(a), "term", F.col("w").alias("wa"))
    vb = vectors.select(F.col("doc").alias(b), "term", F.col("w").alias("wb"))
    slim = pairs.select("pair", a, b)
    dot = slim.join(va, a).join(vb, [b, "term"]).groupBy("pair").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dot, "pair", "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))


def distinctive(tf: DataFrame, n: int | DataFrame, k: int = 8, kept: DataFrame | None = None, decimals: int = 4) -> DataFrame:
    """(doc, term, score, rank): each document's k terms of highest tf ln(n / df), ties by the term.

    Scores are rounded before they are ranked, so that order doesn't hang on the last bit. kept, if
    given, holds the terms that may be named.
    """
    tf = session.stage(tf, "tf")
    df = document_frequency(tf)
    df = df.withColumn("n", F.lit(n)) if isinstance(n, int) else df.crossJoin(F.broadcast(n))  # one row
    if kept is not None:
        df = df.join(kept.select("term").distinct(), "term", "left_semi")
    scored = with_terms(tf, df).select("doc", "term", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), decimals).alias("score"))
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def field_words(tf: DataFrame, domain: str, enough: int = 10, share: float = 0.8, everyday: DataFrame | None = None, everyday_most: float = 4.0, never: list[str] | None = None) -> DataFrame:
    """(term, docs, concentration, zipf): words that belong to some field rather than to everyday language.

    A word in `enough` or more documents counts if its two strongest domains, by document rate, hold
    `share` of the sum of its rates; a rarer one if its everyday frequency (term, zipf) is below
    everyday_most. Without a table the frequencies are those of the documents themselves: log10 of
    occurrences per billion words. Documents without a domain don't count.
    """
    own = tf.filter(F.col(domain).isNotNull())
    size = own.select("doc", domain).distinct().groupBy(domain).agg(F.count(F.lit(1)).alias("size"))
    rates = own.groupBy("term", domain).agg(F.count(F.lit(1)).alias("df")).join(size, domain).withColumn("rate", F.col("df") / F.col("size"))
    ranked = rates.withColumn("r", F.row_number().over(W.partitionBy("term").orderBy(F.desc("rate"), domain)))
    spread = ranked.groupBy("term").agg(F.sum("df").alias("docs"), (F.sum(F.when(F.col("r") <= 2, F.col("rate"))) / F.sum("rate")).alias("concentration"))
    if everyday is None:
        total = own.agg(F.sum("tf").alias("all"))
        counts = own.groupBy("term").agg(F.sum("tf").alias("c"))
        everyday = counts.crossJoin(F.broadcast(total)).select("term", F.log10(F.col("c") / F.col("all") * 1e9).alias("zipf"))  # total is one row
    joined = spread.join(everyday, "term", "left").withColumn("zipf", F.coalesce("zipf", F.lit(0.0)))
    belongs = F.when(F.col("docs") >= enough, F.round("concentration", 9) >= share).otherwise(F.col("zipf") < everyday_most)
    return joined.filter(belongs & ~F.col("term").isin(*(never or [""])))


def search(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(doc, score): the k documents of highest cosine with the query rows (term, w), ties by document."""
    hits = vectors.join(F.broadcast(query.select("term", F.col("w").alias("q"))), "term")  # a query has a few terms
    scored = hits.groupBy("doc").agg(F.round(F.sum(F.col("w") * F.col("q")), 6).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "doc").limit(k)


def shared_words(pairs: DataFrame, vectors: DataFrame, a: str, b: str, k: int = 6) -> DataFrame:
    """(a, b, term, share, rank): the k terms with the largest positive share of each pair's cosine."""
    va = vectors.select(F.col("doc").alias(a), "term", F.col("w").alias("wa"))
    vb = vectors.select(F.col("doc").alias(b), "term", F.col("w").alias("wb"))
    shares = pairs.select(a, b).join(va, a).join(vb, [b, "term"]).select(a, b, "term", F.round(F.col("wa") * F.col("wb"), 6).alias("share")).filter("share > 0")
    rank = F.row_number().over(W.partitionBy(a, b).orderBy(F.desc("share"), "term"))
    return shares.withColumn("rank", rank).filter(F.col("rank") <= k)


def encode(rows: DataFrame, key: str, text: str, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, vector): texts' vectors by any encoder, which is called once a batch on the executors; null texts are ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "vector": [list(map(float, v)) for v in encoder([t if isinstance(t, str) else "" for t in batch[text]])]})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")
