"""Evaluation texts leaking into a corpus: latent semantic retrieval of passages, then exact checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet import session

WORD = re.compile(r"[^\W_]+")
#: Passages are windows of two strides, so any run of STRIDE + 1 words or fewer lies in one whole.
STRIDE = 12
RANK = 160
OVERSAMPLE = 16
POWER_ROUNDS = 2
LEAST_COSINE = 0.55
#: Evaluation texts are searched in blocks of about so many characters, which bounds the latent space and all else that is
#: broadcast; further blocks are further passes over the stretches, not over the corpus.
BLOCK_CHARS = 2_000_000
#: The corpus is read and tokenised once for so many characters of evaluation text, which bounds the words told to tasks.
SCAN_CHARS = 20_000_000
#: Words not of the evaluation texts that may follow one another inside a passage: room for a paraphrase.
GAP = 2


def words(text: str) -> list[str]:
    """The longest runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def windows(ids: np.ndarray) -> list[np.ndarray]:
    """The passages of a word sequence: two strides long, a stride apart."""
    return [ids[k : k + 2 * STRIDE] for k in range(0, max(1, len(ids) - STRIDE), STRIDE)] if len(ids) else []


def longest_subsequence(masks: dict[int, int], ids: list[int]) -> int:
    """Length of the longest common subsequence with the text whose positions of each word are masks' bits."""
    v = 0
    for x in ids:
        m = masks.get(x, 0)
        if m:
            y = v | m
            v = y & ~(y - ((v << 1) | 1))
    return v.bit_count()


def longest_run(masks: dict[int, int], ids: list[int]) -> int:
    """Length of the longest run of consecutive words in common, by shifting position masks."""
    best = 0
    run: dict[int, int] = {}
    for x in ids:
        m = masks.get(x, 0)
        nxt = {}
        while m:
            low = m & -m
            p = low.bit_length()
            n = run.get(p - 1, 0) + 1
            nxt[p] = n
            if n > best:
                best = n
            m ^= low
        run = nxt
    return best


class _Space:
    """What executors need of one block of evaluation texts: bounded by BLOCK_CHARS.

    ids are those of `vocabulary`, of the texts of one scan; `local` turns them into the block's own, -1
    for words that none of its texts holds.
    """

    def __init__(self, texts: list[tuple[str, str, str | None]], vocabulary: dict[str, int]):
        sequences = [np.array([vocabulary[w] for w in words(t)], dtype=np.int64) for _, t, _ in texts]
        own = np.unique(np.concatenate([*sequences, np.zeros(0, dtype=np.int64)])).astype(np.int64)
        self.size = len(own)
        self.local = np.full(len(vocabulary) + 1, -1, dtype=np.int32)  # the last place is for -1
        self.local[own] = np.arange(self.size)
        self.keys = [k for k, _, _ in texts]
        self.ids = [self.local[s] for s in sequences]
        self.answers = [tuple(int(self.local[vocabulary.get(w, -1)]) for w in words(a)) if a else () for _, _, a in texts]
        self.projection = self.latent = self.of = self.lists = None
        self.masks: list[dict[int, int]] = []
        for ids in self.ids:
            m: dict[int, int] = {}
            for p, x in enumerate(ids.tolist()):
                m[x] = m.get(x, 0) | (1 << p)
            self.masks.append(m)
        #: Which words each text holds, as sorted numbers text * (size + 1) + word; word `size` is held by none.
        self.held = np.unique(np.concatenate([np.unique(ids).astype(np.int64) + i * (self.size + 1) for i, ids in enumerate(self.ids)] or [np.zeros(0, dtype=np.int64)]))

    def holds(self, text: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether text[i] holds the words ids[i, :], of the block."""
        want = text[:, None] * np.int64(self.size + 1) + ids
        return self.held[np.minimum(np.searchsorted(self.held, want), len(self.held) - 1)] == want


class _Lists:
    """Passages in lists around centroids. A list is left out for a vector only if no vector within the list's
    widest angle can reach the cosine wanted, so nothing is lost."""

    def __init__(self, x: np.ndarray, seed: int = 8):
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), max(1, int(len(x) ** 0.5)), replace=False)]
        for _ in range(6):
            near = (x @ c.T).argmax(axis=1)
            c = np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        s = x @ c.T
        near = s.argmax(axis=1)
        self.order = np.argsort(near, kind="stable")
        self.x = np.ascontiguousarray(x[self.order].T)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=len(c)))])
        self.centres = np.ascontiguousarray(c.T)
        self.angle = np.array([np.arccos(np.clip(s[near == i, i].min() if (near == i).any() else 1.0, -1, 1)) for i in range(len(c))])

    def search(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, passage, cosine) of all pairs of unit vectors of cosine `least` or more; a zero vector has none."""
        reach = np.arccos(np.clip(q @ self.centres, -1, 1)) - self.angle <= np.arccos(least) + 1e-3
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))]
        full = reach.mean() > 0.5
        for i in [None] if full else np.flatnonzero(reach.any(axis=0)):
            a, b = (0, self.x.shape[1]) if full else self.ends[i : i + 2]
            rows = np.arange(len(q)) if full else np.flatnonzero(reach[:, i])
            s = q[rows] @ self.x[:, a:b]
            hit, col = np.nonzero(s >= least)
            if len(hit):
                out.append((rows[hit], self.order[col + a], s[hit, col]))
        return tuple(np.concatenate(z) for z in zip(*out))


def _scan(vocabulary, least: int, gap: int):
    """Stretches of known words, and how many documents hold each known word.

    A stretch is cut where more than `gap` unknown words follow one another; stretches of fewer than
    `least` words go. Rows: (doc_id, start, ids) and, with a null doc_id, (null, number of documents,
    ids, counts) once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        held, seen = np.zeros(len(known) + 1, dtype=np.int64), 0
        names, ints = ["doc_id", "start", "ids", "counts"], pa.list_(pa.int32())
        for batch in batches:
            docs, starts, runs, size = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen += 1
                text = text.as_py()
                found = words(text) if text else []
                ids = np.fromiter((known.get(w, -1) for w in found), dtype=np.int32, count=len(found))
                held[np.unique(ids)] += 1  # unknown words count at the last place
                at = np.flatnonzero(ids >= 0)
                if len(at) < least:
                    continue
                cuts = np.flatnonzero(np.diff(at) > gap + 1) + 1
                for a, b in zip([0, *cuts], [*cuts, len(at)]):
                    if b - a >= least:
                        docs.append(doc)
                        starts.append(int(at[a]))
                        runs.append(ids[at[a] : at[b - 1] + 1])
                        size += b - a
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), _lists(runs), pa.nulls(len(docs), ints)], names=names)
                    docs, starts, runs, size = [], [], [], 0
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), _lists(runs), pa.nulls(len(docs), ints)], names=names)
        some = np.flatnonzero(held[:-1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([seen], pa.int32()), _lists([some]), _lists([held[some].astype(np.int32)])], names=names)

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), pa.int32()))


def randomised_svd(spark: SparkSession, passages: list[np.ndarray], weights: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the row-normalised TF-IDF matrix of passages.

    Subspace iteration on a random start: tasks hold the passages and return A'(A Q) for the terms
    they hold; only the terms x rank product meets on the driver, where it is made orthonormal.
    """
    terms = len(weights)
    rank = max(1, min(rank, len(passages), terms))
    width = min(terms, rank + OVERSAMPLE)
    parts = min(len(passages), max(1, spark.sparkContext.defaultParallelism))
    spread = spark.createDataFrame(pa.table({"ids": _lists(passages)})).repartition(parts)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for last in [False] * POWER_ROUNDS + [True]:
        shared = spark.sparkContext.broadcast((q.astype(np.float32), weights.astype(np.float32)))

        def product(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, w = shared.value
            out = np.zeros((len(w), q.shape[1]))
            for batch in batches:
                for ids in batch.column(0):
                    x, tf = np.unique(np.asarray(ids.values), return_counts=True)
                    v = tf * w[x]
                    v = v / max(1e-9, float(np.sqrt(v @ v)))
                    out[x] += np.outer(v, v @ q[x])
            some = np.flatnonzero(out.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(out[some]), pa.list_(pa.float64()))], names=["term", "row"])

        total = np.zeros((terms, width))
        for r in spread.mapInArrow(product, "term int, row array<double>").toLocalIterator():
            total[r["term"]] += r["row"]
        shared.unpersist()
        if last:
            values, vectors = np.linalg.eigh(q.T @ total)
            return q @ vectors[:, np.argsort(-values)[:rank]]
        q = np.linalg.qr(total)[0]
    raise AssertionError


def _search(shared, least_run: int, least_ratio: float, least_cosine: float):
    """Candidates of each stretch's passages by latent cosine, then the checks against the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: _Space = shared.value
        for batch in batches:
            docs = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat, ends = space.local[np.asarray(lists.flatten())], np.asarray(lists.value_lengths())
            ends = np.concatenate([[0], np.cumsum(ends)])
            found = []
            row = 0
            while row < len(docs):  # some 40,000 words at a time
                stop = max(row + 1, int(np.searchsorted(ends, ends[row] + 40_000, "right")) - 1)
                found += _chunk(space, docs[row:stop], flat[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
                row = stop
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.float64())], names=["doc_id", "work", "run", "lcs", "answer", "cosine"])

    def _chunk(space: _Space, docs: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> list[tuple]:
        # sums over blocks of one stride; a passage is two blocks
        firsts, owner = [], []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            blocks = np.arange(a, b, STRIDE)
            firsts.append(blocks)
            owner.append(np.full(len(blocks), i))
        firsts, owner = np.concatenate(firsts), np.concatenate(owner)
        sums = np.add.reduceat(space.projection[flat], firsts, axis=0)  # the last row, of -1, is zero
        follows = np.zeros(len(firsts), dtype=bool)
        follows[:-1] = owner[1:] == owner[:-1]
        leads = np.ones(len(firsts), dtype=bool)
        leads[1:] = owner[1:] != owner[:-1]
        passage = np.flatnonzero(follows | leads)  # a block alone, or with the next of its stretch
        x = sums[passage]
        two = follows[passage]
        x[two] += sums[passage[two] + 1]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        out, longest = [], {}
        for at in range(0, len(passage), 2048):
            hit, col, cosine = space.lists.search(x[at : at + 2048], least_cosine)
            if not len(hit):
                continue
            pair = hit.astype(np.int64) * len(space.keys) + space.of[col]
            order = np.lexsort((-cosine, pair))
            _, first = np.unique(pair[order], return_index=True)
            chosen = order[first]
            # a common subsequence is no longer than the number of words that the text has at all
            at_ = firsts[passage[at + hit[chosen]]][:, None] + np.arange(2 * STRIDE)
            last = ends[owner[passage[at + hit[chosen]]] + 1][:, None]
            ids = np.where(at_ < last, flat[np.minimum(at_, len(flat) - 1)], -1)
            known = space.holds(space.of[col[chosen]], np.where(ids < 0, space.size, ids))
            enough = known.sum(axis=1) >= np.minimum(least_run, least_ratio * np.minimum(2 * STRIDE, last[:, 0] - at_[:, 0]))
            for k in chosen[enough]:
                p = passage[at + hit[k]]
                text, i, a = int(space.of[col[k]]), int(owner[p]), int(firsts[p])
                b = min(a + 2 * STRIDE, int(ends[i + 1]))
                ids = flat[a:b].tolist()
                lcs = longest_subsequence(space.masks[text], ids)
                if lcs < min(least_run, least_ratio * (b - a)):
                    continue
                run = longest_run(space.masks[text], ids)
                if run < least_run and lcs < least_ratio * 2 * STRIDE:
                    continue
                whole = flat[int(ends[i]) : int(ends[i + 1])]
                if run >= least_run:  # it may go on beyond the passage
                    if (i, text) not in longest:
                        longest[i, text] = longest_run(space.masks[text], whole.tolist())
                    run = longest[i, text]
                answer = space.answers[text]
                said = bool(answer) and -1 not in answer and _holds(whole, answer)
                out.append((int(docs[i]), space.keys[text], run, lcs, said, float(cosine[k])))
        return out

    return run


def _holds(ids: np.ndarray, answer: tuple[int, ...]) -> bool:
    n = len(answer)
    at = np.flatnonzero(ids[: len(ids) - n + 1] == answer[0]) if len(ids) >= n else []
    return any(tuple(ids[p : p + n].tolist()) == answer for p in at)


def leaks(documents: DataFrame, gold: DataFrame, least_run: int = 12, least_ratio: float = 0.75, gap: int = GAP, rank: int = RANK, least_cosine: float = LEAST_COSINE, block_chars: int = BLOCK_CHARS, scan_chars: int = SCAN_CHARS) -> DataFrame:
    """Which documents hold which evaluation texts: (doc_id, work, run, lcs, answer, cosine).

    documents (doc_id, text), gold (work, text, method_named). run is the longest run of consecutive
    words in common that was found, lcs the longest common subsequence of a passage of 2 * STRIDE
    words with the text, answer whether the text's method_named is said in the same stretch, cosine
    the latent cosine of the best passage. A row comes out for run >= least_run, or for a paraphrase:
    lcs >= least_ratio of a full passage. Null and empty texts hold nothing; a text without words in
    gold leaks nowhere; a null work is ''. Rows that repeat count once.

    Words outside the evaluation texts can't be part of a match, so a document is cut into stretches
    of known words, tolerating up to `gap` unknown ones in a row (0 is enough for verbatim runs, more
    finds paraphrases with other words put in). Document frequencies are of all documents. The latent
    space is that of the evaluation passages. Documents are read and tokenised once per scan_chars of
    evaluation texts; each block of block_chars passes over the stretches, which are a part of the
    words, and nothing but the few hits is shuffled. Recall at LEAST_COSINE is measured in the tests
    against a search for the word runs themselves.
    """
    spark = documents.sparkSession
    texts = session.stage(gold.filter("text is not null").select(F.coalesce("work", F.lit("")).alias("work"), "text", "method_named").distinct(), "evaluation")
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    scans = max(1, -(-int(size) // scan_chars))
    per = max(1, -(-int(size) // (scans * block_chars)))
    own = lambda b: texts.filter(F.pmod(F.xxhash64("work", "text"), F.lit(scans * per)) == b) if scans * per > 1 else texts
    read = lambda b: sorted((r["work"], r["text"], r["method_named"] or "") for r in own(b).toLocalIterator())  # noqa: E731  # about block_chars
    parts = []
    for scan in range(scans):
        blocks = range(scan * per, (scan + 1) * per)
        vocabulary = {w: i for i, w in enumerate(sorted({w for b in blocks for _, t, _ in read(b) for w in words(t)}))}
        if vocabulary:
            scanned, idf = _stretches(spark, documents, vocabulary, min(least_run, int(least_ratio * 2 * STRIDE)), gap)
            for b in blocks:
                space = _Space(read(b), vocabulary)
                if space.size:
                    parts.append(_block(spark, scanned, idf, space, least_run, least_ratio, rank, least_cosine))
    if not parts:
        return spark.createDataFrame([], FOUND)
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "work").agg(F.max("run").alias("run"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.max("cosine").alias("cosine"))


FOUND = "doc_id bigint, work string, run int, lcs int, answer boolean, cosine double"


def _stretches(spark: SparkSession, documents: DataFrame, vocabulary: dict[str, int], least: int, gap: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, ids) of the stretches of known words of all documents, staged, and each word's idf over all documents."""
    shared = spark.sparkContext.broadcast(vocabulary)
    scanned = documents.select("doc_id", "text").mapInArrow(_scan(shared, least, gap), "doc_id bigint, start int, ids array<int>, counts array<int>")
    scanned = session.stage(scanned, "stretches")
    tallies = scanned.filter("doc_id is null")
    n = tallies.agg(F.coalesce(F.sum("start"), F.lit(0)).alias("n")).first()["n"]
    df = np.zeros(len(vocabulary))
    pairs = tallies.select(F.explode(F.arrays_zip("ids", "counts")).alias("x")).groupBy("x.ids").agg(F.sum("x.counts").alias("n"))
    for r in pairs.toLocalIterator():  # at most one row per word of the evaluation texts of one scan
        df[r["ids"]] = r["n"]
    return scanned.filter("doc_id is not null").select("doc_id", "ids"), np.log((1 + n) / (1 + df)) + 1


def _block(spark: SparkSession, stretches: DataFrame, every_idf: np.ndarray, space: _Space, least_run: int, least_ratio: float, rank: int, least_cosine: float) -> DataFrame:
    idf = np.zeros(space.size)
    idf[space.local[space.local >= 0]] = every_idf[np.flatnonzero(space.local[:-1] >= 0)]
    passages, of = [], []
    for i, ids in enumerate(space.ids):
        for w in windows(ids):
            passages.append(w)
            of.append(i)
    vectors = randomised_svd(spark, passages, idf, rank)
    space.projection = np.vstack([idf[:, None] * vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    space.of = np.array(of, dtype=np.int64)
    latent = np.stack([space.projection[p].sum(axis=0) for p in passages])
    space.lists = _Lists((latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32))
    shared = spark.sparkContext.broadcast(space)
    return stretches.mapInArrow(_search(shared, least_run, least_ratio, least_cosine), FOUND)
