"""The k most similar vectors for every vector: partitioned four-bit scans, then exact reranking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.llm.nearest import nearest, partition_keys
from driftnet.llm.quantiser import Quantiser, lists
from driftnet.plans import skew

#: Dimensions of the sketches that are scored, and of those that lists are made and chosen by.
DIMS = 384
ROUTE_DIMS = 192
BUCKETS = 1 << 20
SPREAD = 8
#: Most weight of a word in routing: rare words mustn't part near copies that differ in them.
MOST_IDF = 3.0
#: A sketch's score errs from the cosine c by (1 - c^2) / sqrt(DIMS), one sigma; a floor is set so many below.
SIGMAS = 3.5
#: What four-bit codes of index rows may err beyond that.
SLACK = 0.04
#: Vectors the partition and the codebooks are fitted on; every vector is indexed.
SAMPLE = 20_000
SPILL = 2
#: Index rows in a block, about; a block is what one task holds while queries stream by.
BLOCK_ROWS = 20_000
DEPTH = 64
#: What bounds a task's memory at any number of lists, blocks and candidates: rows routed at once, scores of a product, pairs
#: that are rescored at once, pairs held before those that can't count are dropped.
ROUTED = 1000
SCORES = 250_000
RESCORED = 1000
#: Of a product's pairs, the share that pass by four-bit scores from which their sketches are scored by a second product: a pair
#: that is gathered costs as much as some fifty of a product.
DENSE = 0.02
HELD = 2_000_000
#: Words whose hashes a task remembers.
KNOWN = 250_000
#: Sigmas of the difference of two sketch scores within which candidates of the k-th's score are kept beyond DEPTH.
REACH = 3.0
#: Rows in a block of best_of_all.
EXACT_ROWS = 10_000
#: Bits that stand for a set of words where pairs are ruled out.
SIGN_BITS = 1024
SALTS = 16


def _hashes(words: set[str], known: dict[str, int]) -> np.ndarray:
    import xxhash

    out = np.empty(len(words), dtype=np.int64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w) - (1 << 63)
            if len(known) > KNOWN:
                known.clear()
            known[w] = h
        out[i] = h
    out.sort()
    return out


def _gather(least: int):
    """From rows (work, text) sorted by work: (work, sig, words), one row for each run of a work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, known = re.compile(r"[^\W\d_]{%d,}" % least), {}
        now, held, out = None, set(), []

        def flush():
            h = _hashes(held, known)
            out.append((now, hashlib.blake2b(h.tobytes(), digest_size=16).digest(), h))

        def batch_of():
            works, sigs, words = zip(*out)
            ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(words), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(works, pa.string()), pa.array(sigs, pa.binary()), whole], names=["work", "sig", "words"])

        for batch in batches:
            for work, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if work != now:
                    if now is not None:
                        flush()
                    now, held = work, set()
                held.update(word.findall(text.lower()))
            if len(out) > 2000:
                yield batch_of()
                out = []
        if now is not None:
            flush()
        if out:
            yield batch_of()

    return run


def word_sets(texts: DataFrame, least: int = 4) -> DataFrame:
    """(work, sig, words) from rows (work, text): the sorted 64-bit hashes of each work's distinct words
    of `least` or more letters, and a digest that equal sets share; staged.

    Texts are partitioned by work, sorted and streamed, so a task holds one set at a time; a work with
    much of the table is spread over SALTS partitions and its sets united after. Rows with a null work
    or text don't count. Works without words are left out: they are like nothing.
    """
    rows = texts.select("work", "text").filter("work is not null and text is not null")
    hot = skew.hot_keys(rows, "work")
    salt = skew.salted(hot, F.col("work"), F.col("text"), SALTS)
    ordered = (rows.repartition("work", salt) if hot else rows.repartition("work")).sortWithinPartitions("work").select("work", "text")
    sets = ordered.mapInArrow(_gather(least), "work string, sig binary, words array<bigint>")
    if hot:
        is_hot = F.col("work").isin(hot)
        sets = session.stage(sets, "parts")
        each = sets.filter(is_hot).select("work", F.explode("words").alias("w")).distinct()
        one = each.groupBy("work").agg(F.array_sort(F.collect_list("w")).alias("words"))  # bounded by the vocabulary
        one = one.select("work", F.unhex(F.left(F.sha2(F.concat_ws(",", F.col("words").cast("array<string>")), 256), F.lit(32))).alias("sig"), "words")
        sets = sets.filter(~is_hot).unionByName(one)
    return session.stage(sets.filter(F.size("words") > 0), "sets")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        held += np.bincount(np.asarray(batch.column(0).flatten()) & (BUCKETS - 1), minlength=BUCKETS)
    some = np.flatnonzero(held)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], names=["bucket", "n"])


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_score(least_cosine: float, dims: int = DIMS) -> float:
    """The sketch score that a pair of least_cosine or more falls below in less than one case of a thousand."""
    return least_cosine - SIGMAS * (1 - least_cosine**2) / dims**0.5


def project(words: pa.ListArray, idf: np.ndarray | None = None, dims: int = DIMS) -> np.ndarray:
    """Unit rows: each word adds 1, or its idf, with signs, to SPREAD pseudo-random coordinates."""
    flat, sizes = np.asarray(words.flatten()), np.asarray(words.value_lengths())
    out = np.zeros(len(sizes) * dims)
    row = np.repeat(np.arange(len(sizes)) * dims, sizes)
    weight = 1 if idf is None else idf[flat & (BUCKETS - 1)]
    stripe = dims // SPREAD
    bits = _mix64(flat.view(np.uint64))
    for s in range(SPREAD):
        at = ((bits >> np.uint64(8 * s)) & np.uint64(0x7F)).astype(np.int64) * stripe >> 7
        sign = 1 - 2 * ((bits >> np.uint64(8 * s + 7)) & np.uint64(1)).astype(np.int64)
        out += np.bincount(row + s * stripe + at, weights=weight * sign, minlength=len(out))
    out = out.reshape(len(sizes), dims)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class _Index:
    """What tasks need to encode and route rows; its size depends on SAMPLE alone."""

    def __init__(self, idf: np.ndarray, sample: np.ndarray, sketches: np.ndarray, rows: int, parallel: int):
        self.idf = idf
        wanted = int(2 ** round(np.log2(max(4.0, 4 * rows**0.5))))
        self.centroids = lists(sample, max(1, min(wanted, SAMPLE // 8, len(sample) // 8)))
        self.quantiser = Quantiser.fit(sketches)
        count = len(self.centroids)
        self.probes = max(1, min(count, int(np.ceil(2.0 * count**0.5))))
        near = np.argsort(-(sample @ self.centroids.T), axis=1)[:, : min(SPILL, count)]
        size = np.bincount(near.ravel(), minlength=count) * (rows / max(1, len(sample)))
        # lists alike go to one block, so that a query's probes lie in few of them; small groups share one, since each block that a
        # query asks gets a copy of it
        most = min(BLOCK_ROWS, max(1, int(np.ceil(size.sum() / parallel))))
        some = max(1, min(count, max(parallel * 2, int(size.sum() // BLOCK_ROWS))))
        group = (self.centroids @ lists(self.centroids, some, rounds=5).T).argmax(axis=1)
        self.first, self.parts = np.zeros(count, dtype=np.int64), np.ones(count, dtype=np.int64)
        self.blocks, open_ = 0, []  # of blocks with room: rows held, number
        of_group = np.bincount(group, weights=size, minlength=some)
        for g in np.argsort(-of_group, kind="stable"):
            left = of_group[g]
            at, held = -1, 0.0
            for i in np.flatnonzero(group == g):
                if size[i] > BLOCK_ROWS:  # a list too big for a block has several to itself
                    self.parts[i] = int(np.ceil(size[i] / BLOCK_ROWS))
                    self.first[i], self.blocks = self.blocks, self.blocks + int(self.parts[i])
                    left -= size[i]
                    continue
                if at < 0 or held + size[i] > most:
                    if at >= 0:
                        open_.append((held, at))
                    fits = [o for o in open_ if o[0] + left <= 1.1 * most]
                    if fits:
                        held, at = max(fits)
                        open_.remove((held, at))
                    else:
                        held, at, self.blocks = 0.0, self.blocks, self.blocks + 1
                self.first[i] = at
                held += size[i]
                left -= size[i]
            if at >= 0:
                open_.append((held, at))


def _route(shared, dims: int):
    """Each class's index rows (kind 0, one per list it lies in) and query rows (kind 1, one per block it probes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, keys = shared.value
        for batch in (b.slice(at, ROUTED) for b in batches for at in range(0, b.num_rows, ROUTED)):
            works = batch.column(0)
            x = project(batch.column(1), None, dims)
            far = -(project(batch.column(1), index.idf, ROUTE_DIMS) @ index.centroids.T)
            probes = min(index.probes, far.shape[1])
            near = np.argpartition(far, probes - 1, axis=1)[:, :probes]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1), 1)
            codes = Quantiser.pack(index.quantiser.encode(x))
            scaled = Quantiser.pack((np.round(x * (7 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-9))) + 8).astype(np.uint8))
            n = batch.num_rows
            salt = _mix64(np.arange(n) + int.from_bytes(hashlib.blake2b(str(works[0]).encode(), digest_size=4).digest(), "big"))
            spill = near[:, : min(SPILL, near.shape[1])]
            own = np.repeat(np.arange(n), spill.shape[1])
            at = spill.ravel()
            block = index.first[at] + (salt[own] % index.parts[at].astype(np.uint64)).astype(np.int64)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32)), pa.array(at.astype(np.int16)))
            yield _rows(keys[block], 0, works.take(pa.array(own)), cells, scaled[own], codes[own])
            # queries: all parts of each probed list
            own, at = np.repeat(np.arange(n), near.shape[1]), near.ravel()
            times = index.parts[at]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            own, block, at = np.repeat(own, times), np.repeat(index.first[at], times) + part, np.repeat(at, times)
            order = np.lexsort((at, block, own))
            own, block, at = own[order], block[order], at[order]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (block[1:] != block[:-1])]))
            cells = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(at)]]).astype(np.int32)), pa.array(at.astype(np.int16)))
            yield _rows(keys[block[new]], 1, works.take(pa.array(own[new])), cells, scaled[own[new]], None)

    return run


def _rows(block: np.ndarray, kind: int, works: pa.Array, cells: pa.ListArray, vectors: np.ndarray, codes: np.ndarray | None) -> pa.RecordBatch:
    def fixed(a: np.ndarray) -> pa.Array:
        ends = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(a).tobytes())])

    n = len(block)
    packed = fixed(codes) if codes is not None else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.full(n, kind, dtype=np.int8)), works, cells, fixed(vectors), packed], names=["block", "kind", "work", "cells", "vector", "codes"])


def _kept(i: np.ndarray, s: np.ndarray, k: int, depth: int, dims: int) -> np.ndarray:
    """Of candidates in order of query i and falling score s: each query's `depth` best, and all that the sketch's error may place before its k-th."""
    if not len(i):
        return np.zeros(0, dtype=bool)
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    size = np.diff(np.concatenate([first, [len(i)]]))
    kth = s[np.minimum(first + k - 1, first + size - 1)]
    least = kth - REACH * 2**0.5 * (1 - np.minimum(kth, 1) ** 2) / dims**0.5
    return (np.arange(len(i)) - np.repeat(first, size) < depth) | (s >= np.repeat(least, size))


def _best(found: list[tuple], ids: np.ndarray, k: int, depth: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (query, row, score) in parts, each id of a row once a query: those that _kept keeps. What it drops of some parts it drops of all."""
    i, j, s = (np.concatenate(z) for z in zip(*found))
    once = np.unique(i * len(ids) + ids[j], return_index=True)[1]
    i, j, s = i[once], j[once], s[once]
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    keep = _kept(i, s, k, depth, dims)
    return i[keep], j[keep], s[keep]


def _passing(mine: np.ndarray, table: np.ndarray, vectors: np.ndarray, coarse: float, fine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the pairs whose four-bit score is `coarse` or more and whose sketches score `fine` or more."""
    passed = np.flatnonzero(mine @ table.T >= coarse)
    i, j = np.divmod(passed, len(table))
    if len(passed) >= DENSE * len(mine) * len(table):
        s = (mine @ vectors.T).ravel()[passed]
    else:
        s = np.concatenate([np.zeros(0, mine.dtype), *(np.einsum("nd,nd->n", mine[i[at : at + RESCORED]], vectors[j[at : at + RESCORED]]) for at in range(0, len(i), RESCORED))])
    keep = s >= fine
    return i[keep], j[keep], s[keep]


def _scan(shared, dims: int, k: int, depth: int, coarse: float, fine: float):
    """Per block: its index rows, which come first, are held; queries stream by and leave their candidates."""

    def unfixed(column: pa.Array, width: int, kind) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)

    def unit(v: np.ndarray) -> np.ndarray:
        v = Quantiser.unpack(v).astype(np.float32) - 8
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value[0].quantiser
        block, built, store = None, None, []
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
                part = batch.slice(int(a), int(b - a))
                if blocks[a] != block:
                    block, built, store = blocks[a], None, []
                if kinds[a] == 0:
                    store.append((np.asarray(part.column(3).flatten()), unfixed(part.column(4), dims // 2, np.uint8), unfixed(part.column(5), dims // 8, np.uint8), part.column(2)))
                    continue
                if not store:
                    continue
                if built is None:
                    cell = np.concatenate([s[0] for s in store])
                    order = np.argsort(cell, kind="stable")
                    names = pa.concat_arrays([s[3] for s in store]).take(pa.array(order))
                    cell = cell[order]
                    table = quantiser.table(Quantiser.unpack(np.concatenate([s[2] for s in store])[order]))
                    vectors = unit(np.concatenate([s[1] for s in store])[order])
                    starts = {int(c): (int(x), int(y)) for c, x, y in zip(*(lambda u, f, n: (u, f, f + n))(*np.unique(cell, return_index=True, return_counts=True)))}
                    ids = np.asarray(names.dictionary_encode().indices)  # a row in two lists of the block is one candidate
                    built, store = (names, ids, table, vectors, starts), store[:1]
                names, ids, table, vectors, starts = built
                q = unit(unfixed(part.column(4), dims // 2, np.uint8))
                sizes = np.asarray(part.column(3).value_lengths())
                asked, who = np.asarray(part.column(3).flatten()), np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(asked, kind="stable")
                who = who[order]
                cells, begin = np.unique(asked[order], return_index=True)
                found, held = [], 0
                for c, first, last in zip(cells, begin, [*begin[1:], len(asked)]):
                    if int(c) not in starts:
                        continue
                    x, y = starts[int(c)]
                    own = who[first:last]
                    mine = q[own]
                    step = max(64, SCORES // len(own))
                    for lo in range(x, y, step):
                        hi = min(y, lo + step)
                        i, j, score = _passing(mine, table[lo:hi], vectors[lo:hi], coarse, fine)
                        found.append((own[i], j + lo, score))
                        held += len(i)
                        if held > 2 * HELD:
                            found = [_best(found, ids, k, depth, dims)]
                            held = max(HELD, len(found[0][0]))
                if not found:
                    continue
                i, j, s = _best(found, ids, k, depth, dims)
                if len(i):
                    yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(i)), names.take(pa.array(j)), pa.array(s.astype(np.float32))], names=["a", "b", "score"])

    return run


def candidates(sets: DataFrame, rows: int, least: float, k: int, depth: int = DEPTH, dims: int = DIMS) -> DataFrame:
    """(a, b), a < b: pairs of rows of sets (work, words) whose sketches score at least `least`.

    Four-bit scores pass with SLACK less, since they err more than the sketches they stand for.
    Each query keeps its `depth` best candidates a block, and all those within the sketch's error of its
    k-th, so that dense groups are decided by the exact cosine.
    """
    spark = sets.sparkSession
    counted = sets.select("words").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    idf = np.zeros(BUCKETS)
    idf[counted["bucket"].to_numpy()] = np.minimum(MOST_IDF, np.log(1 + rows / counted["n"].to_numpy()))
    every = max(1, rows // SAMPLE)
    drawn = sets.filter(F.pmod(F.xxhash64("work"), F.lit(every)) == 0).select("words")
    if rows // every > SAMPLE + SAMPLE // 8:  # a limit moves all rows to one task
        drawn = drawn.limit(SAMPLE + SAMPLE // 4)
    shared_idf = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[r.tobytes() for r in project(batch.column(0), *how)] for how in ((shared_idf.value, ROUTE_DIMS), (None, dims))]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in both], names=["v", "u"])

    # the quantiser is fitted on fewer
    sampled = drawn.mapInArrow(vectors, "v binary, u binary").withColumn("u", F.when((F.pmod(F.xxhash64("v"), F.lit(4)) == 0) | F.lit(rows <= 4096), F.col("u"))).toPandas()
    sample = sampled["v"]
    if not len(sample):
        return spark.createDataFrame([], "a string, b string")
    sketches = sampled["u"].dropna()
    read = lambda v, width: np.frombuffer(b"".join(v), dtype=np.float32).reshape(-1, width)
    index = _Index(idf, read(sample, ROUTE_DIMS), read(sketches, dims), rows, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast((index, partition_keys(spark, index.blocks)))
    routed = sets.select("work", "words").mapInArrow(_route(shared, dims), "block int, kind tinyint, work string, cells array<smallint>, vector binary, codes binary")
    ordered = routed.repartition(index.blocks, "block").sortWithinPartitions("block", "kind")
    pairs = ordered.mapInArrow(_scan(shared, dims, k, depth, least - SLACK, least), "a string, b string, score float")
    return session.stage(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(work, n, sign) of (work, words): how many words there are, and a bit for each word's hash, of SIGN_BITS."""
    for batch in batches:
        flat, sizes = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(1).value_lengths())
        for at, to, lo, hi in _slices(sizes):
            bits = np.zeros((to - at, SIGN_BITS), dtype=bool)
            bits[np.repeat(np.arange(to - at), sizes[at:to]), (flat[lo:hi] >> 24) & (SIGN_BITS - 1)] = True
            signs = [r.tobytes() for r in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sizes[at:to].astype(np.int32)), pa.array(signs, pa.binary())], names=["work", "n", "sign"])


def _slices(sizes: np.ndarray, rows: int = 2000) -> Iterator[tuple[int, int, int, int]]:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, len(sizes), rows):
        to = min(at + rows, len(sizes))
        yield at, to, int(ends[at]), int(ends[to])


def _may_reach(least: float):
    """Of pairs (a, b, n, sign, words), with a's sign and b's words, those whose cosine may be `least` or more.

    b's words whose bit is set are at least those that both have, so no pair is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(4)
            flat, sizes, n = np.asarray(words.flatten()), np.asarray(words.value_lengths()), batch.column(2).to_numpy()
            for at, to, lo, hi in _slices(sizes):
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column(3).slice(at, to - at).to_pylist()), dtype=np.uint8)).reshape(to - at, SIGN_BITS)
                rows = np.repeat(np.arange(to - at), sizes[at:to])
                both = np.bincount(rows, weights=bits[rows, (flat[lo:hi] >> 24) & (SIGN_BITS - 1)], minlength=to - at)
                keep = np.flatnonzero(both / np.sqrt(n[at:to] * np.maximum(1.0, sizes[at:to])) >= least - 1e-9) + at
                if len(keep):
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in (0, 1, 4)], names=["a", "b", "wb"])

    return run


def cosines(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine) of the pairs (a, b) of rows of sets (work, words) whose cosine is positive and `least` or more, exactly.

    Few candidates get there, so not all meet both sets of words: a's bits (128 bytes) go to b's words, and only pairs that
    may reach `least` by them take b's words to a's.
    """
    hot = {s: skew.hot_keys(pairs, s) for s in "ab"}
    signs = sets.select("work", "words").mapInArrow(_signed, "work string, n int, sign binary").withColumnRenamed("work", "a")
    words = lambda s: sets.select(F.col("work").alias(s), F.col("words").alias(f"w{s}"))
    told = skew.lookup_join(skew.lookup_join(pairs.select("a", "b"), signs, "a", hot=hot["a"]), words("b"), "b", hot=hot["b"]).select("a", "b", "n", "sign", "wb")
    left = told.mapInArrow(_may_reach(least), "a string, b string, wb array<bigint>")
    cosine = F.size(F.array_intersect("wa", "wb")) / F.sqrt(F.size("wa").cast("double") * F.size("wb"))
    both = skew.lookup_join(left, words("a"), "a", hot=hot["a"]).select("a", "b", cosine.alias("cosine"))
    return both.filter((F.col("cosine") >= least) & (F.col("cosine") > 0))


def _overlaps(left: tuple, right: tuple, vocabulary: int, common: np.ndarray, at: int, to: int) -> np.ndarray:
    """Shared words of left's rows at..to with all of right's: common words by a matrix product, others by postings."""
    (ends, ids), (r_ends, r_ids) = left, right
    column = np.full(vocabulary, -1)
    column[common] = np.arange(len(common))

    def dense(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, c = np.zeros((len(ends) - 1, len(common)), dtype=np.float32), column[ids]
        out[np.repeat(np.arange(len(ends) - 1), np.diff(ends))[c >= 0], c[c >= 0]] = 1
        return out

    mine = ids[ends[at] : ends[to]]
    out = dense(mine, ends[at : to + 1] - ends[at]) @ dense(r_ids, r_ends).T
    order = np.argsort(r_ids, kind="stable")
    post = np.repeat(np.arange(len(r_ends) - 1), np.diff(r_ends))[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(r_ids, minlength=vocabulary))])
    for i in range(at, to):
        some = ids[ends[i] : ends[i + 1]]
        some = some[column[some] < 0]
        if len(some):
            out[i - at] += np.bincount(np.concatenate([post[start[w] : start[w + 1]] for w in some]), minlength=len(r_ends) - 1)
    return out


def _best_of_blocks(k: int, chunk: int = 500):
    """Of a pair of blocks: each row's k best of the other block, both ways; ties to the smaller work."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("work").combine_chunks()
        own, (x, y) = table["own"].to_numpy(), (table["x"][0].as_py(), table["y"][0].as_py())
        sides = [table.filter(pa.array(own == z)) for z in (x, y)]
        a, b, c = [], [], []
        if all(len(t) for t in sides):
            read = lambda t: t["words"].combine_chunks()
            sizes = [np.asarray(read(t).value_lengths()) for t in sides]
            words, ids = np.unique(np.concatenate([np.asarray(read(t).flatten()) for t in sides]), return_inverse=True)
            ids = np.split(ids, [sizes[0].sum()])
            left, right = ((np.concatenate([[0], np.cumsum(n)]), i) for n, i in zip(sizes, ids))
            common = np.flatnonzero(np.bincount(right[1], minlength=len(words)) * 50 > len(sides[1]))
            for at in range(0, len(sides[0]), chunk):
                to = min(at + chunk, len(sides[0]))
                s = _overlaps(left, right, len(words), common, at, to) / np.sqrt(sizes[0][at:to, None].astype(float) * sizes[1])
                if x == y:
                    s[np.arange(to - at), np.arange(at, to)] = 0
                for axis in (1, 0) if x != y else (1,):
                    n = s.shape[axis]
                    least = np.partition(s, max(0, n - k), axis=axis).take([max(0, n - k)], axis=axis)
                    i, j = np.nonzero((s >= least) & (s > 0))
                    v, i = s[i, j], i + at
                    one, two = (i, j + len(sides[0])) if axis else (j + len(sides[0]), i)
                    a.append(one), b.append(two), c.append(v)
                    # rows of ties beyond k, and those of earlier chunks, are dropped as they come
                    if not axis or len(v) > 2 * k * (to - at):
                        a, b, c = ([z] for z in _first(np.concatenate(a), np.concatenate(b), np.concatenate(c), k))
        names = pa.concat_arrays([t["work"].combine_chunks() for t in sides])
        a, b, c = _first(*(np.concatenate(z) if z else np.zeros(0, dtype=t) for z, t in ((a, int), (b, int), (c, float))), k)
        return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "cosine": pa.array(c)})

    return run


def _first(a: np.ndarray, b: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of highest c, ties to the smaller b, of each a."""
    order = np.lexsort((b, -c, a))
    a, b, c = a[order], b[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate([first, [len(a)]])))
    return a[rank < k], b[rank < k], c[rank < k]


def best_of_all(sets: DataFrame, rows: int, k: int, block_rows: int = EXACT_ROWS) -> DataFrame:
    """(a, b, cosine) with each row's k best, exactly: blocks of sets (work, words) are compared with all blocks.

    The work is quadratic; only k rows a row and block leave a task.
    """
    blocks = max(1, -(-rows // block_rows))
    own = F.pmod(F.xxhash64("work"), F.lit(blocks)).cast("int").alias("own")
    cells = sets.select("work", "words", own, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to"))
    cells = cells.withColumns({"x": F.least("own", "to"), "y": F.greatest("own", "to")}).drop("to")
    return cells.groupBy("x", "y").applyInArrow(_best_of_blocks(k), "a string, b string, cosine double")


def _best_of_asked(k: int, chunk: int = 250):
    """Of a block of queries (side 0) and one of rows (side 1): each query's k best rows; ties to the smaller work."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("work").combine_chunks()
        side = table["side"].to_numpy()
        asked, pool = (table.filter(pa.array(side == z)) for z in (0, 1))
        out = [[np.zeros(0, dtype=t)] for t in (int, int, float)]
        if len(asked) and len(pool):
            read = lambda t: t["words"].combine_chunks()
            sizes = [np.asarray(read(t).value_lengths()) for t in (asked, pool)]
            words, ids = np.unique(np.concatenate([np.asarray(read(t).flatten()) for t in (asked, pool)]), return_inverse=True)
            ids = np.split(ids, [sizes[0].sum()])
            left, right = ((np.concatenate([[0], np.cumsum(n)]), i) for n, i in zip(sizes, ids))
            common = np.flatnonzero(np.bincount(right[1], minlength=len(words)) * 50 > len(pool))
            at_own = np.searchsorted(np.array(pool["work"].to_pylist(), dtype=object), np.array(asked["work"].to_pylist(), dtype=object))
            own = np.array([a < len(pool) and pool["work"][int(a)] == w for a, w in zip(at_own, asked["work"])])
            for at in range(0, len(asked), chunk):
                to = min(at + chunk, len(asked))
                s = _overlaps(left, right, len(words), common, at, to) / np.sqrt(sizes[0][at:to, None].astype(float) * sizes[1])
                mine = np.flatnonzero(own[at:to])
                s[mine, at_own[at:to][mine]] = 0
                least = np.partition(s, max(0, len(pool) - k), axis=1)[:, [max(0, len(pool) - k)]]
                i, j = np.nonzero((s >= least) & (s > 0))
                for z, v in zip(out, _first(i + at, j, s[i, j], k)):
                    z.append(v)
        a, b, c = (np.concatenate(z) for z in out)
        return pa.table({"a": asked["work"].combine_chunks().take(pa.array(a)), "b": pool["work"].combine_chunks().take(pa.array(b)), "cosine": pa.array(c)})

    return run


def best_of_asked(asked: DataFrame, sets: DataFrame, rows: int, k: int, block_rows: int = EXACT_ROWS) -> DataFrame:
    """(a, b, cosine) with the k best rows of sets of each row of asked (both work, words), exactly: blocks of
    queries meet blocks of rows, and only k rows a query and block leave a task."""
    across, down = max(1, -(-rows // block_rows)), max(1, -(-asked.count() // block_rows))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("work"), F.lit(n)).cast("int")
    left = asked.select("work", "words", F.lit(0).alias("side"), own(down).alias("x"), to(across).alias("y"))
    right = sets.select("work", "words", F.lit(1).alias("side"), own(across).alias("y"), to(down).alias("x"))
    return left.unionByName(right).groupBy("x", "y").applyInArrow(_best_of_asked(k), "a string, b string, cosine double")


def most_similar(texts: DataFrame, k: int = 5, least: int = 4, least_cosine: float = 0.0, depth: int = DEPTH, exact: bool = False, asked: Column | None = None) -> DataFrame:
    """(work, neighbour, cosine, rank): each work's k works of highest cosine, ties to the smaller work.

    texts (work, text) may have many rows a work. A work's vector has a 1 for each distinct word of
    `least` or more letters in all its texts together; the cosine is exact. Works without such words
    have no rows and are nobody's neighbours; rows with a null work or text don't count, an empty
    table gives an empty one. Neighbours below least_cosine, those that share no word and those that the
    index misses (its recall is measured in the tests), aren't given.

    With a least_cosine, signed sketches rule out what can't reach it; without, no sketch of that kind can
    tell the best of many low cosines, and learned ones rank (nearest()). With `exact`, all classes are
    compared with all instead, and nothing is missed; `asked`, a condition on the column work, leaves
    that to the works it holds for, against all.

    Works of equal vectors form a class, which is searched for once; its k + 1 smallest works stand for
    it, since no answer needs more. Classes are sketched (signed projection of the vectors compared; for routing, weighted by idf up to MOST_IDF), partitioned
    around centroids, quantised to four bits with residuals along a vector penalised, and scanned by
    block; a list beyond a block's size is split. What passes is reranked by the exact cosine.
    """
    sets = word_sets(texts, least)
    members = sets.select("work", "sig")
    classes = members.groupBy("sig").agg(F.min("work").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = session.stage(classes, "classes")
    several = classes.filter("n > 1")
    rows = classes.count()
    has_copies = not session.is_empty(several)
    if has_copies:
        named = session.stage(skew.lookup_join(members, classes.select("sig", "rep"), "sig").select("work", "rep"), "members")
        unique = sets.join(named.filter("work <> rep").select("work"), "work", "left_anti")
        unique = session.stage(unique.select("work", "words"), "unique")
    else:
        named, unique = members.select("work", F.col("work").alias("rep")), sets.select("work", "words")
    if exact or not least_cosine > 0:
        if asked is not None:
            found = best_of_asked(unique.join(named.filter(asked).select(F.col("rep").alias("work")).distinct(), "work", "left_semi"), unique, rows, k + 1)
        else:
            found = best_of_all(unique, rows, k + 1) if exact else nearest(unique, rows, k + 1)
        near = session.stage(found.filter(F.col("cosine") >= least_cosine), "scored")
    else:
        pairs = candidates(unique, rows, least_score(least_cosine), k + 1, depth)
        scored = session.stage(cosines(pairs, unique, least_cosine), "scored")
        near = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    if has_copies:
        # the k + 1 smallest works of each class of several; the rank limit runs before the shuffle too
        r = F.row_number().over(W.partitionBy("rep").orderBy("work"))
        smallest = named.withColumn("r", r).filter(F.col("r") <= k + 1).select("rep", "work")
        extra = smallest.filter("work <> rep")
        own = several.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine"))
        near = near.unionByName(own)
        near = near.select("a", F.col("b").alias("item"), "b", "cosine").unionByName(near.join(extra.withColumnRenamed("rep", "b").withColumnRenamed("work", "item"), "b").select("a", "item", "b", "cosine"))
        near = near.drop("b")
    else:
        near = near.withColumnRenamed("b", "item")
    # a row in several lists or blocks can come more than once
    near = near.groupBy("a", "item").agg(F.max("cosine").alias("cosine"))
    top = near.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "item"))).filter(F.col("r") <= k + 1)
    best = top.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "item"))).alias("best"))  # at most k + 1
    mine = skew.lookup_join(named if asked is None else named.filter(asked), best.withColumnRenamed("a", "rep"), "rep", hot=None if has_copies else [])
    others = F.slice(F.filter("best", lambda x: x.item != F.col("work")), 1, k)
    return mine.select("work", F.posexplode(others).alias("i", "x")).select("work", F.col("x.item").alias("neighbour"), (-F.col("x.c")).alias("cosine"), (F.col("i") + 1).alias("rank"))


def paper_texts(abstracts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(work, text) of all abstract, problem and approach texts."""
    # problem and approach of a row belong to one work: one row with both saves a shuffled record
    said = descriptions.select("work", F.nullif(F.concat_ws(" ", "problem", "approach"), F.lit("")).alias("text"))
    return abstracts.select("work", F.col("abstract").alias("text")).unionByName(said)
