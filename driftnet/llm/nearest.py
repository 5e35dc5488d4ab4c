"""The k nearest of every vector at any cosine: learned sketches in four bits a dimension, scanned by list, reranked in the block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.quantiser import Quantiser, lists

#: Words are hashed to so many columns before the directions are learned: what bounds the projection (32 MiB).
COLUMNS = 1 << 15
DIMS = 256
#: Vectors that directions, lists and codebooks are fitted on, of which LEARN give the directions; all are indexed.
SAMPLE = 20_000
LEARN = 8_000
#: Lists are this multiple of the root of the rows, and this multiple of the root of the lists is probed. Low cosines are
#: spread over many lists: these values reach 0.95 of the true nearest of 60,000 papers, half of which have none above 0.34.
LISTS, PROBES = 4.0, 10.0
BLOCK_ROWS = 20_000
#: Candidates of a query in a block that the exact cosine decides.
DEPTH = 128


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start and size, joined."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def learn(flat: np.ndarray, sizes: np.ndarray, dims: int = DIMS, extra: int = 16, rounds: int = 2, seed: int = 6) -> np.ndarray:
    """A (COLUMNS, dims) projection that keeps inner products of the unit rows best: their leading right singular
    directions by randomised subspace iteration, turned at random so that codes share the load evenly."""
    rng = np.random.default_rng(seed)
    column = flat & (COLUMNS - 1)
    ends = np.cumsum(sizes)
    starts, weight = ends - sizes, (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)
    order = np.argsort(column, kind="stable")
    docs = np.repeat(np.arange(len(sizes)), sizes)[order]
    used, first = np.unique(column[order], return_index=True)
    until = np.append(first[1:], len(order))
    width = max(1, min(dims + extra, len(sizes), len(used)))
    place = np.zeros(COLUMNS, dtype=np.int64)
    place[used] = np.arange(len(used))

    def times(m: np.ndarray) -> np.ndarray:
        out = np.empty((len(sizes), m.shape[1]), dtype=np.float32)
        for a in range(0, len(sizes), 256):
            b = min(len(sizes), a + 256)
            out[a:b] = np.add.reduceat(m[place[column[starts[a] : ends[b - 1]]]], starts[a:b] - starts[a], axis=0)
        return out * weight[:, None]

    def back(y: np.ndarray) -> np.ndarray:
        y, out, a = y * weight[:, None], np.empty((len(used), y.shape[1]), dtype=np.float32), 0
        while a < len(used):
            b = max(a + 1, int(np.searchsorted(until, first[a] + 30_000, "right")))
            for lo in range(int(first[a]), int(until[b - 1]), 60_000):  # a column of very many documents goes in parts
                hi = min(int(until[b - 1]), lo + 60_000)
                cut = np.maximum(first[a:b], lo)
                own = (cut < np.minimum(until[a:b], hi))
                part = np.add.reduceat(y[docs[lo:hi]], cut[own] - lo, axis=0)
                if lo == first[a]:
                    out[a:b] = 0
                out[a:b][own] += part
            a = b
        return out

    q = np.linalg.qr(rng.standard_normal((len(used), width)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(back(times(q)))[0]
    y = times(q)
    values, v = np.linalg.eigh((y.T @ y).astype(np.float64))
    keep = v[:, np.argsort(-values)[:dims]].astype(np.float32)
    turn = np.linalg.qr(rng.standard_normal((keep.shape[1], keep.shape[1])))[0].astype(np.float32)
    out = np.zeros((COLUMNS, dims), dtype=np.float32)
    out[used, : keep.shape[1]] = q @ (keep @ turn)
    return out


def sketch(flat: np.ndarray, sizes: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Rows of words, none empty, as sketches: sums of their words' directions over the root of their number."""
    out = np.empty((len(sizes), projection.shape[1]), dtype=np.float32)
    ends = np.cumsum(sizes)
    starts, a = ends - sizes, 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + 30_000, "right")))
        rows = flat[starts[a] : ends[b - 1]] & (COLUMNS - 1)
        if len(rows) > 60_000:  # one very long row
            out[a] = sum(projection[rows[lo : lo + 60_000]].sum(axis=0) for lo in range(0, len(rows), 60_000))
        else:
            out[a:b] = np.add.reduceat(projection[rows], starts[a:b] - starts[a], axis=0)
        a = b
    return out / np.sqrt(sizes)[:, None].astype(np.float32)


class _Index:
    """What tasks need to sketch, code and route rows; its size depends on SAMPLE and COLUMNS alone."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, rows: int, parallel: int):
        some = int(sizes[:LEARN].sum())
        self.projection = learn(flat[:some], sizes[:LEARN])
        x = sketch(flat, sizes, self.projection)
        wanted = int(2 ** round(np.log2(max(4.0, LISTS * rows**0.5))))
        self.centroids = lists(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), max(1, min(wanted, SAMPLE // 8, len(x) // 8)))
        self.quantiser = Quantiser.fit(x, sub=1)
        count = len(self.centroids)
        self.probes = max(1, min(count, int(np.ceil(PROBES * count**0.5))))
        size = np.bincount((x @ self.centroids.T).argmax(axis=1), minlength=count) * (rows / max(1, len(x)))
        self.blocks, self.first, self.parts = blocks_of(self.centroids, size, max(parallel, int(size.sum() // BLOCK_ROWS)), BLOCK_ROWS)


def blocks_of(centroids: np.ndarray, size: np.ndarray, wanted: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many blocks, and each list's first block and number of blocks: lists alike lie in one block, of at most
    `most` rows and about even size; a list beyond that has several blocks to itself."""
    count = len(centroids)
    room = min(float(most), max(1.0, size.sum() / max(1, wanted)))
    group = (centroids @ lists(centroids, max(1, min(count, wanted)), rounds=5).T).argmax(axis=1)
    first, parts = np.zeros(count, dtype=np.int64), np.ones(count, dtype=np.int64)
    block, held = -1, most + 1.0
    for i in np.lexsort((np.arange(count), group)):
        if size[i] > most:
            parts[i] = int(np.ceil(size[i] / most))
            first[i], block, held = block + 1, block + int(parts[i]), most + 1.0
            continue
        if held + size[i] > room * 1.2:
            block, held = block + 1, 0.0
        first[i] = block
        held += size[i]
    return block + 1, first, parts


def partition_keys(spark, n: int) -> np.ndarray:
    """For each of n partitions an integer that Spark's hash partitioning sends there, so that blocks never share one."""
    out = np.full(n, -1, dtype=np.int64)
    span = 16 * n + 64
    while (out < 0).any():
        got = spark.range(span).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id"))
        for r in got.toLocalIterator():  # one row a partition
            out[r["p"]] = r["id"]
        span *= 4
    return out


def _route(shared):
    """Each row of (work, words) as an index row in the blocks of its lists (kind 0) and as a query in those it probes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, keys = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, flat = np.asarray(batch.column(1).value_lengths()), np.asarray(batch.column(1).flatten())
                x = sketch(flat, sizes, index.projection)
                near = np.argsort(-(x @ index.centroids.T), axis=1)[:, : index.probes]
                codes = Quantiser.pack(index.quantiser.encode(x))
                mine = near[:, 0]
                salt = flat[np.cumsum(sizes) - 1].view(np.uint64) >> np.uint64(3)
                block = index.first[mine] + (salt % index.parts[mine].astype(np.uint64)).astype(np.int64)
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32)), pa.array(mine.astype(np.int16)))
                yield _rows(keys[block], 0, batch, one, codes)
                own, lists_ = np.repeat(np.arange(len(sizes)), near.shape[1]), near.ravel()
                times = index.parts[lists_]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                own, block, lists_ = np.repeat(own, times), np.repeat(index.first[lists_], times) + part, np.repeat(lists_, times)
                order = np.lexsort((lists_, block, own))
                own, block, lists_ = own[order], block[order], lists_[order]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (block[1:] != block[:-1])]))
                cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(lists_)).astype(np.int32)), pa.array(lists_.astype(np.int16)))
                scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-9) / 127
                yield _rows(keys[block[new]], 1, batch.take(pa.array(own[new])), cells, np.round(x / scale).astype(np.int8)[own[new]])

    return run


def _rows(key: np.ndarray, kind: int, rows: pa.RecordBatch, cells: pa.ListArray, vectors: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    ends = np.arange(n + 1, dtype=np.int32) * vectors.shape[1]
    fixed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(vectors).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(np.full(n, kind, dtype=np.int8)), rows.column(0), rows.column(1), cells, fixed], names=["key", "kind", "work", "words", "cells", "vector"])


class _Block:
    """A block's index rows, in order of their list: table rows looked up by code, and words as ids of the block."""

    def __init__(self, parts: list[pa.RecordBatch], quantiser: Quantiser):
        cell = np.concatenate([np.asarray(p.column(4).flatten()) for p in parts])
        order = np.argsort(cell, kind="stable")
        self.cell = cell[order]
        take = pa.array(order)
        names = pa.concat_arrays([p.column(2) for p in parts]).take(take)
        codes = np.frombuffer(b"".join(b for p in parts for b in p.column(5).to_pylist()), dtype=np.uint8).reshape(len(cell), -1)
        self.table = quantiser.table(Quantiser.unpack(codes[order]))
        words = pa.concat_arrays([p.column(3) for p in parts]).take(take)
        self.sizes = np.asarray(words.value_lengths())
        self.known, self.ids = np.unique(np.asarray(words.flatten()), return_inverse=True)
        self.ids = self.ids.astype(np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.names = np.array(names.to_pylist(), dtype=object)
        self.place = np.argsort(np.argsort(self.names, kind="stable"), kind="stable")
        some, at, n = np.unique(self.cell, return_index=True, return_counts=True)
        self.spans = {int(c): (int(a), int(a + k)) for c, a, k in zip(some, at, n)}

    def best(self, q: np.ndarray, cells: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of each query's `depth` best scores in the lists it asks."""
        score = np.full((len(q), len(self.cell)), -np.inf, dtype=np.float32)
        order = np.argsort(cells, kind="stable")
        who, some = np.repeat(np.arange(len(counts)), counts)[order], cells[order]
        cuts = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1], [True]]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            a, b = self.spans.get(int(some[lo]), (0, 0))
            if b > a:
                score[who[lo:hi], a:b] = q[who[lo:hi]] @ self.table[a:b].T
        if depth < score.shape[1]:
            j = np.argpartition(-score, depth - 1, axis=1)[:, :depth]
            i = np.repeat(np.arange(len(q)), depth)
            ok = np.take_along_axis(score, j, 1).ravel() > -np.inf
            return i[ok], j.ravel()[ok]
        return np.nonzero(score > -np.inf)

    def overlaps(self, words: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common of query i and row j, pair by pair."""
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        has = np.zeros((len(sizes), len(self.known)), dtype=bool)
        ok = self.known[at] == words
        has[np.repeat(np.arange(len(sizes)), sizes)[ok], at[ok]] = True
        out = np.empty(len(i), dtype=np.int64)
        a, ends = 0, np.cumsum(self.sizes[j])
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + 1_000_000, "right")))
            n = self.sizes[j[a:b]]
            hit = has[np.repeat(i[a:b], n), self.ids[ranges(self.starts[j[a:b]], n)]]
            out[a:b] = np.add.reduceat(hit.astype(np.int32), np.cumsum(n) - n)
            a = b
        return out


def _scan(shared, k: int, depth: int):
    """Per block: index rows, which come first, are held; queries stream by and leave their k best by the exact cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value[0].quantiser
        key, block, store = None, None, []
        for whole in batches:
            keys, kinds = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if keys[a] != key:
                    key, block, store = keys[a], None, []
                if kinds[a] == 0:
                    store.append(whole.slice(int(a), int(b - a)))
                    continue
                if block is None and store:
                    block, store = _Block(store, quantiser), []
                for lo in range(int(a), int(b), 256) if block is not None else ():
                    part = whole.slice(lo, min(256, int(b) - lo))
                    q = np.frombuffer(b"".join(part.column(5).to_pylist()), dtype=np.int8).reshape(part.num_rows, -1).astype(np.float32)
                    i, j = block.best(q, np.asarray(part.column(4).flatten()), np.asarray(part.column(4).value_lengths()), depth)
                    sizes = np.asarray(part.column(3).value_lengths())
                    c = block.overlaps(np.asarray(part.column(3).flatten()), sizes, i, j) / np.sqrt(sizes[i].astype(float) * block.sizes[j])
                    asking = np.array(part.column(2).to_pylist(), dtype=object)
                    keep = (c > 0) & (block.names[j] != asking[i])
                    i, j, c = i[keep], j[keep], c[keep]
                    order = np.lexsort((block.place[j], -c, i))
                    i, j, c = i[order], j[order], c[order]
                    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, dtype=np.int64)
                    few = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                    if few.any():
                        yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(i[few])), pa.array(block.names[j[few]].tolist(), pa.string()), pa.array(c[few])], names=["a", "b", "cosine"])

    return run


def nearest(sets: DataFrame, rows: int, k: int, depth: int | None = None) -> DataFrame:
    """(a, b, cosine): k or more of each row's nearest rows, as far as the index finds them; the cosine is exact.

    sets (work, words), no work twice, no empty words. Directions, lists and codebooks are fitted on at
    most SAMPLE rows; every row is indexed in SPILL lists and asks PROBES roots of the lists' number.
    A block of lists is one partition of its own, held by one task while queries stream by; the best
    `depth` of a block by four-bit scores are decided by the exact cosine there, and k leave it. So what
    is shuffled is each row once per block that it stands in or asks, and no pair of words meets twice.
    """
    spark = sets.sparkSession
    every = max(1, rows // SAMPLE)
    drawn = sets.filter(F.pmod(F.xxhash64("work"), F.lit(every)) == 0).select("words").limit(SAMPLE).toArrow().column("words").combine_chunks()  # at most SAMPLE rows
    if not len(drawn):
        return spark.createDataFrame([], "a string, b string, cosine double")
    index = _Index(np.asarray(drawn.flatten()), np.asarray(drawn.value_lengths()), rows, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast((index, partition_keys(spark, index.blocks)))
    routed = sets.select("work", "words").mapInArrow(_route(shared), "key int, kind tinyint, work string, words array<bigint>, cells array<smallint>, vector binary")
    ordered = routed.repartition(index.blocks, "key").sortWithinPartitions("key", "kind")
    return ordered.mapInArrow(_scan(shared, k, depth or DEPTH), "a string, b string, cosine double")
