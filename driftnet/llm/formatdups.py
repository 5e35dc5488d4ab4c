"""Records that differ only in formatting, found with merged Bloom filters before any row is shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet import session
from driftnet.plans import skew

BITS_PER_KEY = 16
PROBES = 5
#: A filter has at most 2^27 bits (16 MiB): the bound on what is broadcast at once. More keys are split by their hash into
#: shards, each with a filter of its own, so that the load of a filter is the same at any number of rows.
MAX_BITS = 1 << 27
SEGMENT = 1 << 15


def canonical(text: Column) -> Column:
    """The text lower-cased and rid of all but letters and digits; null for null."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each 64-bit hash, by double hashing."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _set(packed: np.ndarray, slots: np.ndarray) -> None:
    np.bitwise_or.at(packed, slots >> 3, (1 << (slots & 7)).astype(np.uint8))


def _all_set(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=1)


def _build(bits: int):
    """Per partition: the filters of keys seen, and of keys seen again, as compressed segments that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            h, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
            slots = _slots(h, bits)
            _set(again, slots[_all_set(once, slots) | (counts > 1)].ravel())
            _set(once, slots.ravel())
        width = min(SEGMENT, bits) // 8
        filled = np.flatnonzero(once.reshape(-1, width).any(axis=1))
        packed = [[zlib.compress(f[s * width : (s + 1) * width].tobytes(), 1) for s in filled] for f in (once, again)]
        if len(filled):
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), *[pa.array(p, pa.binary()) for p in packed]], names=["segment", "once", "again"])

    return run


def _merge(parts: pd.DataFrame) -> pd.DataFrame:
    """One segment over all partitions: bits of keys seen in two of them join the repeated ones."""
    once = again = None
    for o, a in zip(parts["once"], parts["again"]):
        o, a = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (o, a))
        once, again = (o, a) if once is None else (once | o, again | a | (once & o))
    return pd.DataFrame({"segment": parts["segment"][:1], "again": [zlib.compress(again.tobytes(), 1)]})


def shards_of(keys: int, max_bits: int) -> tuple[int, int]:
    """(shards, bits of a filter) for so many keys: both powers of two, BITS_PER_KEY or more a key."""
    bits = 1 << max(10, int(keys * BITS_PER_KEY - 1).bit_length() if keys else 10)
    most = 1 << max(10, int(max_bits).bit_length() - 1)
    return max(1, bits // most), min(bits, most)


def flag_repeats(keys: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, key, maybe): rows of keys (id, key, h), a staged table without null keys, of which there are n; maybe
    is true for all rows whose h occurs more than once and for a few others. key is null where maybe is false.

    Nothing but filters is shuffled. Shards are one pass each over their own rows.
    """
    spark = keys.sparkSession
    out = "id bigint, key binary, maybe boolean"
    if not n:
        return spark.createDataFrame([], out)
    shards, bits = shards_of(n, max_bits)
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")
    source = session.stage_path(spark, "shards")
    if shards > 1:
        keys.withColumn("shard", shard).write.partitionBy("shard").parquet(source)
    path = session.stage_path(spark, "flagged")
    for s in range(shards):
        own = keys if shards == 1 else spark.read.schema("id bigint, key binary, h bigint, shard int").parquet(source).filter(F.col("shard") == s).drop("shard")
        width = min(SEGMENT, bits) // 8
        again = np.zeros(bits // 8, dtype=np.uint8)
        parts = own.select("h").mapInArrow(_build(bits), "segment int, once binary, again binary")
        for r in parts.groupBy("segment").applyInPandas(_merge, "segment int, again binary").toLocalIterator():  # bits / 8 bytes in all
            again[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(zlib.decompress(r["again"]), dtype=np.uint8)
        shared = spark.sparkContext.broadcast(again)

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                maybe = pa.array(_all_set(shared.value, _slots(batch.column("h").to_numpy(), bits)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pc.if_else(maybe, batch.column("key"), pa.scalar(None, pa.binary())), maybe], names=["id", "key", "maybe"])

        own.select("id", "key", "h").mapInArrow(probe, out).write.parquet(f"{path}/shard-{s}")
        shared.destroy()
    return spark.read.schema(out).option("recursiveFileLookup", True).parquet(path)


def collapse(rows: DataFrame, id_column: str, text_columns: list[str], least: int = 3, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """Collapse rows whose texts agree but for letter case, spacing, punctuation and order of the fields.

    Returns (classes, members): classes (keep_id, copies) has one row for each class and each row
    without copies; members (keep_id, copy_id) one row for each other member of a class. keep_id is
    the smallest id. A row with a null text, or with one that keeps fewer than `least` letters and
    digits, is alone. Rows with a null id are left out. An empty table gives two empty ones.

    Two rows are held equal if the SHA-256 of their sorted canonical texts agree. Only possible
    repeats, as told by the filters, are shuffled; all others are singletons where they lie. Counting
    combines on the map side first, and a class that holds much of the table is joined without being
    gathered.
    """
    texts = F.transform(F.array(*[F.col(c) for c in text_columns]), canonical)
    ok = F.aggregate(texts, F.lit(True), lambda a, x: a & F.coalesce(F.length(x) >= least, F.lit(False)))
    whole = F.unhex(F.sha2(F.concat_ws("\x1f", F.array_sort(texts)), 256))
    keyed = rows.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.when(ok, whole).alias("key"))
    keyed = session.stage(keyed.withColumn("h", F.when(F.col("key").isNotNull(), F.xxhash64("key"))), "canonical")
    known = keyed.filter("key is not null")
    flagged = flag_repeats(known, known.count(), max_bits)
    maybe = flagged.filter("maybe").select("id", "key")
    groups = session.stage(maybe.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")), "classes")
    members = skew.lookup_join(maybe, groups.filter("copies > 1").select("key", "keep_id"), "key", hot=skew.hot_keys(maybe, "key"))
    copied = members.filter("keep_id <> id").select("keep_id", F.col("id").alias("copy_id"))
    singles = keyed.filter("key is null").select("id").unionByName(flagged.filter("not maybe").select("id"))
    return groups.select("keep_id", "copies").unionByName(singles.select(F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))), copied
