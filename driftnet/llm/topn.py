"""Top N items within every group by a streamed secondary sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.plans import skew

SALTS = 32


def _stream(n: int, ranked: bool):
    """A mapInArrow function over rows sorted by (g, v desc, item): the first n different items of each g.

    Holds one Arrow batch and at most n items of the group that goes on into the next batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, []
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            g, item = batch.column("g"), batch.column("item")
            starts = np.ones(rows, dtype=bool)
            if rows > 1:
                starts[1:] = pc.not_equal(g.slice(1), g.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            goes_on = g[0].as_py() == group
            if not goes_on:
                taken = []
            local = np.cumsum(starts) - 1
            codes = item.dictionary_encode()
            _, first = np.unique(local * np.int64(len(codes.dictionary)) + codes.indices.to_numpy(), return_index=True)
            new = np.zeros(rows, dtype=bool)
            new[first] = True
            if taken:
                new &= ~((local == 0) & pc.is_in(item, value_set=pa.array(taken, item.type)).to_numpy(zero_copy_only=False))
            counted = np.cumsum(new)
            at = np.flatnonzero(starts)
            before = counted[at] - new[at]
            pos = counted - before[local] + np.where(local == 0, len(taken), 0)
            keep = new & (pos <= n)
            last = keep & (local == local[-1])
            tail = item.filter(pa.array(last)).to_pylist()
            taken = taken + tail if local[-1] == 0 else tail
            group = g[rows - 1].as_py()
            out = batch.filter(pa.array(keep))
            if ranked:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(pos[keep], pa.int32())], names=[*out.schema.names, "pos"])
            if out.num_rows:
                yield out

    return run


def top_n(rows: DataFrame, group: list[str], item: str, value: str, n: int, hot: list | None = None) -> DataFrame:
    """The n items of highest value of every group, in order: group columns, item, value, pos from 1.

    An item counts once, by its highest value; ties go to the smaller item. Rows whose group, item or
    value is null, or whose value is NaN, are left out; a group of nothing else gives no row. Columns
    beside those named are dropped, whatever their names. n below 1 gives no row.

    Rows are hash-partitioned by group, sorted within partitions by value and item, and streamed
    through Arrow, n rows out per group. Groups found to be hot (keys of the concatenated group) are
    spread over SALTS partitions by item first, so that equal items meet; a second, small pass over at
    most n rows per group and salt ranks what is left.
    """
    ok = F.col(value).isNotNull() & F.col(item).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for c in group:
        ok &= F.col(c).isNotNull()
    g = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in group]).alias("g")
    slim = rows.filter(ok).select(g, F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("v"))
    if hot:
        slim = _spread(slim, hot, n)
    ordered = slim.repartition("g").sortWithinPartitions("g", F.desc("v"), "item")
    done = ordered.mapInArrow(_stream(n, True), "g string, item string, v double, pos int")
    parts = F.split("g", "\x1f", -1)
    return done.select(*[parts[i].alias(c) for i, c in enumerate(group)], "item", F.col("v").alias("value"), "pos")


def _spread(slim: DataFrame, hot: list, n: int) -> DataFrame:
    """At most n rows of each group and salt, which hold the group's first n."""
    salt = skew.salted(hot, F.col("g"), F.col("item"), SALTS)
    ordered = slim.withColumn("s", salt).repartition("g", "s").sortWithinPartitions("g", "s", F.desc("v"), "item")
    joined = ordered.select(F.concat_ws("\x1e", "g", "s").alias("g"), "item", "v")
    return joined.mapInArrow(_stream(n, False), "g string, item string, v double").withColumn("g", F.substring_index("g", "\x1e", 1))


def first_items(found: Column, n: int) -> Column:
    """Of an array of struct(v, item): what may be among the n different items of highest v, ties to the smaller item.

    Sorted within the row and cut to the first n, if these are different items; else the whole array is
    kept. Null and NaN values and null items are left out.
    """
    usable = F.filter(found, lambda x: x.item.isNotNull() & x.v.isNotNull() & ~F.isnan(x.v))
    ordered = F.array_sort(F.transform(usable, lambda x: F.struct((-x.v).alias("low"), x.item.alias("item"))))
    few = F.slice(ordered, 1, n)
    return F.when(F.size(F.array_distinct(few.getField("item"))) == F.size(few), few).otherwise(ordered)


def best_neighbours_and_references(neighbours: DataFrame, records: DataFrame, k_neighbours: int = 5, k_references: int = 10) -> DataFrame:
    """Each paper's best neighbours and each topic's reference papers as of a freeze, in order.

    Returns (scope, group_key, pos, item). Lists are cut to the shorter of candidates and counts;
    null, empty and missing lists give nothing; the paper itself is no neighbour of its own.
    """
    near_key = F.concat_ws("\x1f", F.lit("neighbours"), "work")
    ref_key = F.concat_ws("\x1f", F.lit("instrument"), F.concat(F.col("topic"), F.lit(":"), F.col("freeze")))
    hot = skew.hot_keys(neighbours.filter("work is not null"), near_key, F.greatest(F.size("neighbours"), F.lit(0)))
    hot += skew.hot_keys(records.filter("topic is not null and freeze is not null"), ref_key, F.greatest(F.size("instrument"), F.lit(0)))
    # a row's own list is cut to what may count before anything is shuffled
    listed = F.transform("neighbours", lambda c: F.struct(c.similarity.alias("v"), c.work.alias("item")))
    others = F.filter(listed, lambda x: x.item != F.col("work"))
    near = neighbours.select(F.lit("neighbours").alias("scope"), F.col("work").alias("group_key"), F.explode(first_items(others, k_neighbours)).alias("c"))
    zipped = F.arrays_zip(F.col("instrument").alias("item"), F.col("instrument_cites").alias("v"))
    cited = F.transform(zipped, lambda x: F.struct(x.v.cast("double").alias("v"), x.item.alias("item")))
    refs = records.select(F.lit("instrument").alias("scope"), F.concat(F.col("topic"), F.lit(":"), F.col("freeze")).alias("group_key"), F.explode(first_items(cited, k_references)).alias("c"))
    near, refs = (df.select("scope", "group_key", "c.item", (-F.col("c.low")).alias("value")) for df in (near, refs))
    most = max(k_neighbours, k_references)
    best = top_n(near.unionByName(refs), ["scope", "group_key"], "item", "value", most, hot)
    within = F.when(F.col("scope") == "neighbours", k_neighbours).otherwise(k_references)
    return best.filter(F.col("pos") <= within).select("scope", "group_key", "pos", "item")
