"""Ranking metrics and summaries as grouped aggregations, ties handled explicitly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(rows: DataFrame, order: Column, sums: dict[str, str], groups: list[str]) -> DataFrame:
    """rows with the running sum of each column in `sums` (new name: column), up to and with each row.

    Without groups rows are range-partitioned by the order, summed within partitions, and what came
    before each partition is added, so that no task sees all rows.
    """
    if groups:
        w = W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({new: F.sum(c).over(w) for new, c in sums.items()})
    from driftnet import session

    parts = session.stage(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "running")
    own = parts.groupBy("_p").agg(*[F.sum(c).alias(f"_{new}") for new, c in sums.items()])
    earlier = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    before = own.select("_p", *[F.coalesce(F.sum(f"_{new}").over(earlier), F.lit(0)).alias(f"_{new}") for new in sums])
    w = W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.withColumns({new: F.sum(c).over(w) for new, c in sums.items()}).join(F.broadcast(before), "_p")  # one row a partition
    return out.withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums}).drop("_p", *[f"_{new}" for new in sums])


def average_precision(scored: DataFrame, score: str, label: str, groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(groups, positives, ap): mean precision at each positive, rows of equal score taken together.

    Null where a group has no positive. Counts are taken per distinct score first, so the running
    sums go over scores, not rows.
    """
    groups = groups or []
    w = F.col(weight) if weight else F.lit(1.0)
    per_score = scored.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.sum(w * F.col(label)).alias("tp"), F.sum(w).alias("n"))
    cum = running(per_score, F.desc(score), {"ctp": "tp", "cn": "n"}, groups)
    gain = F.when(F.col("cn") > 0, F.col("tp") * F.col("ctp") / F.col("cn")).otherwise(0.0)
    return cum.groupBy(*groups).agg(F.sum("tp").alias("positives"), F.sum(gain).alias("_g")).withColumn("ap", F.when(F.col("positives") > 0, F.col("_g") / F.col("positives"))).drop("_g")


def roc_auc(scored: DataFrame, score: str, label: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, auc): chance that a positive outranks a negative, ties counting half; null without both kinds."""
    groups = groups or []
    per_score = scored.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.sum(F.col(label)).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    cum = running(per_score, F.asc(score), {"upto": "n"}, groups).withColumn("under", F.col("upto") - F.col("n"))
    totals = cum.groupBy(*groups).agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("u"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return totals.select(*groups, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg"))).alias("auc"))


def curves(scored: DataFrame, score: str, label: str, groups: list[str]) -> DataFrame:
    """(groups, ap, auc) as from average_precision and roc_auc, by one shuffle: rows are range-partitioned by group and
    score, so that no task sees all of a group, and only scores with a positive leave the tasks."""
    from driftnet import session

    ordered = scored.filter(F.col(score).isNotNull()).select(*groups, score, label).repartitionByRange(*groups, F.desc(score))
    per_score = ordered.groupBy(*groups, score).agg(F.sum(F.col(label)).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    per_score = per_score.sortWithinPartitions(*groups, F.desc(score)).select(*groups, "p", "n", F.spark_partition_id().alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores with a positive, with what stands above them in this task; after each group its totals, of which `own` is null."""
        now, part, above, below = None, None, 0.0, 0.0

        def rows(p: np.ndarray, n: np.ndarray, tp: np.ndarray, fp: np.ndarray, last: bool) -> pa.RecordBatch:
            keys = [pa.array([v] * len(tp), t) for v, t in zip(now, kinds)]
            none = pa.nulls(len(tp), pa.float64())
            return pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(tp), part, dtype=np.int32)), none if last else pa.array(p), none if last else pa.array(n), pa.array(tp), pa.array(fp)], names=[*groups, "_p", "own", "other", "tp", "fp"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(g).type for g in groups]
            columns = [batch.column(i).to_pylist() for i in range(len(groups))]
            keys = list(zip(*columns))
            p, n = (np.asarray(batch.column(len(groups) + i).fill_null(0.0)) for i in (0, 1))
            part = batch.column(len(groups) + 2)[0].as_py()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if keys[a] != now:
                    if now is not None:
                        yield rows(None, None, np.array([above]), np.array([below]), True)
                    now, above, below = keys[a], 0.0, 0.0
                tp, fp = above + np.cumsum(p[a:b]), below + np.cumsum(n[a:b])
                above, below = float(tp[-1]), float(fp[-1])
                some = p[a:b] > 0
                if some.any():
                    yield rows(p[a:b][some], n[a:b][some], tp[some], fp[some], False)
        if now is not None:
            yield rows(None, None, np.array([above]), np.array([below]), True)

    keys = ", ".join(f"`{g}` {scored.schema[g].dataType.simpleString()}" for g in groups)
    parts = session.stage(per_score.mapInArrow(run, f"{keys}, _p int, own double, other double, tp double, fp double"), "curves")
    totals = parts.filter("own is null").select(*groups, "_p", F.col("tp").alias("_t"), F.col("fp").alias("_f"))
    earlier = W.partitionBy(*groups).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    every = W.partitionBy(*groups)
    before = totals.select(*groups, "_p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{c}b") for c in ("_t", "_f")], *[F.sum(c).over(every).alias(f"{c}s") for c in ("_t", "_f")])
    keyed = parts.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], F.col("_p").alias("_q"), "own", "other", "tp", "fp").filter("own is not null")
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_k{i}"))
    joined = F.broadcast(before).join(keyed, same, "right").filter("_p is not null")  # one row a partition and group
    gain = F.col("own") * (F.col("tp") + F.col("_tb")) / (F.col("tp") + F.col("_tb") + F.col("fp") + F.col("_fb"))
    under = F.col("_fs") - F.col("_fb") - F.col("fp") + F.col("other") / 2
    found = joined.groupBy(*groups).agg(F.sum(gain).alias("_g"), F.sum(F.col("own") * under).alias("_u"))
    whole = totals.groupBy(*groups).agg(F.sum("_t").alias("_t"), F.sum("_f").alias("_f")).select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], "_t", "_f")
    match = F.lit(True)
    for i, g in enumerate(groups):
        match &= F.col(g).eqNullSafe(F.col(f"_k{i}"))
    out = whole.join(F.broadcast(found), match, "left")  # one row a group
    return out.select(*[F.col(f"_k{i}").alias(g) for i, g in enumerate(groups)], F.when(F.col("_t") > 0, F.col("_g") / F.col("_t")).alias("ap"), F.when((F.col("_t") > 0) & (F.col("_f") > 0), F.col("_u") / (F.col("_t") * F.col("_f"))).alias("auc"))


def precision_at(scored: DataFrame, score: str, label: str, k: int, ties: list[str], groups: list[str] | None = None) -> DataFrame:
    """(groups, precision): share of positives among the k highest scores, ties in order of `ties`."""
    order = [F.desc(score), *[F.col(t) for t in ties]]
    if not groups:
        return scored.orderBy(*order).limit(k).agg(F.avg(F.col(label)).alias("precision"))
    rank = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return scored.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*groups).agg(F.avg(F.col(label)).alias("precision"))


def histogram(values: DataFrame, value: str, bins: int = 20, groups: list[str] | None = None) -> DataFrame:
    """(groups, bin, n) on [0, 1], the last bin closed, values beyond clipped, empty bins as 0."""
    groups = groups or []
    at = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))) * bins), F.lit(bins - 1)).cast("int")
    counted = values.filter(F.col(value).isNotNull()).groupBy(*groups, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = counted.select(*groups).distinct() if groups else values.sparkSession.range(1).select()
    dense = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(counted, [*groups, "bin"], "left").fillna(0, ["n"])


def mean_sd(rows: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """(groups, feature, mean, sd), the population deviation."""
    groups = groups or []
    aggs = [f(c).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    wide = rows.groupBy(*groups).agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__sd").alias("sd")) for c in columns]))
    return wide.select(*groups, each.alias("x")).select(*groups, "x.feature", "x.mean", "x.sd")


def ranked(scored: DataFrame, score: str, ties: list[str]) -> DataFrame:
    """All rows with their rank by score, without gathering them in one task.

    Rows are range-partitioned by the order; each partition's size tells where its ranks start.
    """
    from driftnet import session

    order = [F.desc(score), *[F.col(t) for t in ties]]
    sorted_ = session.stage(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    sizes = sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    local = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return sorted_.withColumn("_l", local).join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("rank", (F.col("_b") + F.col("_l")).cast("bigint")).drop("_p", "_l", "_b")


def logit_score(means: dict[str, float], scales: dict[str, float], coefs: dict[str, float], intercept: float) -> Column:
    """The probability by a stored model, as one generated expression."""
    z = F.lit(float(intercept))
    for name, coef in coefs.items():
        z = z + (F.col(name) - F.lit(float(means[name]))) / F.lit(float(scales[name]) or 1.0) * F.lit(float(coef))
    return 1 / (1 + F.exp(-z))


def retrieval(similarity: DataFrame, queries: DataFrame, pool: DataFrame, relevant: Column) -> DataFrame:
    """(query, ap, first): for each query, average precision over the whole pool and whether the first item is relevant.

    similarity (query, item, s) may lack pairs, which then have 0; queries (query, ...), pool (item,
    ...): `relevant` is over both sides' columns. Ranked by s, ties by item; the query itself isn't in
    its ranking. Queries without a relevant item are left out. Every query meets every item of the pool
    by a condition join, since items of similarity 0 are ranked too: a benchmark is a few hundred papers.
    """
    pairs = queries.join(pool, F.col("query") != F.col("item")).join(similarity, ["query", "item"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    marked = pairs.select("query", "item", F.round("s", 6).alias("s"), relevant.cast("int").alias("rel"))
    order = W.partitionBy("query").orderBy(F.desc("s"), "item")
    r = marked.withColumn("r", F.row_number().over(order)).withColumn("hits", F.sum("rel").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = r.groupBy("query").agg(F.sum("rel").alias("n"), F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("r")).otherwise(0.0)).alias("g"), F.max(F.when(F.col("r") == 1, F.col("rel"))).alias("first"))
    return out.filter("n > 0").select("query", (F.col("g") / F.col("n")).alias("ap"), F.col("first").cast("int").alias("first"))
