"""Connected components by seed-tree pruning, over any number of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet import session
from driftnet.plans import skew

#: The active graph shrinks by a constant factor a round, so this is far beyond what any graph needs.
MOST_ROUNDS = 60


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group): every node of the pairs with the smallest node linked to it, directly or not.

    Pairs count in either direction and once however often they are repeated; pairs with a missing
    side or of a node with itself are ignored, so a node of only such pairs has no row. Other columns
    are ignored. An empty table gives an empty one. Nodes keep their type.

    Each round every vertex points its neighbours at the smallest of its neighbourhood; vertices that
    nobody points at themselves are no local minimum and drop out, leaving a forest edge to their
    smallest candidate, while their candidates are linked for the next round. What remains in the end
    are the seeds, one per group. Then seeds' names flow down the forest, last dropped first. All
    steps are joins and aggregations with a map-side part; hubs are found once a round and joined without
    being gathered, each round is cut in shared storage, and names are only added, never written again.
    """
    clean = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = session.stage(clean.unionByName(clean.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    seeds, forest = [], []
    for _ in range(MOST_ROUNDS):
        if session.is_empty(edges):
            break
        smallest = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hot = skew.hot_keys(edges, "u")
        pointed = skew.lookup_join(edges, smallest, "u", hot=hot).select(F.col("v").alias("u"), "m").unionByName(smallest)
        pointed = session.stage(pointed.distinct(), "pointed")
        fate = pointed.groupBy("u").agg(F.min("m").alias("low"), F.max((F.col("m") == F.col("u")).cast("int")).alias("stays"), F.count(F.lit(1)).alias("n"))
        fate = session.stage(fate, "fate")
        linked = skew.lookup_join(pointed, fate.filter("n > 1").select("u", "low"), "u", hot=hot).filter("m <> low").select(F.col("m").alias("u"), F.col("low").alias("v"))
        edges = session.stage(linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
        forest.append(fate.filter("stays = 0").select("u", F.col("low").alias("parent")))
        # a vertex that points only at itself, and has no edge left, is done
        ended = fate.filter("stays = 1").join(edges.select("u").distinct(), "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("group"))
        seeds.append(ended)
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    if not seeds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("group"))
    path = session.stage_path(pairs.sparkSession, "named")
    kind = edges.schema["u"].dataType.simpleString()
    named = lambda: pairs.sparkSession.read.schema(f"node {kind}, `group` {kind}").option("recursiveFileLookup", True).parquet(path)
    reduce(DataFrame.unionByName, seeds).write.parquet(f"{path}/level-0")
    for level, fallen in enumerate(reversed(forest), 1):
        parents = named().withColumnRenamed("node", "parent")
        skew.lookup_join(fallen, parents, "parent").select(F.col("u").alias("node"), "group").write.parquet(f"{path}/level-{level}")
    return named()


def twin_groups(twins: DataFrame) -> DataFrame:
    """(node, group) over the pairs nested in twins.twins, ids trimmed and upper-cased; blank ids are missing."""
    name = lambda c: F.expr(f"nullif(upper(regexp_replace({c}, '(?U)^\\\\s+|\\\\s+$', '')), '')")
    flat = twins.select(F.explode("twins").alias("t")).select(name("t.a.work").alias("a"), name("t.b.work").alias("b"))
    return components(flat, "a", "b")
