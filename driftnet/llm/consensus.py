"""Consensus of several annotators by iteratively reweighted voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.plans import skew

#: Rounds at most; results tell whether the weights had become stable by then.
ROUNDS = 40
TOLERANCE = 1e-4
#: Smoothing of an annotator's accuracy: so many agreements in twice as many ratings at the start.
PRIOR = 1.0


def clean_label(label: Column) -> Column:
    """Lower case without white space and line ends around it; null if nothing is left."""
    trimmed = F.regexp_replace(F.lower(label), r"(?U)^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$", "")
    return F.when(F.length(trimmed) > 0, trimmed)


def _leaders(votes: DataFrame) -> DataFrame:
    """(item, best, t1, next, t2, total, raters): the two best supported labels of each item; ties to the smaller label.

    Support is rounded, so that a sum taken in another order can't break a tie. The rank limit also
    runs before the shuffle, so an item with very many labels isn't gathered.
    """
    r = F.row_number().over(W.partitionBy("item").orderBy(F.desc("t"), "label"))
    two = votes.withColumn("t", F.round("t", 9)).withColumn("r", r).filter("r <= 2")
    pick = lambda c, i, a: F.max(F.when(F.col("r") == i, F.col(c))).alias(a)
    return two.groupBy("item").agg(pick("label", 1, "best"), pick("t", 1, "t1"), pick("label", 2, "next"), pick("t", 2, "t2"))


def ratings_of(rows: DataFrame, item: list[str], annotator: Column, label: Column, scope: str) -> DataFrame:
    """(item, scope, annotator, label), one row per item and annotator, staged.

    Null items, annotators and labels, and labels of white space only, are missing ratings and left out. An annotator who
    gives one item several labels counts by the one given most often, ties to the smaller.
    """
    ok = annotator.isNotNull()
    for c in item:
        ok &= F.col(c).isNotNull()
    key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in item])
    slim = rows.filter(ok).select(key.alias("item"), F.col(scope).cast("string").alias("scope"), annotator.alias("annotator"), clean_label(label).alias("label"))
    each = slim.filter("label is not null").groupBy("item", "scope", "annotator", "label").agg(F.count(F.lit(1)).alias("n"))
    one = each.groupBy("item", "scope", "annotator").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    return session.stage(one, "ratings")


class Consensus:
    """The outcome: labels (item, label, support, raters), annotators (annotator, rated, matched,
    reliability, weight, kappa), agreement (scope, items, ratings, alpha, stable), the rounds taken, and how far
    a weight moved in the last of them; stable is true if that was less than the tolerance."""

    def __init__(self, labels: DataFrame, annotators: DataFrame, agreement: DataFrame, rounds: int, moved: float, stable: bool):
        self.labels, self.annotators, self.agreement, self.rounds, self.moved, self.stable = labels, annotators, agreement, rounds, moved, stable


def consensus(ratings: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Consensus:
    """Alternate weighted consensus and leave-one-out accuracy until no weight moves by `tolerance`.

    Weights that go on moving for `rounds` rounds end there, and the results say so by `stable`.
    ratings as from ratings_of(). An item's label is the one of the largest sum of its raters'
    weights. An annotator's accuracy is the share of ratings that agree with the consensus of the
    item's other raters, smoothed; items with no other rater don't count. The weight is the log odds
    of the accuracy against one of K labels at random, at least 0.01, so that a bad annotator never
    counts negatively. Without ratings all results are empty.
    """
    spark = ratings.sparkSession
    k = ratings.select("scope", "label").distinct().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("scope").alias("s")).first()
    k = max(2.0, k["n"] / max(1, k["s"]))
    hot = skew.hot_keys(ratings, "item")
    weights = session.stage(ratings.select("annotator").distinct().withColumns({"weight": F.lit(1.0), "rated": F.lit(0).cast("bigint"), "matched": F.lit(0).cast("bigint"), "reliability": F.lit(0.5)}), "weights")
    done, most, stable = 0, None, False
    for _ in range(rounds):
        done += 1
        weighted = ratings.join(weights.select("annotator", "weight"), "annotator")
        leaders = _leaders(weighted.groupBy("item", "label").agg(F.sum("weight").alias("t")))
        seen = skew.lookup_join(weighted, leaders, "item", hot=hot)
        rest = F.round(F.col("t1") - F.col("weight"), 9)
        alone = (rest <= 0) & F.col("next").isNull()
        agrees = (rest > 0) & (F.col("next").isNull() | (rest > F.col("t2")) | ((rest == F.col("t2")) & (F.col("best") < F.col("next"))))
        match = F.when(F.col("label") != F.col("best"), F.lit(0)).when(~alone, agrees.cast("int"))
        scored = seen.select("annotator", match.alias("m")).groupBy("annotator").agg(F.count("m").alias("rated"), F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("matched"))
        accuracy = (F.col("matched") + PRIOR) / (F.col("rated") + 2 * PRIOR)
        moved = scored.withColumn("reliability", accuracy).withColumn("weight", F.greatest(F.lit(0.01), F.log(accuracy * (k - 1) / (1 - accuracy))))
        fresh = session.stage(moved.select("annotator", "weight", "rated", "matched", "reliability"), "weights")
        most = fresh.join(weights.select("annotator", F.col("weight").alias("was")), "annotator").agg(F.max(F.abs(F.col("weight") - F.col("was"))).alias("d")).first()["d"]
        weights = fresh
        stable = most is None or most < tolerance
        if stable:
            break
    weighted = ratings.join(weights.select("annotator", "weight"), "annotator")
    tallied = session.stage(weighted.groupBy("item", "scope", "label").agg(F.sum("weight").alias("t"), F.count(F.lit(1)).alias("n")), "tallies")
    totals = tallied.groupBy("item").agg(F.sum("t").alias("all"), F.sum("n").alias("raters"))
    labels = _leaders(tallied).join(totals, "item").select("item", F.col("best").alias("label"), (F.col("t1") / F.col("all")).alias("support"), "raters")
    return Consensus(labels, _annotators(ratings, weights), _agreement(tallied).withColumn("stable", F.lit(stable)), done, float(most or 0.0), stable)


def _agreement(tallied: DataFrame) -> DataFrame:
    """Krippendorff's nominal alpha by scope, over items with two or more ratings; null if nothing could differ."""
    sizes = tallied.groupBy("scope", "item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).filter("m > 1")
    observed = sizes.groupBy("scope").agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("ratings"), F.sum(F.col("same") / (F.col("m") - 1)).alias("same"))
    used = tallied.join(sizes.select("item"), "item", "left_semi").groupBy("scope", "label").agg(F.sum("n").alias("c"))
    chance = used.groupBy("scope").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    n, e = F.col("ratings"), F.col("pairs") / (F.col("ratings") * (F.col("ratings") - 1))
    alpha = F.when(e < 1, 1 - (1 - F.col("same") / n) / (1 - e))
    return observed.join(chance, "scope").select("scope", "items", "ratings", alpha.alias("alpha"))


def _annotators(ratings: DataFrame, weights: DataFrame) -> DataFrame:
    """weights with kappa: accuracy beyond what an annotator's use of labels would reach by chance."""
    own = ratings.groupBy("annotator", "scope", "label").agg(F.count(F.lit(1)).alias("c"))
    whole = own.groupBy("scope", "label").agg(F.sum("c").alias("w"))
    total = whole.groupBy("scope").agg(F.sum("w").alias("t"))
    expected = own.join(whole, ["scope", "label"]).join(total, "scope").groupBy("annotator").agg((F.sum(F.col("c") * F.col("w") / F.col("t")) / F.sum("c")).alias("e"))
    raw = F.when(F.col("rated") > 0, F.col("matched") / F.col("rated"))
    kappa = F.when(F.col("e") < 1, (raw - F.col("e")) / (1 - F.col("e")))
    return weights.join(expected, "annotator").select("annotator", "rated", "matched", "reliability", "weight", kappa.alias("kappa"))


def label_consensus(descriptions: DataFrame) -> Consensus:
    """Consensus over the models' labels of papers and facets; a model is its provider and id, nulls as ''."""
    model = F.when(F.col("model").isNotNull(), F.concat_ws("/", F.coalesce("model.provider", F.lit("")), F.coalesce("model.id", F.lit(""))))
    flat = descriptions.select("work", model.alias("who"), F.explode("descriptions").alias("d")).select("work", "who", F.col("d.facet").alias("facet"), F.col("d.label").alias("said"))
    return consensus(ratings_of(flat, ["work", "facet"], F.col("who"), F.col("said"), "facet"))
