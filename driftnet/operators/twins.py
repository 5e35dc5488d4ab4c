"""Matching alike papers across fields from their descriptions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.functions import text as T
from driftnet.operators import vectors as V


@dataclass(frozen=True)
class TwinRules:
    chance_pairs: int = 20_000
    reliable: float = 0.95
    distinct: float = 0.99
    tie: float = 1e-4
    generic: float = 0.95
    twins: int = 50
    per_paper: int = 2
    candidates: int = 40
    neighbours: int = 5
    why: int = 6
    least_df: int = 2
    #: Words in more than this share of the descriptions are left out of their vectors; 1 keeps all.
    most_share: float = 1.0


def described(descriptions: DataFrame) -> DataFrame:
    """(desc_id, work, model, text) of the rows with a work, a model and at least one text."""
    said = F.concat_ws(" ", "problem", "approach")
    model = F.concat_ws("/", "model.provider", "model.id")
    return descriptions.filter("work is not null and model is not null and desc_id is not null").select("desc_id", "work", model.alias("model"), said.alias("text")).filter("trim(text) <> ''")


def description_vectors(rows: DataFrame, rules: TwinRules = TwinRules()) -> DataFrame:
    """(doc, work, term, w) of descriptions as from described()."""
    tf = V.doc_terms(rows, "desc_id", T.without(T.tokens(F.col("text")), list(T.STOP_WORDS)), "work")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return V.tfidf(tf, n, rules.least_df, rules.most_share, ("work",))


def field_of(papers: DataFrame) -> DataFrame:
    """(work, field): what a pair must cross: field, else domain, else the paper alone; one row a work."""
    name = F.coalesce(F.nullif("field", F.lit("")), F.nullif("domain", F.lit("")), F.col("work"))
    return papers.filter("work is not null").groupBy("work").agg(F.min(name).alias("field"))


def agreements(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(work, x, y, model_x, model_y, agreement) of all pairs of a paper's descriptions by different models.

    Agreements aren't rounded: means are taken of them, and rounded once.
    """
    x = rows.select("work", F.col("desc_id").alias("x"), F.col("model").alias("model_x"))
    y = rows.select("work", F.col("desc_id").alias("y"), F.col("model").alias("model_y"))
    pairs = x.join(y, "work").filter("x < y and model_x <> model_y").withColumn("pair", F.concat_ws("-", "x", "y"))
    slim = vectors.select("doc", "term", "w")
    return V.dots(pairs, slim, "x", "y").select("work", "x", "y", "model_x", "model_y", F.col("dot").alias("agreement"))


def model_report(rows: DataFrame, agreed: DataFrame) -> DataFrame:
    """(model, descriptions, papers, pairs, agreement); each pair counts for both of its models."""
    counts = rows.groupBy("model").agg(F.count(F.lit(1)).alias("descriptions"), F.countDistinct("work").alias("papers"))
    both = agreed.select(F.explode(F.array("model_x", "model_y")).alias("model"), "agreement")
    means = both.groupBy("model").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("agreement"), 4).alias("agreement"))
    return counts.join(means, "model", "left").fillna(0, ["pairs"])


def closest_descriptions(agreed: DataFrame) -> DataFrame:
    """(work, desc_id, agreement): of each paper's descriptions the one of highest mean agreement with the others by
    other models, ties to the smaller; from agreements()."""
    both = agreed.select("work", F.col("x").alias("desc_id"), "agreement").unionByName(agreed.select("work", F.col("y").alias("desc_id"), "agreement"))
    mean = both.groupBy("work", "desc_id").agg(F.round(F.avg("agreement"), 9).alias("agreement"))
    best = mean.groupBy("work").agg(F.min_by(F.struct("desc_id", "agreement"), F.struct(-F.col("agreement"), "desc_id")).alias("x"))
    return best.select("work", "x.desc_id", "x.agreement")


def loaded(papers: DataFrame, gold: DataFrame, abstracts: DataFrame) -> DataFrame:
    """One row a paper: its metadata, filled up from the benchmark's, and its longest text; missing sides are null.

    A paper is one of papers or of gold; where papers leave a value null, gold's holds.
    """
    one = lambda df, cols: df.filter("work is not null").groupBy("work").agg(*[F.min(F.nullif(c, F.lit(""))).alias(c) for c in cols])
    known = ["field", "domain", "family", "role"]
    both = one(papers, ["topic", *known]).join(one(gold, known).select("work", *[F.col(c).alias(f"g_{c}") for c in known]), "work", "full_outer")
    said = abstracts.filter("work is not null and abstract is not null").groupBy("work").agg(F.min(F.struct(-F.length("abstract"), "abstract", "title")).alias("x"))
    return both.join(said.select("work", "x.title", "x.abstract"), "work", "left").select("work", "topic", *[F.coalesce(c, f"g_{c}").alias(c) for c in known], "title", "abstract")


def chance_pairs(rows: DataFrame, n: int, seed: int = 2025) -> DataFrame:
    """(pair, x, y): n pairs of descriptions of different papers at most, drawn by hashes of a running number.

    Both sides are drawn by rank in a hashed order, so any rerun draws the same pairs and nothing is
    collected: rows are numbered by a range partitioning.
    """
    from driftnet.operators.metrics import ranked

    digest = lambda *k: F.conv(F.left(F.sha2(F.concat_ws("|", F.lit(str(seed)), *k), 256), F.lit(8)), 16, 10).cast("bigint")
    order = rows.select("desc_id", "work", digest(F.col("desc_id").cast("string")).alias("h"))
    numbered = ranked(order.withColumn("minus", -F.col("h")), "minus", ["desc_id"]).select("rank", "desc_id", "work")
    total = numbered.agg(F.max("rank").alias("n"))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("pair")).crossJoin(F.broadcast(total)).filter("n > 0")  # one row
    side = lambda s: (digest(F.lit(s), F.col("pair").cast("string")) % F.col("n") + 1)
    draws = draws.select("pair", side("i").alias("i"), side("j").alias("j"))
    x = numbered.select(F.col("rank").alias("i"), F.col("desc_id").alias("x"), F.col("work").alias("wx"))
    y = numbered.select(F.col("rank").alias("j"), F.col("desc_id").alias("y"), F.col("work").alias("wy"))
    return draws.join(x, "i").join(y, "j").filter("wx <> wy").select("pair", "x", "y")


def paper_vectors(vectors: DataFrame) -> DataFrame:
    """(doc, term, w): unit mean vectors, doc being the work."""
    return V.mean_vectors(vectors, "work").withColumnRenamed("work", "doc")


def mean_likeness(papers: DataFrame) -> DataFrame:
    """(doc, likeness): mean cosine to all other papers, from the sum of all vectors; no pairs are formed."""
    total = papers.groupBy("term").agg(F.sum("w").alias("t"))
    n = papers.select("doc").distinct().agg(F.count(F.lit(1)).alias("n"))
    against = papers.join(total, "term").groupBy("doc").agg((F.sum(F.col("w") * F.col("t")) - F.sum(F.col("w") * F.col("w"))).alias("s"))
    return against.crossJoin(F.broadcast(n)).select("doc", F.round(F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)), 9).alias("likeness"))  # n is one row


def field_vectors(papers: DataFrame, abstracts: DataFrame, least_df: int = 2) -> DataFrame:
    """(field, term, w): unit sums of the TF-IDF vectors of a field's titles and abstracts.

    Only works of papers with an abstract count, one text a work: the longest, ties to the smaller.
    """
    have = abstracts.filter("abstract is not null and abstract <> '' and work is not null")
    said = have.select("work", F.concat_ws(" ", "title", "abstract").alias("text"))
    one = said.groupBy("work").agg(F.min(F.struct(-F.length("text"), "text")).alias("x")).select("work", "x.text")
    rows = one.join(field_of(papers), "work")
    tf = V.doc_terms(rows, "work", T.without(T.tokens(F.col("text")), list(T.STOP_WORDS)), "field")
    return V.mean_vectors(V.tfidf(tf, rows.agg(F.count(F.lit(1)).alias("n")), least_df, keep=("field",)), "field")


def field_distances(fields: DataFrame) -> DataFrame:
    """(a, b, distance), a < b: one minus the cosine of two fields' vectors, within 0 and 1; fields sharing no term aren't listed."""
    near = V.block_cosines(fields, "field")
    return near.select("a", "b", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cosine"))), 6).alias("distance"))


def near_pairs(papers: DataFrame, fields: DataFrame, distances: DataFrame, k: int) -> DataFrame:
    """(work, other, similarity, distance, score) of each paper's k nearest of other fields, by similarity and by score."""
    placed = papers.join(fields.withColumnRenamed("work", "doc"), "doc", "left").withColumn("field", F.coalesce("field", "doc"))
    return V.block_neighbours(placed, "field", k, distances).withColumnRenamed("doc", "work")


def known_pairs(papers: DataFrame, fields: DataFrame, distances: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, similarity, distance, score) of papers of one family and different fields; a family has a few papers."""
    own = known.select(F.col("work").alias("a"), "family").join(known.select(F.col("work").alias("b"), "family"), "family").filter("a < b").withColumn("pair", F.concat_ws("-", "a", "b"))
    for s in "ab":
        own = own.join(fields.select(F.col("work").alias(s), F.col("field").alias(f"f{s}")), s, "left").withColumn(f"f{s}", F.coalesce(f"f{s}", s))
    near = V.dots(own.filter("fa <> fb"), papers, "a", "b")
    d = distances.select(F.col("a").alias("fx"), F.col("b").alias("fy"), "distance")
    near = near.withColumns({"fx": F.least("fa", "fb"), "fy": F.greatest("fa", "fb")}).join(d, ["fx", "fy"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
    s = F.round("dot", 6)
    return near.filter(s > 0).select("a", "b", s.alias("similarity"), "distance", F.round(s * F.col("distance"), 6).alias("score"))


def families(papers: DataFrame) -> DataFrame:
    """(work, family) of benchmark members, one row a work."""
    return papers.filter("family is not null and role = 'member' and work is not null").groupBy("work").agg(F.min("family").alias("family"))


def both_sides(pairs: DataFrame) -> DataFrame:
    """Each pair from both sides: (work, other, and the other columns)."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.col("a").alias("work"), F.col("b").alias("other"), *rest).unionByName(pairs.select(F.col("b").alias("work"), F.col("a").alias("other"), *rest))


def top_partners(near: DataFrame, by: str, k: int) -> DataFrame:
    """(work, other, rank, ...): the k best partners of each paper by `by`, ties by name, from near_pairs of k or more."""
    r = F.row_number().over(W.partitionBy("work").orderBy(F.desc(by), "other"))
    return near.withColumn("rank", r).filter(F.col("rank") <= k)


def candidates(near: DataFrame, k: int) -> DataFrame:
    """(a, b, similarity, distance, score): the pairs among either side's k best by score."""
    best = top_partners(near, "score", k)
    pairs = best.select(F.least("work", "other").alias("a"), F.greatest("work", "other").alias("b"), "similarity", "distance", "score")
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.max("distance").alias("distance"), F.max("score").alias("score"))


def reliable(agreed: DataFrame, papers: DataFrame, threshold: Column | float, rules: TwinRules = TwinRules()) -> DataFrame:
    """(work, agreement): papers whose models agree beyond chance and beyond the paper's likeness to others.

    The percentile of a paper's likeness is over all other papers, those that share no term included as
    0, with linear interpolation between the two places around it. So only papers past the threshold are
    compared, and of each only how many others are as like, or nearly so, is counted: the percentile
    itself matters only where it lies between the least of these and the most like of the rest.
    """
    mean = agreed.groupBy("work").agg(F.avg("agreement").alias("agreement")).filter(F.col("agreement") > threshold)
    mean = session.stage(mean.withColumn("level", F.round("agreement", 6)), "mean")
    n = papers.select("doc").distinct().count()
    # place of the percentile among n - 1 values, from the top
    at = max(0.0, (1 - rules.distinct) * (n - 2))
    low, part = int(at), at - int(at)
    seen = V.above(papers, mean.select(F.col("work").alias("doc"), "level"), rules.tie).withColumnRenamed("doc", "work")
    told = mean.join(seen, "work", "left").fillna({"others": 0, "failing": 0, "most_passing": 0.0})
    zeros = F.when(F.col("level") <= rules.tie, F.lit(n - 1) - F.col("others")).otherwise(0)  # papers without a shared term fail too
    failing = F.col("failing") + zeros
    cut = F.when(zeros > 0, 0.0).otherwise(F.col("least_failing")) * (1 - part) + F.col("most_passing") * part
    sure = (failing <= low) | ((failing == low + 1) & (F.col("level") > F.round(cut + rules.tie, 6)))
    return told.filter(sure).select("work", F.col("level").alias("agreement"))


def select_with_quota(ranked: DataFrame, limit: int, per_paper: int, used: Counter | None = None) -> list[tuple[str, str, float]]:
    """The first `limit` pairs by score in which no paper appears more than per_paper times.

    Greedy and so in order; rows stream to the driver a partition at a time and stop once the limit is
    reached. used carries a quota over from an earlier selection.
    """
    used = Counter() if used is None else used
    out: list[tuple[str, str, float]] = []
    for r in ranked.select("a", "b", "score").orderBy(F.desc("score"), "a", "b").toLocalIterator():
        if len(out) >= limit:
            break
        if used[r["a"]] < per_paper and used[r["b"]] < per_paper:
            used[r["a"]] += 1
            used[r["b"]] += 1
            out.append((r["a"], r["b"], r["score"]))
    return out


def combine(descriptions: DataFrame, papers: DataFrame, abstracts: DataFrame, rules: TwinRules = TwinRules()) -> dict[str, DataFrame]:
    """The whole flow: models, twins (confirmed, then provisional), known cases and neighbours."""
    spark = descriptions.sparkSession
    rows = session.stage(described(descriptions), "described")
    vectors = session.stage(description_vectors(rows, rules), "vectors")
    agreed = session.stage(agreements(rows, vectors), "agreed")
    chance = V.dots(chance_pairs(rows, rules.chance_pairs), vectors.select("doc", "term", "w"), "x", "y")
    threshold = chance.agg(F.percentile("dot", F.lit(rules.reliable)).alias("t")).first()["t"]
    whole = session.stage(paper_vectors(vectors), "papers")
    likeness = mean_likeness(whole)
    cut = likeness.agg(F.percentile("likeness", F.lit(rules.generic)).alias("c")).first()["c"]
    fields = field_of(papers)
    distances = session.stage(field_distances(field_vectors(papers, abstracts)), "distances")
    known = families(papers)
    near = session.stage(near_pairs(whole, fields, distances, max(rules.candidates, rules.neighbours)), "near")
    trusted = session.stage(reliable(agreed, whole, F.lit(threshold if threshold is not None else 2.0), rules), "trusted")
    generic = session.stage(likeness.filter(F.col("likeness") > F.lit(cut if cut is not None else 2.0)).select(F.col("doc").alias("work")), "generic")
    pairs = session.stage(candidates(near, rules.candidates), "pairs")
    flags = pairs
    for s in "ab":
        flags = flags.join(known.select(F.col("work").alias(s), F.col("family").alias(f"k{s}")), s, "left")
        flags = flags.join(trusted.select(F.col("work").alias(s), F.lit(1).alias(f"t{s}")), s, "left").join(generic.select(F.col("work").alias(s), F.lit(1).alias(f"g{s}")), s, "left")
    flags = session.stage(flags.filter("not coalesce(ka = kb, false)"), "flags")
    used: Counter = Counter()
    sure = select_with_quota(flags.filter("ta = 1 and tb = 1"), rules.twins, rules.per_paper, used)
    leads = select_with_quota(flags.filter("not (coalesce(ta, 0) = 1 and coalesce(tb, 0) = 1) and ga is null and gb is null"), rules.twins, rules.per_paper, used)
    chosen = spark.createDataFrame([(a, b, "two models agree") for a, b, _ in sure] + [(a, b, "one model so far") for a, b, _ in leads], "a string, b string, trust string")
    twins = pairs.join(F.broadcast(chosen), ["a", "b"])  # at most 2 * rules.twins rows
    return {"models": model_report(rows, agreed), "reliable": trusted, "twins": twins, "known_cases": known_pairs(whole, fields, distances, known), "neighbours": top_partners(near, "similarity", rules.neighbours), "vectors": whole}


def visible(papers: DataFrame, described: DataFrame, hidden: list[str] | None = None, field: str | None = None) -> DataFrame:
    """The papers (work, domain, field) an explorer shows: of domains that aren't hidden, of one field if one is chosen,
    with a description. A paper without a domain is never hidden."""
    rows = papers.join(described.select("work").distinct(), "work", "left_semi")
    if hidden:
        rows = rows.filter(F.col("domain").isNull() | ~F.col("domain").isin(*hidden))
    return rows.filter(F.col("field") == field) if field else rows


def shown_once(pairs: DataFrame, group: str, n: int) -> DataFrame:
    """(group, a, b, score, pos): the first n pairs (x, y, score) of each group by score, a pair once in whatever direction,
    with its best score; ties by name."""
    once = pairs.groupBy(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("score").alias("score"))
    r = F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last("score"), "a", "b"))
    return once.withColumn("pos", r).filter(F.col("pos") <= n)


def nested(twins: DataFrame, words: DataFrame, fields: DataFrame) -> DataFrame:
    """twins as nested rows: score, similarity, field_distance, trust, why, and both sides."""
    why = words.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("term").alias("word"), "share"))).alias("w"))
    out = twins.join(why, ["a", "b"], "left")
    for s in "ab":
        out = out.join(fields.select(F.col("work").alias(s), F.col("field").alias(f"field_{s}")), s, "left")
    side = lambda s: F.struct(F.col(s).alias("work"), F.col(f"field_{s}").alias("field")).alias(s)
    return out.select("score", "similarity", F.col("distance").alias("field_distance"), "trust", F.transform("w", lambda x: F.struct(x.word.alias("word"), x.share.alias("share"))).alias("why"), side("a"), side("b"))
