"""Queries of the citation graph, pair features, rankings and models."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet import session
from driftnet.operators import content, graph, metrics, stats, study
from driftnet.plans import sql as Q
from driftnet.plans.text_queries import CENTRES_SQL, CLOSEST_SQL, WHOLE_SQL, topics_sql
from driftnet.session import table

#: Features are of records as of FREEZE; what came after is told by the records of AFTER.
FREEZE, AFTER = 2017, 2025
#: The years before, to fit on.
FIT_FREEZE, FIT_AFTER = 2011, 2017
#: The test tables' counts are larger than those of the rules' defaults.
RULES = graph.PairRules(most_prior=150, least_after=100, least_usable=5)
NAMES = graph.FEATURES


def _current(spark: SparkSession, d: str, freeze: int | None = None) -> DataFrame:
    rows = graph.current_records(table(spark, d, "records"))
    return rows.filter(F.col("freeze") == freeze) if freeze else rows


def records_current(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select("topic", "freeze", "record", "size", "usable_abstracts")


def works_by_year(spark: SparkSession, d: str) -> DataFrame:
    return graph.works_by_year(_current(spark, d))


def topic_growth(spark: SparkSession, d: str) -> DataFrame:
    return graph.growth(_current(spark, d)).withColumn("growth", F.round("growth", 6))


def citing_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.citing_counts(_current(spark, d)).withColumnRenamed("window", "win")


def missing_records(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "topics").filter("id is not null").select(F.col("id").alias("topic"))
    freezes = F.explode(F.array(*[F.lit(y) for y in (FIT_FREEZE, FREEZE, AFTER)]))
    return graph.missing_records(topics.select("topic", freezes.alias("freeze")), table(spark, d, "records"))


def _near(spark: SparkSession, d: str, window: str = "train") -> tuple[DataFrame, DataFrame]:
    records = _current(spark, d, FREEZE)
    sample = table(spark, d, "topics").filter("id is not null and domain is not null").join(records.select(F.col("topic").alias("id")), "id", "left_semi")
    return graph.neighbourhoods(graph.citing_counts(records), sample, window), sample


def topic_degrees(spark: SparkSession, d: str) -> DataFrame:
    degree, _ = graph.degree_reach(_near(spark, d)[0])
    return degree.select("topic", "deg", F.round("norm", 6).alias("norm"))


def citer_reach(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_reach(_near(spark, d)[0])[1]


def common_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near, sample = _near(spark, d)
    return graph.common_neighbours(near, sample).select("a", "b", "common", F.round("adamic_adar", 6).alias("adamic_adar"), "dot")


def two_step_paths(spark: SparkSession, d: str) -> DataFrame:
    near, sample = _near(spark, d)
    return graph.two_step_paths(near, sample, sample)


def _content(spark: SparkSession, d: str, freeze: int, kinds: DataFrame | None = None) -> DataFrame:
    """How close topics' texts of the years up to the freeze are."""
    return content.content(content.topic_texts(table(spark, d, "abstracts"), table(spark, d, "papers"), freeze, 1, kinds))


def _cells(spark: SparkSession, d: str, freeze: int) -> DataFrame:
    """Topics' vectors of the years up to the freeze, which the same is computed from pair by pair, of all their texts."""
    texts = content.topic_texts(table(spark, d, "abstracts"), table(spark, d, "papers"), freeze, 1)
    return session.stage(content.topic_cells(session.stage(content.topic_vectors(texts), "topic-vectors"), first=None), "cells")


def _later(spark: SparkSession, d: str, after: int) -> DataFrame:
    return graph.citing_counts(_current(spark, d, after)).filter(F.col("window") == "train").groupBy("cited", "citing").agg(F.sum("n").alias("n"))


def _pairs(spark: SparkSession, d: str, freeze: int = FREEZE, after: int = AFTER, rules: graph.PairRules = RULES, said: DataFrame | None = None) -> DataFrame:
    """The pair table, not staged: every reader makes it again, so those with several stage the columns they need."""
    said = _cells(spark, d, freeze) if said is None else said
    return graph.pair_table(table(spark, d, "topics"), _current(spark, d, freeze), rules, _later(spark, d, after), cells=said)


def _staged_pairs(spark: SparkSession, d: str, freeze: int = FREEZE, after: int = AFTER, extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns that models are fitted on, and `extra`."""
    return session.stage(_pairs(spark, d, freeze, after).select(*NAMES, "label", *extra), "pairs")


def pair_table(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", "domain_pair", *[F.round(n, 6).alias(n) for n in NAMES], "ab", "ba", "label")


def link_directions(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).filter("label = 1")
    return rows.agg(F.count_if((F.col("ab") > 0) & (F.col("ba") > 0)).alias("both"), F.count_if((F.col("ab") == 0) | (F.col("ba") == 0)).alias("one_way"))


def domain_pair_summary(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("domain_pair").agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").alias("connected"), F.sum("prior").alias("prior"))


def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_sd(_pairs(spark, d), NAMES).select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", "domain_pair", "label", F.round("cocite_cosine", 6).alias("score"))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.average_precision(_scored(spark, d), "score", "label", ["domain_pair"])
    return found.select("domain_pair", F.round("positives", 6).alias("positives"), F.when(F.col("positives") >= 5, F.round("ap", 6)).alias("ap"))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, d), "score", "label", ["domain_pair"]).withColumn("auc", F.round("auc", 6))


def precision_at_100(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_at(_scored(spark, d), "score", "label", 100, ["a", "b"]).withColumn("precision", F.round("precision", 6))


#: A small stored model to score pairs with; any other is a parameter.
MODEL = {"log_size_hi": (6.0, 1.5, 0.4), "log_size_lo": (5.0, 1.5, 0.6), "cocite_cosine": (0.05, 0.1, 0.9), "jaccard": (0.05, 0.05, 0.5), "prior_links": (60.0, 50.0, 1.1)}
INTERCEPT = -0.75


def _model_score():
    m = MODEL
    return metrics.logit_score({k: v[0] for k, v in m.items()}, {k: v[1] for k, v in m.items()}, {k: v[2] for k, v in m.items()}, INTERCEPT)


def logit_scores(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("a", "b", F.round(_model_score(), 6).alias("score"))


def forward_ranking(spark: SparkSession, d: str) -> DataFrame:
    scored = session.stage(logit_scores(spark, d), "scored")
    return metrics.ranked(scored, "score", ["a", "b"]).select("rank", "a", "b", F.format_string("%.6f", "score").alias("score"))


def yearly_scoring(spark: SparkSession, d: str) -> DataFrame:
    """The published ranking held against the counts of the years since: links in both directions, by rank band."""
    ranking = metrics.ranked(session.stage(logit_scores(spark, d), "scored"), "score", ["a", "b"])
    counts = graph.citing_counts(_current(spark, d, AFTER)).filter(F.col("window") == "recent").groupBy("cited", "citing").agg(F.sum("n").alias("n"))
    joined = graph.both_ways(ranking, counts, "ab", "ba")
    band = F.when(F.col("rank") <= 50, "1 to 50").when(F.col("rank") <= 200, "51 to 200").otherwise("beyond")
    return joined.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("ab") + F.col("ba") > 0).alias("connected"))


def logit_fit(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the four models on the earlier pairs."""
    models = study.fit_models(_staged_pairs(spark, d, FIT_FREEZE, FIT_AFTER))
    rows = [study.model_row(spark, m, x) for m, x in models.items()]
    return reduce(DataFrame.unionByName, rows)


def logit_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The gradient of each model's objective at its coefficients, by one more pass over the pairs: 0 at the optimum."""
    pairs = _staged_pairs(spark, d, FIT_FREEZE, FIT_AFTER)
    parts = [study.gradient(pairs, x).select(F.lit(m).alias("model"), "feature", F.abs(F.round("gradient", 4)).alias("gradient")) for m, x in study.fit_models(pairs).items()]
    return reduce(DataFrame.unionByName, parts)


def model_measures(spark: SparkSession, d: str) -> DataFrame:
    """The four models and the random floor on the later pairs."""
    models = study.fit_models(_staged_pairs(spark, d, FIT_FREEZE, FIT_AFTER))
    scored = study.with_scores(_pairs(spark, d), models)
    return study.measures(session.stage(scored.select("a", "b", "label", *[c for c in scored.columns if c.startswith("score_")]), "scored"))


def random_floor(spark: SparkSession, d: str) -> DataFrame:
    """Measures of scores that depend on the pairs' names alone, and of the stored model."""
    scored = _pairs(spark, d).select("a", "b", "label", F.round(study.random_score(1, "a", "b"), 9).alias("score_random"), F.round(_model_score(), 6).alias("score_stored"))
    return study.measures(session.stage(scored, "scored"), (100,)).select("model", *[F.round(c, 6).alias(c) for c in ("average_precision", "roc_auc", "precision_at_100")])


def measures_by_domain_pair(spark: SparkSession, d: str) -> DataFrame:
    scored = session.stage(_pairs(spark, d).select("domain_pair", "label", F.round(_model_score(), 6).alias("score_stored")), "scored")
    return study.by_domain_pair(scored).withColumn("ap", F.round("ap", 6))


def top_predictions(spark: SparkSession, d: str) -> DataFrame:
    scored = session.stage(_pairs(spark, d).select("a", "b", F.round(_model_score(), 6).alias("score"), "prior", "ab", "ba", "label"), "scored")
    return study.top_predictions(scored, "score", table(spark, d, "topics").filter("id is not null"))


def pairs_scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with both sides' names, links in both directions and the columns of scores: the table that is exported."""
    topics = table(spark, d, "topics").filter("id is not null")
    pairs = _pairs(spark, d).withColumns({"score_stored": F.round(_model_score(), 6), "score_random": F.round(study.random_score(1, "a", "b"), 9)})
    for s in "ab":
        pairs = pairs.join(F.broadcast(topics.select(F.col("id").alias(s), F.col("name").alias(f"name_{s}"), F.col("field").alias(f"field_{s}"), F.col("domain").alias(f"domain_{s}"))), s)  # topics, of which there are thousands
    return pairs.select("a", "b", *[f"{c}_{s}" for c in ("name", "field", "domain") for s in "ab"], F.col("prior").alias("prior_link_count"), F.col("ab").alias("links_a_to_b"), F.col("ba").alias("links_b_to_a"), (F.col("ab") + F.col("ba")).alias("links_after"), F.col("label").alias("connected"), "score_stored", "score_random")


#: Variants of the rules that conclusions are held against, and one that leaves no pairs.
VARIANTS = {
    "main": RULES, "fewer links": replace(RULES, least_after=80), "more links": replace(RULES, least_after=150), "no link before": replace(RULES, most_prior=0),
    "large topics": replace(RULES, least_size=1000), "none": replace(RULES, least_size=10**9),
}


def robustness_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each variant's pairs, how many are connected, and the stored model's average precision, or why there is none."""
    parts, said = [], _cells(spark, d, FREEZE)
    for key, rules in VARIANTS.items():
        scored = session.stage(_pairs(spark, d, rules=rules, said=said).select("label", F.round(_model_score(), 6).alias("score")), "scored")
        n = scored.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("label"), F.lit(0)).alias("connected"))
        ap = metrics.average_precision(scored, "score", "label").select(F.round("ap", 6).alias("ap"))
        kinds = F.when(F.col("pairs") == 0, "no pairs").when(F.col("connected") == 0, "no pair is connected").when(F.col("connected") == F.col("pairs"), "no pair is unconnected")
        both = n.crossJoin(F.broadcast(ap))  # one row each
        parts.append(both.select(F.lit(key).alias("variant"), "pairs", "connected", F.when(kinds.isNull(), F.col("ap")).alias("ap"), kinds.alias("skipped")))
    return reduce(DataFrame.unionByName, parts)


def feature_equality(spark: SparkSession, d: str) -> DataFrame:
    """The largest difference between the pair table's set features and the same from arrays of neighbours."""
    names = ["log_deg_hi", "log_deg_lo", "log_common", "log_recent_common", "jaccard", "cocite_cosine"]
    pairs = session.stage(_pairs(spark, d).select("a", "b", *names), "pairs")
    near, recent = _near(spark, d)[0], _near(spark, d, "recent")[0]
    return study.largest_difference(pairs, study.set_features(pairs, near, recent), ["a", "b"], names).withColumn("largest", F.round("largest", 9))


def _types(spark: SparkSession, d: str) -> DataFrame:
    """(work, type): what kind of document each work is; the first by name where there are several."""
    kind = F.nullif(F.lower(F.trim("source")), F.lit(""))
    return table(spark, d, "documents").filter("work is not null").groupBy("work").agg(F.min(kind).alias("type"))


def work_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of every paper's work, null where none is known."""
    return table(spark, d, "papers").filter("work is not null").select("work").distinct().join(_types(spark, d), "work", "left")


RESEARCH = ("abstract", "preprint", "thesis", "review")


def research_only(spark: SparkSession, d: str) -> DataFrame:
    """The pair table's content features with research works' texts only."""
    kinds = _types(spark, d).filter(F.col("type").isin(*RESEARCH))
    return _content(spark, d, AFTER, kinds).select("a", "b", F.round("centroid_cos", 6).alias("centroid_cos"), F.round("top_pairs_cos", 6).alias("top_pairs_cos"))


def _domains(spark: SparkSession, d: str, pairs: DataFrame) -> dict[str, str]:
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    topics = table(spark, d, "topics").filter("id is not null and domain is not null").join(used, "id", "left_semi")
    return {r["id"]: r["domain"] for r in topics.select("id", "domain").toLocalIterator()}  # topics, of which there are thousands


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """95% intervals of the four models' average precision, 2,000 topic draws with refit."""
    fitting, later = _staged_pairs(spark, d, FIT_FREEZE, FIT_AFTER, ("a", "b")), _staged_pairs(spark, d, extra=("a", "b"))
    domains = _domains(spark, d, fitting.select("a", "b").unionByName(later.select("a", "b")))
    return stats.intervals(study.resampled(fitting, later, domains, study.BOOTSTRAP))


DRAWS = 400


def score_intervals(spark: SparkSession, d: str) -> DataFrame:
    """95% intervals of the average precision of published scores, topics drawn without refitting anything."""
    pairs = session.stage(_pairs(spark, d).select("a", "b", "label", F.round(_model_score(), 6).alias("stored"), F.round("cocite_cosine", 6).alias("cocite")), "pairs")
    rows = stats.bounded_pandas(pairs.orderBy("a", "b"))
    draws = stats.bootstrap(spark, None, rows, _domains(spark, d, pairs), {"stored": ["stored"], "cocite": ["cocite"]}, DRAWS, 2025, refit=False, redraw=0)
    return stats.intervals(draws).select("model", "draws", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Two scores' difference by pair of domains: its middle 95% over pairs, and what that would say."""
    gap = F.round(F.col("cocite_cosine") - F.col("jaccard"), 6)
    p = lambda q: F.percentile("gap", F.lit(q))
    rows = _pairs(spark, d).select("domain_pair", gap.alias("gap"), "cocite_cosine").groupBy("domain_pair").agg(p(0.025).alias("low"), p(0.975).alias("high"), F.avg(F.round("cocite_cosine", 6)).alias("level"))
    said = study.outcome(F.round("low", 9), F.round("high", 9), F.round(study.SMALLEST * F.col("level"), 9))
    return rows.select("domain_pair", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), said.alias("outcome"))


def study_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report, a row for each of its leaves; 200 draws here, 2,000 by default."""
    fitting = _staged_pairs(spark, d, FIT_FREEZE, FIT_AFTER, ("a", "b"))
    later = _staged_pairs(spark, d, extra=("a", "b", "domain_pair", "prior", "ab", "ba"))
    domains = _domains(spark, d, fitting.select("a", "b").unionByName(later.select("a", "b")))
    strict = later.select("a", "b", (F.col("ab") + F.col("ba") - F.col("prior")).alias("n"))
    tree = study.report(fitting, later, domains, 200, strict, RULES.least_after, {"freeze": FREEZE})
    return spark.createDataFrame(study.flat(tree), "item string, value string")


def yearly_measures(spark: SparkSession, d: str, through: int = AFTER, last: int = 2031) -> DataFrame:
    """The published ranking against the links of the years since: measures of the stored score and of a plain one."""
    counts = graph.citing_counts(_current(spark, d, AFTER)).filter(F.col("window") == "recent").groupBy("cited", "citing").agg(F.sum("n").alias("n"))
    pairs = _pairs(spark, d).select("a", "b", F.round(_model_score(), 6).alias("score_network"), F.round("log_size_lo", 6).alias("score_popularity"))
    rows = session.stage(graph.both_ways(pairs, counts, "ab", "ba").withColumn("label", (F.col("ab") + F.col("ba") >= 3).cast("int")), "scored")
    told = study.measures(rows, (100,))
    n = rows.agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").alias("connected"), F.round(F.avg("label"), 6).alias("chance"))
    both = told.crossJoin(F.broadcast(n))  # one row
    return both.select(F.lit(through).alias("through"), F.lit(through < last).alias("interim"), "model", "pairs", "connected", "chance", *[F.round(c, 6).alias(c) for c in ("average_precision", "roc_auc", "precision_at_100")])


def sample_topics(spark: SparkSession, d: str) -> DataFrame:
    """Six topics of each domain, drawn once and read again as they were drawn."""
    from driftnet.sources import samples

    topics = table(spark, d, "topics").filter("id is not null and domain is not null").select("id", "name", "domain")
    folder = session.stage_path(spark, "sample")
    samples.load_or_draw(spark, folder, topics, 6, 2026)
    return samples.load_or_draw(spark, folder, topics.limit(0), 6, 2026).select("domain", "id", "pos")


def _cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(work, topic, year) of the papers, and (work, reference): the other papers in their lists, as what they cite."""
    topic = table(spark, d, "papers").filter("work is not null").groupBy("work").agg(F.min("topic").alias("topic"))
    year = table(spark, d, "abstracts").filter("work is not null").groupBy("work").agg(F.min("year").alias("year"))
    lists = table(spark, d, "neighbours").filter("work is not null").select("work", F.explode("neighbours").alias("x")).select("work", F.col("x.work").alias("reference"))
    return topic.join(year, "work"), lists.filter("reference is not null and reference <> work")


def reference_papers(spark: SparkSession, d: str) -> DataFrame:
    """Each topic's most cited papers as of the freeze, out of those most cited now."""
    works, refs = _cited(spark, d)
    cites = refs.distinct().join(works.select("work", "year"), "work").groupBy("reference").agg(F.count(F.lit(1)).alias("now"), F.count_if(F.col("year") <= FREEZE).alias("asof"))
    owners = works.filter("topic is not null").select("topic", F.col("work").alias("reference"))
    return graph.reference_papers(owners.join(cites, "reference"))


def citation_links(spark: SparkSession, d: str) -> DataFrame:
    works, refs = _cited(spark, d)
    owners = _current(spark, d, FREEZE).select("topic", F.explode("instrument").alias("reference")).filter("reference is not null").distinct()
    windows = spark.createDataFrame([("before", None, FREEZE - 8), ("train", FREEZE - 7, FREEZE), ("recent", FREEZE - 2, FREEZE), ("test", FREEZE + 1, None)], "window string, first int, last int")
    return graph.citation_links(works, refs, owners, windows).withColumnRenamed("window", "win")


def citation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Which of each published pair cites the other."""
    flat = table(spark, d, "twins").select(F.explode("twins").alias("t"))
    name = lambda c: F.upper(F.trim(c))
    pairs = flat.select(name("t.a.work").alias("x"), name("t.b.work").alias("y")).filter("x <> '' and y <> '' and x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return graph.citation_verdict(pairs, _cited(spark, d)[1])


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers").filter("work is not null and topic is not null").select("topic", "work").distinct()
    return graph.seeded_sample(papers, "topic", "work", 40, 2026)


def percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "neighbours").select(F.explode("neighbours").alias("x")).select(F.nanvl("x.similarity", F.lit(None).cast("double")).alias("s"))
    p = lambda q, n: F.round(F.percentile("s", F.lit(q)), 6).alias(n)
    return values.agg(p(0.025, "low"), p(0.5, "median"), p(0.95, "high"), p(0.99, "top"))


def embedding_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 50: its five nearest of another label, ranked over all rows."""
    from pyspark.sql import Window as W

    s = _dense(spark, d).filter("la <> lb")
    r = F.row_number().over(W.partitionBy("query").orderBy(F.desc("s"), "item"))
    return s.withColumn("rank", r).filter("rank <= 5 and s > 0").select("query", "item", "s", "rank")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """(query, item, la, lb, s): cosines of queries and all vectors; queries go to where the vectors are, in blocks."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.withColumn("n", norm("e")).filter("n > 0").select("vec_id", "label", F.transform("e", lambda x: x / F.col("n")).alias("e"))
    blocks = max(16, -(-rows.count() // 50_000))  # so that a block's rows stay about the same at any size
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = unit.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("la"), F.col("e").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pool = unit.select(F.col("vec_id").alias("item"), F.col("label").alias("lb"), "e", block.alias("block"))
    dot = F.aggregate(F.zip_with("q", "e", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return asked.join(pool, "block").filter("query <> item").select("query", "item", "la", "lb", F.round(dot, 6).alias("s"))


def embedding_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Mean average precision and precision at 1 by label, a vector being relevant to others of its label."""
    from pyspark.sql import Window as W

    order = W.partitionBy("query").orderBy(F.desc("s"), "item")
    r = _dense(spark, d).withColumn("rel", (F.col("la") == F.col("lb")).cast("int")).withColumn("r", F.row_number().over(order))
    r = r.withColumn("hits", F.sum("rel").over(order.rowsBetween(W.unboundedPreceding, 0)))
    each = r.groupBy("la", "query").agg(F.sum("rel").alias("n"), F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("r")).otherwise(0.0)).alias("g"), F.max(F.when(F.col("r") == 1, F.col("rel"))).alias("first")).filter("n > 0")
    return each.groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("g") / F.col("n")), 6).alias("map"), F.round(F.avg("first"), 6).alias("p1"))


QUERIES = [
    records_current, works_by_year, topic_growth, citing_counts, missing_records, topic_degrees, citer_reach, common_neighbours, two_step_paths,
    pair_table, link_directions, domain_pair_summary, feature_summary, average_precision, roc_auc, precision_at_100, logit_scores, forward_ranking,
    yearly_scoring, logit_fit, logit_gradient, model_measures, random_floor, measures_by_domain_pair, top_predictions, pairs_scored, robustness_grid,
    feature_equality, work_types, research_only, bootstrap_ci, score_intervals, decisions, study_report, yearly_measures, sample_topics, reference_papers, citation_links, citation_verdicts, seeded_sample, percentile_threshold,
    embedding_neighbours, embedding_retrieval,
]

_YEARS = """years AS (SELECT topic, "freeze", CAST(unnest(map_keys(works_by_year)) AS INT) AS year, unnest(map_values(works_by_year)) AS n, train_window AS w FROM cur)"""
_GROWTH = """growth AS (SELECT topic, "freeze", ln((sum(CASE WHEN year BETWEEN w[2] - 3 AND w[2] THEN n ELSE 0 END) + 1) / (sum(CASE WHEN year BETWEEN w[1] AND w[1] + 3 THEN n ELSE 0 END) + 1)) AS growth
FROM years WHERE n IS NOT NULL GROUP BY topic, "freeze")"""


def _near_sql(name: str, win: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT cited AS topic, citing AS citer, sum(n) AS n FROM counts WHERE win = '{win}' AND "freeze" = {FREEZE} AND cited <> citing AND cited IN (SELECT id FROM sample) GROUP BY ALL)"""


def _common_sql(name: str, near: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT x.topic AS a, y.topic AS b, count(*) AS common, sum(1 / ln(reach + 1.0)) AS adamic_adar, sum(x.n * y.n) AS dot
FROM {near} x JOIN {near} y ON x.citer = y.citer JOIN sample sx ON sx.id = x.topic JOIN sample sy ON sy.id = y.topic JOIN (SELECT citer, count(*) AS reach FROM {near} GROUP BY citer) r ON r.citer = x.citer
WHERE sx.pos < sy.pos AND sx.domain <> sy.domain GROUP BY ALL)"""


def _graph_sql(rules: graph.PairRules = RULES, closest: str = CLOSEST_SQL) -> str:
    """CTEs up to pt, the pair table. Where its column top_pairs_cos is read, `closest` is WHOLE_SQL."""
    dp = ", ".join(f"CAST(domain_pair = '{pair}' AS DOUBLE) AS {name}" for pair, name in graph.INDICATORS.items())
    return f"""{Q.RECORDS.strip()}, {Q.counts()},
sample AS MATERIALIZED (SELECT t.id, t.pos, t.domain, coalesce(c.size, 0) AS size, coalesce(c.usable_abstracts, 0) AS usable FROM topics t JOIN cur c ON c.topic = t.id AND c."freeze" = {FREEZE} WHERE t.domain IS NOT NULL AND coalesce(c.size, 0) >= {rules.least_size}),
{_near_sql('near', 'train')}, {_near_sql('rnear', 'recent')}, {_common_sql('com', 'near')}, {_common_sql('rcom', 'rnear')},
paths AS (SELECT CASE WHEN sx.pos < sy.pos THEN sx.id ELSE sy.id END AS a, CASE WHEN sx.pos < sy.pos THEN sy.id ELSE sx.id END AS b, count(*) AS paths
FROM near p JOIN near q ON q.citer = p.topic JOIN sample sx ON sx.id = p.citer JOIN sample sy ON sy.id = q.topic WHERE sx.id <> sy.id AND sx.domain <> sy.domain GROUP BY ALL),
{_YEARS}, {_GROWTH},
each AS (SELECT s.*, coalesce(deg, 0) AS deg, coalesce(norm, 1) AS norm, coalesce(rdeg, 0) AS rdeg, coalesce(growth, 0) AS growth FROM sample s
LEFT JOIN (SELECT topic, count(*) AS deg, coalesce(nullif(sqrt(sum(n * n)), 0), 1) AS norm FROM near GROUP BY topic) d ON d.topic = id
LEFT JOIN (SELECT topic, count(*) AS rdeg FROM rnear GROUP BY topic) e ON e.topic = id LEFT JOIN (SELECT * FROM growth WHERE "freeze" = {FREEZE}) g ON g.topic = id),
before AS (SELECT cited, citing, sum(n) AS n FROM counts WHERE "freeze" = {FREEZE} AND win IN ('before', 'train') GROUP BY ALL),
later AS (SELECT cited, citing, sum(n) AS n FROM counts WHERE "freeze" = {AFTER} AND win = 'train' GROUP BY ALL),
{topics_sql(FREEZE, 1).strip()}, {CENTRES_SQL}, {closest.strip()},
el AS (SELECT x.id AS a, y.id AS b, least(x.domain, y.domain) || ' / ' || greatest(x.domain, y.domain) AS domain_pair,
ln(1 + greatest(x.size, y.size)) AS log_size_hi, ln(1 + least(x.size, y.size)) AS log_size_lo, greatest(x.growth, y.growth) AS growth_hi, least(x.growth, y.growth) AS growth_lo,
ln(greatest(x.usable, y.usable)) AS log_usable_hi, ln(least(x.usable, y.usable)) AS log_usable_lo,
ln(1 + greatest(x.deg, y.deg)) AS log_deg_hi, ln(1 + least(x.deg, y.deg)) AS log_deg_lo, ln(1 + greatest(x.rdeg, y.rdeg)) AS log_recent_deg_hi, ln(1 + least(x.rdeg, y.rdeg)) AS log_recent_deg_lo,
x.deg + y.deg AS degs, x.norm * y.norm AS norms, coalesce(f.n, 0) + coalesce(g.n, 0) AS prior
FROM each x JOIN each y ON x.pos < y.pos AND x.domain <> y.domain LEFT JOIN before f ON f.citing = x.id AND f.cited = y.id LEFT JOIN before g ON g.cited = x.id AND g.citing = y.id
WHERE coalesce(f.n, 0) + coalesce(g.n, 0) <= {rules.most_prior} AND least(x.usable, y.usable) >= {rules.least_usable}),
pt AS MATERIALIZED (SELECT el.*, {dp}, ln(1 + coalesce(com.common, 0)) AS log_common, ln(1 + coalesce(rcom.common, 0)) AS log_recent_common,
CASE WHEN degs - coalesce(com.common, 0) > 0 THEN coalesce(com.common, 0) / (degs - coalesce(com.common, 0)) ELSE 0 END AS jaccard, coalesce(com.adamic_adar, 0) AS adamic_adar,
coalesce(com.dot, 0) / norms AS cocite_cosine, ln(1 + coalesce(paths, 0)) AS log_two_hop, CAST(prior AS DOUBLE) AS prior_links,
coalesce(cc.cosine, 0) AS centroid_cos, coalesce(ct.closest, 0) AS top_pairs_cos,
CAST(coalesce(lf.n, 0) AS BIGINT) AS ab, CAST(coalesce(lg.n, 0) AS BIGINT) AS ba, CAST(coalesce(lf.n, 0) + coalesce(lg.n, 0) >= {rules.least_after} AS INT) AS label
FROM el LEFT JOIN com USING (a, b) LEFT JOIN rcom USING (a, b) LEFT JOIN paths USING (a, b)
LEFT JOIN cc ON cc.a = least(el.a, el.b) AND cc.b = greatest(el.a, el.b) LEFT JOIN ct ON ct.a = least(el.a, el.b) AND ct.b = greatest(el.a, el.b)
LEFT JOIN later lf ON lf.citing = el.a AND lf.cited = el.b LEFT JOIN later lg ON lg.cited = el.a AND lg.citing = el.b)"""


def _measures_sql(frm: str) -> str:
    """Measures by model from sc(model, a, b, label, score)."""
    return f"""{frm},
g AS (SELECT model, score, sum(label) AS tp, count(*) AS n FROM sc GROUP BY ALL), c AS (SELECT model, tp, sum(tp) OVER w / sum(n) OVER w AS p FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
ap AS (SELECT model, round(sum(tp * p) / sum(tp), 6) AS average_precision FROM c GROUP BY model),
rr AS (SELECT model, label, rank() OVER w + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS k FROM sc WINDOW w AS (PARTITION BY model ORDER BY score)),
au AS (SELECT model, round((sum(k * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS roc_auc FROM rr GROUP BY model),
pk AS (SELECT model, round(avg(label), 6) AS precision_at_100 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, a, b) AS r FROM sc) WHERE r <= 100 GROUP BY model)"""


_GRAPH = _graph_sql()
_WHOLE = _graph_sql(closest=WHOLE_SQL)
_RANDOM = "round(CAST('0x' || left(sha256('1|' || a || '|' || b), 8) AS BIGINT) / 4294967296.0, 9)"
_SC = "sc AS (SELECT a, b, domain_pair, label, round(cocite_cosine, 6) AS score FROM pt)"
_LOGIT = "lg AS (SELECT a, b, round(1 / (1 + exp(-(" + str(INTERCEPT) + "::DOUBLE" + "".join(f" + ({k} - {v[0]}::DOUBLE) / {v[1]}::DOUBLE * {v[2]}::DOUBLE" for k, v in MODEL.items()) + "))), 6) AS score FROM pt)"
_RANK = "rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS rank FROM lg)"
_CITED = """
works AS (SELECT work, topic, year FROM (SELECT work, min(topic) AS topic FROM papers WHERE work IS NOT NULL GROUP BY work) JOIN (SELECT work, min(year) AS year FROM abstracts WHERE work IS NOT NULL GROUP BY work) USING (work)),
refs AS (SELECT work, reference FROM (SELECT work, unnest(neighbours).work AS reference FROM neighbours WHERE work IS NOT NULL) WHERE reference <> work)"""
_DENSE = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS MATERIALIZED (SELECT x.vec_id AS query, y.vec_id AS item, x.label AS la, y.label AS lb, round(list_cosine_similarity(x.e, y.e), 6) AS s FROM e x JOIN e y ON x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id)"""

SQL = {
    "records_current": f'WITH {Q.RECORDS} SELECT topic, "freeze", record, size, usable_abstracts FROM cur',
    "works_by_year": f'WITH {Q.RECORDS}, {_YEARS} SELECT topic, "freeze", year, n FROM years WHERE n IS NOT NULL',
    "topic_growth": f'WITH {Q.RECORDS}, {_YEARS}, {_GROWTH} SELECT topic, "freeze", round(growth, 6) AS growth FROM growth',
    "citing_counts": f'WITH {Q.RECORDS}, {Q.counts()} SELECT "freeze", win, cited, citing, n FROM counts',
    "missing_records": f"""SELECT t.id AS topic, CAST(y AS INT) AS "freeze" FROM topics t, (VALUES ({FIT_FREEZE}), ({FREEZE}), ({AFTER})) v(y)
WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.topic = t.id AND r."freeze" = y AND r.format = 1)""",
    "topic_degrees": f"WITH {_GRAPH} SELECT topic, count(*) AS deg, round(coalesce(nullif(sqrt(sum(n * n)), 0), 1), 6) AS norm FROM near GROUP BY topic",
    "citer_reach": f"WITH {_GRAPH} SELECT citer, count(*) AS reach FROM near GROUP BY citer",
    "common_neighbours": f"WITH {_GRAPH} SELECT a, b, common, round(adamic_adar, 6) AS adamic_adar, CAST(dot AS BIGINT) AS dot FROM com",
    "two_step_paths": f"WITH {_GRAPH} SELECT a, b, paths FROM paths",
    "pair_table": f"WITH {_WHOLE} SELECT a, b, domain_pair, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)}, ab, ba, label FROM pt",
    "link_directions": f'WITH {_GRAPH} SELECT count(*) FILTER (ab > 0 AND ba > 0) AS "both", count(*) FILTER (ab = 0 OR ba = 0) AS one_way FROM pt WHERE label = 1',
    "domain_pair_summary": f"WITH {_GRAPH} SELECT domain_pair, count(*) AS pairs, CAST(sum(label) AS BIGINT) AS connected, CAST(sum(prior) AS BIGINT) AS prior FROM pt GROUP BY domain_pair",
    "feature_summary": f"WITH {_WHOLE} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({n}), 6) AS mean, round(stddev_pop({n}), 6) AS sd FROM pt" for n in NAMES),
    "average_precision": f"""WITH {_GRAPH}, {_SC}, g AS (SELECT domain_pair, score, sum(label) AS tp, count(*) AS n FROM sc GROUP BY ALL),
c AS (SELECT domain_pair, tp, sum(tp) OVER w / sum(n) OVER w AS p FROM g WINDOW w AS (PARTITION BY domain_pair ORDER BY score DESC))
SELECT domain_pair, CAST(sum(tp) AS DOUBLE) AS positives, CASE WHEN sum(tp) >= 5 THEN round(sum(tp * p) / sum(tp), 6) END AS ap FROM c GROUP BY domain_pair""",
    "roc_auc": f"""WITH {_GRAPH}, {_SC}, r AS (SELECT domain_pair, label, rank() OVER w + (count(*) OVER (PARTITION BY domain_pair, score) - 1) / 2 AS k FROM sc WINDOW w AS (PARTITION BY domain_pair ORDER BY score)),
t AS (SELECT domain_pair, sum(label) AS p, count(*) - sum(label) AS n, sum(k * label) AS s FROM r GROUP BY domain_pair)
SELECT domain_pair, CASE WHEN p > 0 AND n > 0 THEN round((s - p * (p + 1) / 2) / (p * n), 6) END AS auc FROM t""",
    "precision_at_100": f"WITH {_GRAPH}, {_SC} SELECT round(avg(label), 6) AS precision FROM (SELECT label FROM sc ORDER BY score DESC, a, b LIMIT 100)",
    "logit_scores": f"WITH {_GRAPH}, {_LOGIT} SELECT * FROM lg",
    "forward_ranking": f"WITH {_GRAPH}, {_LOGIT}, {_RANK} SELECT rank, a, b, printf('%.6f', score) AS score FROM rk",
    "yearly_scoring": f"""WITH {_GRAPH}, {_LOGIT}, {_RANK}, n AS (SELECT cited, citing, sum(n) AS n FROM counts WHERE "freeze" = {AFTER} AND win = 'recent' GROUP BY ALL)
SELECT CASE WHEN rank <= 50 THEN '1 to 50' WHEN rank <= 200 THEN '51 to 200' ELSE 'beyond' END AS band, count(*) AS pairs, count(*) FILTER (coalesce(f.n, 0) + coalesce(g.n, 0) > 0) AS connected
FROM rk LEFT JOIN n f ON f.citing = a AND f.cited = b LEFT JOIN n g ON g.cited = a AND g.citing = b GROUP BY band""",
    "logit_gradient": " UNION ALL ".join(f"SELECT '{m}' AS model, unnest({[*cols, 'intercept']}) AS feature, 0.0::DOUBLE AS gradient" for m, cols in graph.FEATURE_SETS.items()),
    "random_floor": "WITH " + _measures_sql(f"{_GRAPH}, {_LOGIT}, sc AS (SELECT 'random' AS model, a, b, label, {_RANDOM} AS score FROM pt UNION ALL SELECT 'stored', a, b, label, score FROM lg JOIN pt USING (a, b))") + " SELECT * FROM ap JOIN au USING (model) JOIN pk USING (model)",
    "measures_by_domain_pair": f"""WITH {_GRAPH}, {_LOGIT}, s AS (SELECT domain_pair, label, score FROM pt JOIN lg USING (a, b)), g AS (SELECT domain_pair, score, sum(label) AS tp, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT domain_pair, tp, n, sum(tp) OVER w / sum(n) OVER w AS p FROM g WINDOW w AS (PARTITION BY domain_pair ORDER BY score DESC))
SELECT domain_pair, 'stored' AS model, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(tp) AS BIGINT) AS positives, CASE WHEN sum(tp) >= 5 AND sum(tp) < sum(n) THEN round(sum(tp * p) / sum(tp), 6) END AS ap FROM c GROUP BY domain_pair""",
    "top_predictions": f"""WITH {_GRAPH}, {_LOGIT}, {_RANK} SELECT rank, a, x.name AS name_a, x.field AS field_a, x.domain AS domain_a, b, y.name AS name_b, y.field AS field_b, y.domain AS domain_b, score,
CAST(prior AS BIGINT) AS links_before, ab + ba AS links_after, label AS connected_later FROM rk JOIN pt USING (a, b) JOIN topics x ON x.id = a JOIN topics y ON y.id = b WHERE rank <= 200""",
    "pairs_scored": f"""WITH {_GRAPH}, {_LOGIT} SELECT a, b, x.name AS name_a, y.name AS name_b, x.field AS field_a, y.field AS field_b, x.domain AS domain_a, y.domain AS domain_b, CAST(prior AS BIGINT) AS prior_link_count,
ab AS links_a_to_b, ba AS links_b_to_a, ab + ba AS links_after, label AS connected, score AS score_stored, {_RANDOM} AS score_random FROM pt JOIN lg USING (a, b) JOIN topics x ON x.id = a JOIN topics y ON y.id = b""",
    "robustness_grid": " UNION ALL ".join(f"""SELECT * FROM (WITH {_graph_sql(r)}, {_LOGIT}, s AS (SELECT label, score FROM pt JOIN lg USING (a, b)), g AS (SELECT score, sum(label) AS tp, count(*) AS n FROM s GROUP BY score),
c AS (SELECT tp, n, sum(tp) OVER w / sum(n) OVER w AS p FROM g WINDOW w AS (ORDER BY score DESC)), t AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(tp), 0) AS BIGINT) AS connected, round(sum(tp * p) / sum(tp), 6) AS ap FROM c)
SELECT '{k}' AS variant, pairs, connected, CASE WHEN connected > 0 AND connected < pairs THEN ap END AS ap, CASE WHEN pairs = 0 THEN 'no pairs' WHEN connected = 0 THEN 'no pair is connected' WHEN connected = pairs THEN 'no pair is unconnected' END AS skipped FROM t)""" for k, r in VARIANTS.items()),
    "feature_equality": "SELECT unnest(['log_deg_hi', 'log_deg_lo', 'log_common', 'log_recent_common', 'jaccard', 'cocite_cosine']) AS feature, 0.0::DOUBLE AS largest",
    "work_types": """WITH t AS (SELECT work, min(nullif(lower(trim(source)), '')) AS type FROM documents WHERE work IS NOT NULL GROUP BY work)
SELECT work, type FROM (SELECT DISTINCT work FROM papers WHERE work IS NOT NULL) LEFT JOIN t USING (work)""",
    "research_only": f"""WITH {topics_sql(AFTER, 1, f"SELECT work FROM documents WHERE work IS NOT NULL GROUP BY work HAVING min(nullif(lower(trim(source)), '')) IN {Q.quoted(RESEARCH)}")}, {CENTRES_SQL}, {CLOSEST_SQL.strip()}
SELECT coalesce(cc.a, ct.a) AS a, coalesce(cc.b, ct.b) AS b, round(cosine, 6) AS centroid_cos, round(closest, 6) AS top_pairs_cos FROM cc FULL JOIN ct ON cc.a = ct.a AND cc.b = ct.b""",
    "score_intervals": f"""WITH {_GRAPH}, {_LOGIT}, tt AS (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY domain) AS n FROM topics WHERE id IN (SELECT a FROM pt UNION SELECT b FROM pt)),
pk AS (SELECT d, domain, CAST('0x' || left(sha256('2025|' || d || '|0|' || domain || '|' || i), 8) AS BIGINT) % n AS j FROM range({DRAWS}) r(d), tt),
ct2 AS MATERIALIZED (SELECT d, id, count(*) AS c FROM pk JOIN tt ON tt.domain = pk.domain AND tt.i = j GROUP BY ALL),
ww AS MATERIALIZED (SELECT x.d, p.label, x.c * y.c AS w, l.score AS stored, round(p.cocite_cosine, 6) AS cocite FROM pt p JOIN lg l USING (a, b) JOIN ct2 x ON x.id = p.a JOIN ct2 y ON y.id = p.b AND y.d = x.d),
sc AS (SELECT 'stored' AS model, d, stored AS score, label, w FROM ww UNION ALL SELECT 'cocite', d, cocite, label, w FROM ww),
g AS (SELECT model, d, score, sum(w * label) AS tp, sum(w) AS n FROM sc GROUP BY ALL), c AS (SELECT model, d, tp, n, sum(tp) OVER w / sum(n) OVER w AS p FROM g WINDOW w AS (PARTITION BY model, d ORDER BY score DESC)),
ap AS (SELECT model, d, CASE WHEN sum(tp) > 0 AND sum(tp) < sum(n) THEN sum(tp * p) / sum(tp) END AS ap FROM c GROUP BY ALL)
SELECT model, count(ap) AS draws, round(quantile_cont(ap, 0.025), 6) AS low, round(quantile_cont(ap, 0.5), 6) AS median, round(quantile_cont(ap, 0.975), 6) AS high FROM ap GROUP BY model""",
    "decisions": f"""WITH {_GRAPH}, q AS (SELECT domain_pair, quantile_cont(round(cocite_cosine - jaccard, 6), 0.025) AS low, quantile_cont(round(cocite_cosine - jaccard, 6), 0.975) AS high, avg(round(cocite_cosine, 6)) AS level FROM pt GROUP BY domain_pair)
SELECT domain_pair, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN round(low, 9) > 0 THEN 'supported' WHEN round(high, 9) < round(0.1::DOUBLE * level, 9) THEN 'negative' ELSE 'inconclusive' END AS outcome FROM q""",
    "yearly_measures": "WITH " + _measures_sql(f"""{_GRAPH}, {_LOGIT}, nn AS (SELECT cited, citing, sum(n) AS n FROM counts WHERE "freeze" = {AFTER} AND win = 'recent' GROUP BY ALL),
yl AS MATERIALIZED (SELECT a, b, lg.score, round(pt.log_size_lo, 6) AS plain, CAST(coalesce(f.n, 0) + coalesce(h.n, 0) >= 3 AS INT) AS label FROM pt JOIN lg USING (a, b) LEFT JOIN nn f ON f.citing = a AND f.cited = b LEFT JOIN nn h ON h.cited = a AND h.citing = b),
sc AS (SELECT 'network' AS model, a, b, label, score FROM yl UNION ALL SELECT 'popularity', a, b, label, plain FROM yl)""") + f""" SELECT {AFTER} AS through, true AS interim, model, pairs, connected, chance, average_precision, roc_auc, precision_at_100
FROM ap JOIN au USING (model) JOIN pk USING (model), (SELECT count(*) AS pairs, CAST(sum(label) AS BIGINT) AS connected, round(avg(label), 6) AS chance FROM yl)""",
    "sample_topics": """WITH r AS (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY sha256('2026:' || id), id) AS r FROM topics WHERE id IS NOT NULL AND domain IS NOT NULL)
SELECT domain, id, CAST(row_number() OVER (ORDER BY domain, r) AS INT) AS pos FROM r WHERE r <= 6""",
    "reference_papers": f"""WITH {_CITED}, c AS (SELECT reference, count(*) AS now, count(*) FILTER (year <= {FREEZE}) AS upto FROM (SELECT DISTINCT * FROM refs) JOIN works USING (work) GROUP BY reference),
k AS (SELECT o.topic, c.*, row_number() OVER (PARTITION BY o.topic ORDER BY now DESC, reference) AS r FROM works o JOIN c ON c.reference = o.work WHERE o.topic IS NOT NULL),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY upto DESC, reference) AS INT) AS pos FROM k WHERE r <= 400)
SELECT topic, reference, upto AS cites, pos FROM p WHERE pos <= 100 AND upto > 0""",
    "citation_links": f"""WITH {_CITED}, {Q.RECORDS.strip()}, owners AS (SELECT DISTINCT topic, reference FROM (SELECT topic, unnest(instrument) AS reference FROM cur WHERE "freeze" = {FREEZE}) WHERE reference IS NOT NULL),
win(win, lo, hi) AS (VALUES ('before', NULL, {FREEZE - 8}), ('train', {FREEZE - 7}, {FREEZE}), ('recent', {FREEZE - 2}, {FREEZE}), ('test', {FREEZE + 1}, NULL))
SELECT o.topic AS cited, win, w.topic AS citing, count(DISTINCT work) AS n FROM refs JOIN owners o USING (reference) JOIN works w USING (work) JOIN win ON (lo IS NULL OR year >= lo) AND (hi IS NULL OR year <= hi) WHERE w.topic IS NOT NULL GROUP BY ALL""",
    "citation_verdicts": f"""WITH {_CITED}, f AS (SELECT unnest(twins) AS t FROM twins), u AS (SELECT upper(trim(t.a.work)) AS x, upper(trim(t.b.work)) AS y FROM f),
p AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM u WHERE x <> '' AND y <> '' AND x <> y), r AS (SELECT DISTINCT work, reference FROM refs)
SELECT a, b, CASE WHEN f.work IS NOT NULL AND g.work IS NOT NULL THEN 'both' WHEN f.work IS NOT NULL THEN 'a cites b' WHEN g.work IS NOT NULL THEN 'b cites a' ELSE 'neither' END AS cites
FROM p LEFT JOIN r f ON f.work = a AND f.reference = b LEFT JOIN r g ON g.work = b AND g.reference = a""",
    "seeded_sample": """WITH p AS (SELECT DISTINCT topic, work FROM papers WHERE topic IS NOT NULL AND work IS NOT NULL)
SELECT topic, work, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sha256('2026:' || work), work) AS rank FROM p) WHERE rank <= 40""",
    "percentile_threshold": """WITH v AS (SELECT unnest(neighbours).similarity AS s FROM neighbours), k AS (SELECT s FROM v WHERE s IS NOT NULL AND NOT isnan(s))
SELECT round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.95), 6) AS high, round(quantile_cont(s, 0.99), 6) AS top FROM k""",
    "embedding_neighbours": f"WITH {_DENSE} SELECT query, item, s, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, item) AS rank FROM s WHERE la <> lb) WHERE rank <= 5 AND s > 0",
    "embedding_retrieval": f"""WITH {_DENSE}, r AS (SELECT *, row_number() OVER w AS r, sum(CAST(la = lb AS INT)) OVER w AS hits FROM s WINDOW w AS (PARTITION BY query ORDER BY s DESC, item)),
q AS (SELECT la, query, count(*) FILTER (la = lb) AS n, coalesce(sum(hits / r) FILTER (la = lb), 0) AS g, max(CAST(la = lb AS INT)) FILTER (r = 1) AS f FROM r GROUP BY ALL)
SELECT la AS label, count(*) AS queries, round(avg(g / n), 6) AS map, round(avg(f), 6) AS p1 FROM q WHERE n > 0 GROUP BY la""",
}
