"""Queries of sources, sinks, merges and small reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet.functions import text as T
from driftnet.operators import graph, intake, metrics, twins
from driftnet.operators import vectors as V
from driftnet.plans import graph_queries as G
from driftnet.plans import sql as Q
from driftnet.plans import twin_queries as TQ
from driftnet.session import stage, stage_path, table
from driftnet.sources import feed, readers, writers


def works_grouped(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "abstracts").withColumnRenamed("work", "id")
    return readers.scan(works, {"year": "2008-2019", "abstract": "true"}, group_by="year").select(F.col("key").alias("year"), F.col("count").alias("works"))


def works_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred works drawn by a seed, newest first."""
    works = table(spark, d, "papers").filter("work is not null").groupBy(F.col("work").alias("id")).agg(F.min("topic").alias("topic"), F.min("domain").alias("domain"))
    return readers.scan(works, {"domain": "Life Sciences|Social Sciences"}, ["id", "topic"], sort="topic:desc", sample=200, seed=2026)


def works_filtered(spark: SparkSession, d: str) -> DataFrame:
    return readers.filtered(table(spark, d, "abstracts"), year=">2009", title="true", abstract="true").select("work", "year")


def feed_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics through a paged feed, seven a page, until the short page."""
    path = f"{d}/topics.parquet"

    def fetch(page: int) -> list[tuple]:
        import pyarrow.parquet as pq

        rows = pq.read_table(path, columns=["id", "name", "domain"]).sort_by("id").slice(7 * page, 7)
        return list(zip(*(c.to_pylist() for c in rows.columns))) if rows.num_rows else []

    feed.register(spark, "topics_by_page", "id string, name string, domain string", 7, fetch)
    return spark.read.format("topics_by_page").load()


def jsonl_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts written as JSON lines and read with their schema."""
    path = stage_path(spark, "jsonl")
    table(spark, d, "abstracts").select("work", "title", "year", "abstract").write.json(path)
    return readers.lines(spark, path).filter(F.col(readers.CORRUPT).isNull()).select("work", "title", "year", "abstract")


def keyed_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers written as one object a topic, of works to their metadata, and read as rows."""
    rows = table(spark, d, "papers").filter("work is not null and topic is not null").select("work", "topic", "field", "domain", "role").distinct()
    entry = F.struct("topic", "field", "domain", "role")
    one = rows.groupBy("topic").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("work", entry.alias("m"))))).alias("value"))  # a topic's papers
    path = stage_path(spark, "keyed")
    one.repartition(200, "topic").select("topic", "value").write.partitionBy("topic").option("maxRecordsPerFile", 1).text(path)
    return readers.keyed_object(spark, f"{path}/*").select("work", "topic", "field", "domain", "role")


def record_files(spark: SparkSession, d: str) -> DataFrame:
    """Records written one JSON document a file, as record stores hold them, and read as whole files."""
    path = stage_path(spark, "records")
    rows = graph.current_records(table(spark, d, "records"))
    text = F.to_json(F.struct("format", "topic", "freeze", "retrieved", "size", "works_by_year", "instrument", "usable_abstracts", "cited_by_train"))
    rows.select("record", text.alias("value")).repartition(64, "record").sortWithinPartitions("record").write.option("maxRecordsPerFile", 1).partitionBy("record").text(path)
    total = F.aggregate(F.map_values("cited_by_train"), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return readers.whole_file(spark, f"{path}/*", readers.RECORD).select("topic", "freeze", "size", F.size("works_by_year").alias("years"), F.size("instrument").alias("papers"), total.alias("citing"))


def commented_gold(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark as CSV with comments, read again."""
    path = stage_path(spark, "csv")
    rows = table(spark, d, "gold").select("work", "id", "family", "field", "role", "method_named", "domain")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))
    lines = rows.select(F.lit(1).alias("o"), F.concat_ws(",", *[quoted(c) for c in rows.columns]).alias("value"))
    head = spark.createDataFrame([(0, "# a benchmark"), (0, ",".join(rows.columns))], "o int, value string").coalesce(1)
    whole = head.unionByName(lines).coalesce(1).sortWithinPartitions("o", F.when(F.col("value").startswith("#"), 0).otherwise(1))  # a benchmark is a few hundred rows
    whole.select("value").write.text(path)
    got = readers.commented_csv(spark, path)
    return got.select("work", *[F.nullif(c, F.lit("")).alias(c) for c in ("id", "family", "field", "role", "method_named", "domain")])


def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Results written as <unit>/<issue>.json and read back, unit and issue told by the path."""
    rows = table(spark, d, "descriptions").filter("unit is not null and issue is not null and unit rlike '^[\\\\w-]+$' and issue rlike '^[\\\\w-]+$'")
    said = F.array_sort(F.collect_list(F.struct("work", "problem", "approach")))  # a result's own descriptions
    one = rows.groupBy("unit", "issue").agg(F.to_json(F.struct(F.min("author").alias("author"), said.alias("descriptions"))).alias("value"))
    path = stage_path(spark, "results")
    one.withColumnsRenamed({"unit": "u", "issue": "i"}).repartition(64, "u", "i").sortWithinPartitions("u", "i").write.partitionBy("u", "i").text(path)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("p"))
    x = F.from_json("value", readers.RESULT)
    return files.select(F.regexp_extract("p", "/u=([^/]+)/", 1).alias("unit"), F.regexp_extract("p", "/i=([^/]+)/", 1).alias("issue"), x.author.alias("author"), F.size(x.descriptions).alias("n"))


def oversized_contents(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with submitted files: none, none left after a cut, or too large."""
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return rows.select("doc_id", intake.content_fault(F.col("content"), most=20_000).alias("fault"))


def benchmark_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark links looked up in an index by their key; only papers with a usable text stay."""
    gold = table(spark, d, "gold")
    index = gold.select(T.link_key(F.col("id")).alias("key"), "work", "text")
    return readers.resolve(gold.filter("id is not null").select("id", "family"), index).select("id", "family", "key", "work")


def _works(spark: SparkSession, d: str) -> DataFrame:
    """(work, topic, subfield, year, type, text), one row a paper."""
    papers = table(spark, d, "papers").filter("work is not null").groupBy("work").agg(F.min("topic").alias("topic"), F.min("subfield").alias("subfield"))
    said = table(spark, d, "abstracts").filter("work is not null").groupBy("work").agg(F.min("year").alias("year"), F.max(F.concat_ws(". ", "title", "abstract")).alias("text"))
    return papers.join(said, "work", "left").join(G._types(spark, d), "work", "left")


def usable_sample(spark: SparkSession, d: str) -> DataFrame:
    works = _works(spark, d).filter("topic is not null")
    return readers.sampled_works(works, 40, 2026, G.RESEARCH).select("topic", "work", F.length("text").alias("chars"))


def unit_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles and abstracts of each unit's works."""
    units = table(spark, d, "descriptions").filter("unit is not null and work is not null").groupBy("unit").agg(F.array_sort(F.collect_set("work")).alias("works"))  # a unit is some twenty works
    texts = table(spark, d, "abstracts").filter("work is not null and abstract is not null").groupBy("work").agg(F.min("title").alias("title"), F.min("abstract").alias("abstract"))
    return units.select("unit", F.explode("works").alias("work")).join(texts, "work").select("unit", "work", "title", "abstract")


def _references(spark: SparkSession, d: str) -> DataFrame:
    """(work, reference, pos) of the papers' lists of other papers, which stand for what they cite."""
    return readers.references(table(spark, d, "neighbours").select("work", F.transform("neighbours", lambda x: x.work).alias("referenced_works")))


def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).groupBy("work").agg(F.count(F.lit(1)).alias("listed"), F.countDistinct("reference").alias("different"), F.max("pos").alias("last"))


def letters(texts: list[str]) -> list[list[float]]:
    """A model in place of a pretrained one: shares of some letters."""
    return [[t.lower().count(c) / max(1, len(t)) for c in "etaoinsr"] for t in texts]


def encoded_titles(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of titles by an encoder that is an argument, batch by batch."""
    rows = table(spark, d, "abstracts").filter("work is not null and title is not null").groupBy("work").agg(F.min("title").alias("text"))
    return V.encode(rows, "work", "text", letters).select(F.col("work"), F.round(F.element_at("vector", 1), 6).alias("e"), F.round(F.element_at("vector", 8), 6).alias("r"))


def exported_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pair table as CSV, read again."""
    path = stage_path(spark, "export")
    rows = stage(G._pairs(spark, d).select("a", "b", "domain_pair", F.round("cocite_cosine", 6).alias("cocite_cosine"), "ab", "ba", "label"), "pairs")
    writers.table_and_csv(rows, path, "pairs", ["a", "b"])
    return spark.read.schema(rows.schema).option("header", True).csv(f"{path}/pairs.csv")


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs scored with a model that went through its file."""
    import os

    folder = stage_path(spark, "model").removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    means, scales, coefs = ({k: v[i] for k, v in G.MODEL.items()} for i in range(3))
    writers.model_file({"network": (means, scales, coefs, G.INTERCEPT)}, f"{folder}/model.json")
    score = metrics.logit_score(*readers.stored_model(spark, f"file://{folder}/model.json", "network"))
    return G._pairs(spark, d).select("a", "b", F.round(score, 6).alias("score"))


def records_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Current records as JSON lines in order of topic, read again."""
    path = stage_path(spark, "records-jsonl")
    rows = graph.current_records(table(spark, d, "records")).filter("freeze = 2025")
    rows.drop("record").orderBy("topic").write.json(path)
    got = readers.lines(spark, path, readers.RECORD)
    return got.select("topic", "size", F.size("instrument").alias("papers"), F.array_join("recent_window", "-").alias("recent"))


def twins_json(spark: SparkSession, d: str) -> DataFrame:
    """Published pairs as JSON documents and back, nested as they are."""
    path = stage_path(spark, "twins")
    rows = table(spark, d, "twins")
    rows.write.json(path)
    got = spark.read.schema(rows.schema).json(path)
    t = got.select("run", F.explode("twins").alias("t"))
    return t.select("run", F.col("t.a.work").alias("a"), F.col("t.b.work").alias("b"), F.round("t.score", 6).alias("score"), F.size("t.why").alias("words"), "t.trust")


def records_upserted(spark: SparkSession, d: str) -> DataFrame:
    """The record store after all records came in two loads: the latest of each topic and freeze."""
    rows = table(spark, d, "records").filter("topic is not null and freeze is not null").dropDuplicates(["record", "retrieved"])
    early = F.col("retrieved").isNull() | (F.col("retrieved") < "2025-06")
    order = lambda df: graph.latest(df, ["topic", "freeze"], [F.desc_nulls_last("retrieved"), F.col("record")])
    got = writers.upsert(order(rows.filter(early)), order(rows.filter(~early)), ["topic", "freeze"], "retrieved")
    return got.select("topic", "freeze", "retrieved")


def file_digests(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a file of the topics' ids."""
    path = stage_path(spark, "digest")
    ids = table(spark, d, "topics").filter("id is not null").select("id")
    ids.coalesce(1).sortWithinPartitions("id").write.text(path)  # thousands of ids
    return writers.digest(spark, path).select("sha256")


def lower_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "abstracts").filter("title is not null").select("work", F.lower("title").alias("title"))


def citations_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Citations up to a year from a total and counts of the years: those of later years are taken off."""
    years = graph.current_records(table(spark, d, "records")).select("topic", "freeze", F.transform(F.map_entries("works_by_year"), lambda e: F.struct(e.key.cast("int").alias("year"), F.coalesce(e.value, F.lit(0)).alias("cited_by_count"))).alias("counts_by_year"))
    total = F.aggregate("counts_by_year", F.lit(0).cast("bigint"), lambda a, x: a + x.cited_by_count)
    rows = years.withColumn("cited_by_count", total)
    return rows.select("topic", "freeze", readers.citations_up_to(rows, 2014).alias("upto"))


def rounded_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Similarities for printing, half to even."""
    s = table(spark, d, "neighbours").select(F.explode("neighbours").alias("x")).select(F.col("x.similarity").alias("s")).filter("s is not null and not isnan(s)")
    return s.groupBy(F.bround(F.col("s").cast("decimal(12,8)"), 2).cast("double").alias("similarity")).agg(F.count(F.lit(1)).alias("n"))


def scaled_positions(spark: SparkSession, d: str) -> DataFrame:
    """Two coordinates of every vector on a map of 0 to 1000."""
    from driftnet.operators import layout

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return layout.scaled(rows)


def subfield_paths(spark: SparkSession, d: str) -> DataFrame:
    """The subfields of a work's topics, out of nested optional values."""
    topics = F.collect_set(F.struct(F.col("topic").alias("id"), F.struct(F.col("subfield").alias("display_name")).alias("subfield")))
    works = table(spark, d, "papers").filter("work is not null and topic is not null").groupBy("work").agg(F.sort_array(topics).alias("topics"))
    return works.select("work", F.array_join(readers.subfields(works), "|", "?").alias("subfields"))


def _instrument(spark: SparkSession, d: str) -> DataFrame:
    """(topic, reference, subfield): reference papers of the topics' records."""
    field = table(spark, d, "topics").filter("id is not null").select(F.col("id").alias("topic"), "subfield")
    refs = G._current(spark, d, G.FREEZE).select("topic", F.explode("instrument").alias("reference")).filter("reference is not null").distinct()
    return refs.join(field, "topic")


def strict_links(spark: SparkSession, d: str) -> DataFrame:
    """Citing works of connected pairs that can't be misfiled."""
    pairs = stage(G._pairs(spark, d).filter("label = 1").select("a", "b"), "pairs")
    works = _works(spark, d)
    return graph.strict_links(works, _references(spark, d), _instrument(spark, d), works.select("work", "subfield"), pairs, G.RESEARCH)


def strict_works(spark: SparkSession, d: str) -> DataFrame:
    """Works that cite a topic's reference papers, with whether each counts under the strict rule."""
    works = _works(spark, d).withColumns({"topics": F.array(F.struct(F.struct(F.col("subfield").alias("display_name")).alias("subfield"))), "type": F.when(F.col("type") == "abstract", "article").otherwise(F.col("type"))})
    cites = _references(spark, d).join(_instrument(spark, d).withColumnsRenamed({"topic": "cited", "subfield": "other"}), "reference").select("work", "cited", "other").distinct()
    rows = cites.join(works, "work")
    return rows.groupBy("cited").agg(F.count(F.lit(1)).alias("citing"), F.count_if(readers.strict_citing(rows, "other")).alias("strict"))


def domains_merged(spark: SparkSession, d: str) -> DataFrame:
    """Every topic's domain from papers and from the list of topics, which holds where both know."""
    seen = table(spark, d, "papers").filter("topic is not null").groupBy(F.col("topic").alias("id")).agg(F.min("domain").alias("domain"))
    return graph.merged(seen, table(spark, d, "topics").filter("id is not null").select("id", "domain"), "id", "domain")


def first_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Each reference paper once, for the first topic that lists it."""
    rows = table(spark, d, "records").filter("topic is not null").select("topic", F.explode("instrument").alias("work")).filter("work is not null")
    return graph.first_of(rows.distinct(), "work", ["topic"]).select("work", "topic")


def records_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as of 2017, those of topics that have a record of 2025 replaced."""
    rows = graph.current_records(table(spark, d, "records")).select("topic", "freeze", "size")
    return graph.replaced(rows.filter("freeze = 2017"), rows.filter("freeze = 2025"), ["topic"])


def visible_papers(spark: SparkSession, d: str) -> DataFrame:
    """What an explorer shows with one domain hidden and described papers only."""
    papers = table(spark, d, "papers").filter("work is not null").groupBy("work").agg(F.min("domain").alias("domain"), F.min("field").alias("field"))
    described = table(spark, d, "descriptions").filter("work is not null and problem is not null")
    return twins.visible(papers, described, hidden=["Health Sciences"]).groupBy("domain").agg(F.count(F.lit(1)).alias("papers"))


def pairs_shown(spark: SparkSession, d: str) -> DataFrame:
    """The first six pairs of each run, each pair once whatever its direction."""
    flat = table(spark, d, "twins").filter("run is not null").select("run", F.explode("twins").alias("t")).select("run", F.upper(F.trim("t.a.work")).alias("x"), F.upper(F.trim("t.b.work")).alias("y"), F.round("t.score", 6).alias("score"))
    return twins.shown_once(flat.filter("x <> '' and y <> '' and x <> y"), "run", 6)


def generic_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers more like all others than 95% of papers are."""
    _, vectors = TQ._vectors(spark, d)
    rows = stage(twins.mean_likeness(twins.paper_vectors(vectors)).select(F.col("doc").alias("work"), F.round("likeness", 6).alias("likeness")), "likeness")
    cut = rows.agg(F.percentile("likeness", F.lit(0.95)).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).filter("likeness > cut").select("work", "likeness")  # cut is one row


def chance_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the likeness of descriptions of different papers, 20,000 pairs drawn by hashes."""
    rows, vectors = TQ._vectors(spark, d)
    dots = V.dots(twins.chance_pairs(rows, twins.TwinRules.chance_pairs), vectors.select("doc", "term", "w"), "x", "y")
    p = lambda q, n: F.round(F.percentile("dot", F.lit(q)), 6).alias(n)
    return dots.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("dot"), 6).alias("mean"), p(0.5, "median"), p(0.95, "threshold"))


def closest_descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows, vectors = TQ._vectors(spark, d)
    return twins.closest_descriptions(twins.agreements(rows, vectors)).withColumn("agreement", F.round("agreement", 6))


def papers_loaded(spark: SparkSession, d: str) -> DataFrame:
    got = twins.loaded(table(spark, d, "papers"), table(spark, d, "gold"), table(spark, d, "abstracts"))
    return got.select("work", "topic", "field", "domain", "family", "role", F.length("abstract").alias("chars"))


def progress_rows(spark: SparkSession, d: str) -> DataFrame:
    """All that a page of progress shows: units by status, contributors and models with their counts, totals."""
    rows = table(spark, d, "descriptions")
    states = intake.unit_states(intake.submissions(rows))
    return intake.progress_rows(rows, states)


def closed_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Ratings by rule: pairs' scores by bridge, weighted by how far they are trusted."""
    flat = table(spark, d, "twins").select(F.explode("twins").alias("t"))
    rows = flat.select(F.upper(F.trim("t.a.work")).alias("a"), F.upper(F.trim("t.b.work")).alias("b"), F.col("t.score").alias("rating"), F.when(F.col("t.trust") == "two models agree", "expert").otherwise("other").alias("expertise"))
    rated = intake.bridge_ratings(rows.filter("a <> '' and b <> '' and a <> b and rating is not null"), {"expert": 3.0, "other": 1.0})
    return rated.select("bridge", "ratings", F.round("mean", 6).alias("mean"), F.round("weighted", 6).alias("weighted"))


def model_weights(spark: SparkSession, d: str) -> DataFrame:
    """Each model's weight by how often its label is the one most models gave, shrunk to one half."""
    flat = table(spark, d, "descriptions").filter("work is not null and model.id is not null").select("work", F.col("model.id").alias("model"), F.explode("descriptions").alias("x")).select("work", "model", "x.facet", F.lower(F.trim("x.label")).alias("label")).filter("facet is not null and label <> ''").distinct()
    votes = flat.groupBy("work", "facet", "label").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("work", "facet").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("gold"))
    judged = flat.join(top, ["work", "facet"]).select("model", (F.col("label") == F.col("gold")).cast("int").alias("hit"))
    return intake.shrunk_weights(judged).withColumn("weight", F.round("weight", 6))


def plain_model(prompt: str) -> str:
    """A model in place of one of language: it repeats the title, and the second time it is asked says more."""
    import json
    import re

    title = re.search(r"Title: (.*)", prompt)
    said = title.group(1) if title else ""
    more = " and what follows from it" if "could not be used" in prompt else ""
    return "<think>{}</think>" + json.dumps({"problem": said + more, "approach": said + more})


def described_titles(spark: SparkSession, d: str) -> DataFrame:
    """Papers described by the stand-in model, those of units of which most could be."""
    from driftnet.operators import describe

    title = table(spark, d, "abstracts").filter("work is not null and title is not null and title <> ''").groupBy("work").agg(F.min("title").alias("title"))
    units = table(spark, d, "descriptions").filter("unit is not null").select("unit", "work").distinct()
    papers = units.join(title, "work").select("unit", "work", "title", F.lit(None).cast("string").alias("abstract"), F.array().cast("array<string>").alias("avoid"))
    got = describe.whole_units(describe.describe(papers, plain_model, "Describe the paper."))
    return got.select("unit", "work", "tries", F.sha2("problem", 256).alias("problem"))


def boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Gradient-boosted trees on all features, fitted on the earlier pairs: measures on the later ones."""
    from driftnet.operators import study

    fitting = G._staged_pairs(spark, d, G.FIT_FREEZE, G.FIT_AFTER)
    scored = study.boosted(fitting, G._pairs(spark, d))
    return study.measures(stage(scored.select("a", "b", "label", "score_trees"), "scored"), (100,))


def staged_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers through a table in shared storage."""
    return stage(table(spark, d, "papers").select("work", "topic", "family"), "papers")


def report_json(spark: SparkSession, d: str) -> DataFrame:
    """A report as a file and back; a number that doesn't exist is null."""
    import os

    papers = table(spark, d, "papers").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("work").alias("works")).first()
    folder = stage_path(spark, "report").removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    writers.report({"papers": {"rows": papers["rows"], "works": papers["works"]}, "missing": float("nan")}, f"{folder}/report.json")
    got = readers.whole_file(spark, f"file://{folder}/report.json", "papers struct<rows:bigint,works:bigint>, missing double")
    return got.select("papers.rows", "papers.works", "missing")


def svd_gram(spark: SparkSession, d: str) -> DataFrame:
    """Inner products of the first five coordinates of papers by a truncated SVD: 0 between different ones."""
    from driftnet.operators import layout

    _, vectors = TQ._vectors(spark, d)
    at = layout.truncated_svd(twins.paper_vectors(vectors), 5)
    pairs = [(i, j) for i in range(5) for j in range(i)]
    sums = at.agg(*[F.abs(F.round(F.sum(F.col("coordinates")[i] * F.col("coordinates")[j]), 6)).alias(f"p{i}{j}") for i, j in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}{j}").alias("dot")) for i, j in pairs])).alias("x")).select("x.i", "x.j", "x.dot")


def rankings_checked(spark: SparkSession, d: str) -> DataFrame:
    """Records' reference papers as rankings of all that any record of the topic lists."""
    rows = table(spark, d, "records").filter("topic is not null and freeze is not null")
    items = rows.select("topic", "freeze", F.explode("instrument").alias("w")).groupBy("topic", "freeze").agg(F.collect_set("w").alias("items"))  # a topic's reference papers
    told = rows.join(items, ["topic", "freeze"], "left").select(intake.ranking_fault(F.col("instrument"), F.col("items")).alias("fault"))
    return told.groupBy("fault").agg(F.count(F.lit(1)).alias("rankings"))


def rehearsal_faults(spark: SparkSession, d: str) -> DataFrame:
    """What the checks say of sound and of junk descriptions."""
    papers = table(spark, d, "abstracts").filter("work is not null and abstract is not null").select("work", "abstract")
    rows = intake.rehearsal(papers).withColumns({"author": F.lit("me"), "model": F.struct(F.lit("p").alias("provider"), F.lit("m").alias("id"))})
    return rows.select("kind", intake.description_fault().alias("fault")).groupBy("kind", "fault").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = [
    staged_papers, report_json, svd_gram, rankings_checked, rehearsal_faults, described_titles, boosted_trees, works_grouped, works_sampled, works_filtered, feed_topics, jsonl_abstracts, keyed_papers, record_files, commented_gold, result_files, oversized_contents,
    benchmark_resolved, usable_sample, unit_texts, reference_lists, encoded_titles, exported_pairs, model_scores, records_jsonl, twins_json, records_upserted, file_digests,
    lower_titles, citations_as_of, rounded_similarities, scaled_positions, subfield_paths, strict_links, strict_works, domains_merged, first_sampled, records_replaced,
    visible_papers, pairs_shown, generic_papers, chance_agreement, closest_descriptions, papers_loaded, progress_rows, closed_vocabulary, model_weights,
]

_KEY = r"""CASE WHEN id SIMILAR TO '\d{4}\.\d{4,5}(v\d+)?' THEN 'doi:10.48550/arxiv.' || regexp_extract(id, '^(\d{4}\.\d{4,5})', 1)
WHEN regexp_full_match(id, '[a-z-]+(\.[A-Za-z]{2})?/\d{7}(v\d+)?') THEN 'doi:10.48550/arxiv.' || lower(regexp_extract(id, '^(.*?/\d{7})', 1))
WHEN id LIKE 'PMC%' THEN 'pmcid:' || id WHEN regexp_matches(id, '^10\.\d{4,9}/\S+$') THEN 'doi:' || lower(id) END"""
_TYPES = "ty AS (SELECT work, min(nullif(lower(trim(source)), '')) AS type FROM documents WHERE work IS NOT NULL GROUP BY work)"
_WORKS = f"""{_TYPES}, pp AS (SELECT work, min(topic) AS topic, min(subfield) AS subfield FROM papers WHERE work IS NOT NULL GROUP BY work),
ab0 AS (SELECT work, min(year) AS year, max(concat_ws('. ', title, abstract)) AS text FROM abstracts WHERE work IS NOT NULL GROUP BY work),
wk AS MATERIALIZED (SELECT pp.*, year, text, type FROM pp LEFT JOIN ab0 USING (work) LEFT JOIN ty USING (work))"""
_REFS = "rf AS MATERIALIZED (SELECT work, unnest(neighbours).work AS reference FROM neighbours WHERE work IS NOT NULL)"
_INST = f"""ins AS (SELECT DISTINCT c.topic, reference, t.subfield FROM (SELECT topic, unnest(instrument) AS reference FROM cur WHERE "freeze" = {G.FREEZE}) c JOIN topics t ON t.id = c.topic WHERE reference IS NOT NULL)"""

SQL = {
    "staged_papers": "SELECT work, topic, family FROM papers",
    "report_json": "SELECT count(*) AS rows, count(DISTINCT work) AS works, CAST(NULL AS DOUBLE) AS missing FROM papers",
    "svd_gram": "SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, 0.0::DOUBLE AS dot FROM range(5) a(i), range(5) b(j) WHERE j < i",
    "rankings_checked": """WITH r AS (SELECT record, topic, "freeze" AS f, instrument AS k FROM records WHERE topic IS NOT NULL AND "freeze" IS NOT NULL), i AS (SELECT topic, f, list(DISTINCT w) AS items FROM (SELECT topic, f, unnest(k) AS w FROM r) WHERE w IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN k IS NULL OR len(k) = 0 THEN 'nothing is ranked' WHEN len(list_distinct(k)) <> len(k) THEN 'an item is ranked twice' WHEN len(list_distinct(k)) <> len(items) THEN 'an item isn''t ranked' END AS fault, count(*) AS rankings FROM r LEFT JOIN i USING (topic, f) GROUP BY fault""",
    "rehearsal_faults": f"""WITH w AS (SELECT work, string_split({Q.squeeze('abstract')}, ' ') AS w FROM abstracts WHERE work IS NOT NULL AND abstract IS NOT NULL), s AS (SELECT work, array_to_string(w[1:8], ' ') AS p, array_to_string(w[9:16], ' ') AS q FROM w)
SELECT 'sound' AS kind, CASE WHEN NOT regexp_matches(work, '^W[0-9]+$') THEN 'work is no work ID' WHEN ({Q.word_count('p')}) < 4 OR ({Q.word_count('q')}) < 4 THEN 'a part is too short'
WHEN regexp_matches(lower(p || ' ' || q), '(^|[^a-z])(n/a|todo|tbd|lorem ipsum|placeholder)([^a-z]|$)') THEN 'a placeholder' END AS fault, count(*) AS rows FROM s GROUP BY fault
UNION ALL SELECT 'junk', CASE WHEN NOT regexp_matches(work, '^W[0-9]+$') THEN 'work is no work ID' ELSE 'a part is too short' END, count(*) FROM s GROUP BY 2""",
    "described_titles": f"""WITH t AS (SELECT work, min(title) AS t FROM abstracts WHERE work IS NOT NULL AND title IS NOT NULL AND title <> '' GROUP BY work), p AS (SELECT DISTINCT unit, work, t FROM descriptions JOIN t USING (work) WHERE unit IS NOT NULL),
a AS (SELECT unit, work, {Q.squeeze('t')} AS one, {Q.squeeze("t || ' and what follows from it'")} AS two, {Q.word_count('t')} AS n FROM p), b AS (SELECT *, CASE WHEN n >= 4 THEN one WHEN two <> '' THEN two END AS said FROM a)
SELECT unit, work, CASE WHEN n >= 4 THEN 1 ELSE 2 END::INT AS tries, sha256(said) AS problem FROM b""",
    "works_grouped": "SELECT year, count(*) AS works FROM abstracts WHERE year BETWEEN 2008 AND 2019 AND abstract IS NOT NULL GROUP BY year",
    "works_sampled": """SELECT id, topic FROM (SELECT work AS id, min(topic) AS topic, min(domain) AS domain FROM papers WHERE work IS NOT NULL GROUP BY work)
WHERE domain IN ('Life Sciences', 'Social Sciences') ORDER BY sha256('2026:' || id), id LIMIT 200""",
    "works_filtered": "SELECT work, year FROM abstracts WHERE year > 2009 AND title IS NOT NULL AND abstract IS NOT NULL",
    "feed_topics": "SELECT id, name, domain FROM topics",
    "jsonl_abstracts": "SELECT work, title, year, abstract FROM abstracts",
    "keyed_papers": "SELECT DISTINCT work, topic, field, domain, role FROM papers WHERE work IS NOT NULL AND topic IS NOT NULL",
    "record_files": f"""WITH {Q.RECORDS} SELECT topic, "freeze", size, CAST(len(map_keys(works_by_year)) AS INT) AS years, CAST(len(instrument) AS INT) AS papers, CAST(coalesce(list_sum(map_values(cited_by_train)), 0) AS BIGINT) AS citing FROM cur""",
    "commented_gold": "SELECT work, nullif(id, '') AS id, nullif(family, '') AS family, nullif(field, '') AS field, nullif(role, '') AS role, nullif(method_named, '') AS method_named, nullif(domain, '') AS domain FROM gold",
    "result_files": r"SELECT unit, issue, min(author) AS author, CAST(count(*) AS INT) AS n FROM descriptions WHERE regexp_full_match(unit, '[\w-]+') AND regexp_full_match(issue, '[\w-]+') GROUP BY unit, issue",
    "oversized_contents": "SELECT doc_id, CASE WHEN text IS NULL THEN 'no content' WHEN text = '' THEN 'nothing in it' WHEN octet_length(encode(text)) > 20000 THEN 'larger than 20000 bytes' END AS fault FROM documents",
    "benchmark_resolved": f"""WITH k AS (SELECT id, family, work, text, {_KEY} AS key FROM gold), i AS (SELECT key, min((work, text)) AS x FROM k WHERE key IS NOT NULL GROUP BY key)
SELECT k.id, k.family, key, x[1] AS work FROM k JOIN i USING (key) WHERE k.id IS NOT NULL AND {Q.usable('x[2]')}""",
    "usable_sample": f"""WITH {_WORKS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sha256('2026:' || work), work) AS r FROM wk WHERE topic IS NOT NULL)
SELECT topic, work, CAST(length(text) AS INT) AS chars FROM r WHERE r <= 40 AND type IN {Q.quoted(G.RESEARCH)} AND {Q.usable('text')}""",
    "unit_texts": """WITH t AS (SELECT work, min(title) AS title, min(abstract) AS abstract FROM abstracts WHERE work IS NOT NULL AND abstract IS NOT NULL GROUP BY work)
SELECT DISTINCT unit, work, title, abstract FROM descriptions JOIN t USING (work) WHERE unit IS NOT NULL""",
    "reference_lists": """WITH r AS (SELECT work, neighbours[i].work AS reference, i - 1 AS pos FROM (SELECT work, neighbours, unnest(range(1, len(neighbours) + 1)) AS i FROM neighbours WHERE work IS NOT NULL))
SELECT work, count(*) AS listed, count(DISTINCT reference) AS "different", CAST(max(pos) AS INT) AS last FROM r WHERE reference IS NOT NULL GROUP BY work""",
    "encoded_titles": """WITH t AS (SELECT work, min(title) AS t FROM abstracts WHERE work IS NOT NULL AND title IS NOT NULL GROUP BY work)
SELECT work, round((length(t) - length(replace(lower(t), 'e', ''))) / greatest(1, length(t)), 6) AS e, round((length(t) - length(replace(lower(t), 'r', ''))) / greatest(1, length(t)), 6) AS r FROM t""",
    "exported_pairs": f"WITH {G._GRAPH} SELECT a, b, domain_pair, round(cocite_cosine, 6) AS cocite_cosine, ab, ba, label FROM pt",
    "model_scores": f"WITH {G._GRAPH}, {G._LOGIT} SELECT a, b, score FROM lg",
    "records_jsonl": f"""WITH {Q.RECORDS} SELECT topic, size, CAST(len(instrument) AS INT) AS papers, array_to_string(recent_window, '-') AS recent FROM cur WHERE "freeze" = 2025""",
    "twins_json": "WITH t AS (SELECT run, unnest(twins) AS t FROM twins) SELECT run, t.a.work AS a, t.b.work AS b, round(t.score, 6) AS score, CAST(len(t.why) AS INT) AS words, t.trust AS trust FROM t",
    "records_upserted": """SELECT topic, "freeze", max(retrieved) AS retrieved FROM records WHERE topic IS NOT NULL AND "freeze" IS NOT NULL GROUP BY ALL""",
    "file_digests": "SELECT sha256(string_agg(id || chr(10), '' ORDER BY id)) AS sha256 FROM topics WHERE id IS NOT NULL",
    "lower_titles": "SELECT work, lower(title) AS title FROM abstracts WHERE title IS NOT NULL",
    "citations_as_of": f"""WITH {Q.RECORDS} SELECT topic, "freeze", CAST(coalesce(list_sum(list_transform(list_filter(map_entries(works_by_year), lambda e: CAST(e.key AS INT) <= 2014), lambda e: coalesce(e.value, 0))), 0) AS BIGINT) AS upto FROM cur WHERE works_by_year IS NOT NULL
UNION ALL SELECT topic, "freeze", CAST(0 AS BIGINT) FROM cur WHERE works_by_year IS NULL""",
    "rounded_similarities": """WITH v AS (SELECT unnest(neighbours).similarity AS s FROM neighbours) SELECT CAST(round_even(CAST(s AS DECIMAL(12, 8)), 2) AS DOUBLE) AS similarity, count(*) AS n FROM v WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY 1""",
    "scaled_positions": """WITH p AS (SELECT vec_id AS doc, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)
SELECT doc, CAST(round((x - lx) / greatest(hx - lx, 1e-9) * 1000) AS INT) AS x, CAST(round((y - ly) / greatest(hy - ly, 1e-9) * 1000) AS INT) AS y FROM p, e""",
    "subfield_paths": """WITH p AS (SELECT DISTINCT work, topic, subfield FROM papers WHERE work IS NOT NULL AND topic IS NOT NULL) SELECT work, string_agg(coalesce(subfield, '?'), '|' ORDER BY topic, subfield NULLS FIRST) AS subfields FROM p GROUP BY work""",
    "strict_links": f"""WITH {G._GRAPH}, {_WORKS}, {_REFS}, {_INST},
cs AS (SELECT DISTINCT rf.work, ins.topic AS cited, ins.subfield AS other FROM rf JOIN ins USING (reference)),
ok2 AS (SELECT cited, wk.topic AS citing, count(DISTINCT work) AS n FROM cs JOIN wk USING (work) WHERE type IN {Q.quoted(G.RESEARCH)} AND coalesce(wk.subfield, '') <> other GROUP BY ALL)
SELECT a, b, coalesce(f.n, 0) + coalesce(g.n, 0) AS n FROM pt LEFT JOIN ok2 f ON f.citing = a AND f.cited = b LEFT JOIN ok2 g ON g.cited = a AND g.citing = b WHERE label = 1""",
    "strict_works": f"""WITH {Q.RECORDS}, {_WORKS}, {_REFS}, {_INST}, cs AS (SELECT DISTINCT rf.work, ins.topic AS cited, ins.subfield AS other FROM rf JOIN ins USING (reference))
SELECT cited, count(*) AS citing, count(*) FILTER (type IN ('abstract', 'article', 'review') AND coalesce(wk.subfield, '') <> other) AS strict FROM cs JOIN wk USING (work) GROUP BY cited""",
    "domains_merged": """WITH p AS (SELECT topic AS id, min(domain) AS domain FROM papers WHERE topic IS NOT NULL GROUP BY topic), t AS (SELECT id, domain FROM topics WHERE id IS NOT NULL)
SELECT coalesce(t.id, p.id) AS id, coalesce(t.domain, p.domain) AS domain FROM p FULL JOIN t ON t.id = p.id""",
    "first_sampled": "SELECT work, min(topic) AS topic FROM (SELECT topic, unnest(instrument) AS work FROM records WHERE topic IS NOT NULL) WHERE work IS NOT NULL GROUP BY work",
    "records_replaced": f"""WITH {Q.RECORDS} SELECT topic, "freeze", size FROM cur WHERE "freeze" = 2025 OR ("freeze" = 2017 AND topic NOT IN (SELECT topic FROM cur WHERE "freeze" = 2025))""",
    "visible_papers": """WITH p AS (SELECT work, min(domain) AS domain FROM papers WHERE work IS NOT NULL GROUP BY work)
SELECT domain, count(*) AS papers FROM p WHERE coalesce(domain, '') <> 'Health Sciences' AND work IN (SELECT work FROM descriptions WHERE problem IS NOT NULL AND work IS NOT NULL) GROUP BY domain""",
    "pairs_shown": """WITH t AS (SELECT run, unnest(twins) AS t FROM twins WHERE run IS NOT NULL), f AS (SELECT run, upper(trim(t.a.work)) AS x, upper(trim(t.b.work)) AS y, round(t.score, 6) AS score FROM t),
g AS (SELECT run, least(x, y) AS a, greatest(x, y) AS b, max(score) AS score FROM f WHERE x <> '' AND y <> '' AND x <> y GROUP BY ALL)
SELECT run, a, b, score, CAST(r AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC NULLS LAST, a, b) AS r FROM g) WHERE r <= 6""",
    "generic_papers": f"""WITH {TQ._DESCRIBED}, {TQ._PV}, t AS (SELECT term, sum(w) AS t FROM pv GROUP BY term), n AS (SELECT count(DISTINCT work) AS n FROM pv),
l AS (SELECT work, round(round((sum(w * t) - sum(w * w)) / greatest(any_value(n) - 1, 1), 9), 6) AS likeness FROM pv JOIN t USING (term), n GROUP BY work)
SELECT work, likeness FROM l WHERE likeness > (SELECT quantile_cont(likeness, 0.95) FROM l)""",
    "chance_agreement": f"""WITH {TQ._DESCRIBED}, nb AS MATERIALIZED (SELECT desc_id, work, row_number() OVER (ORDER BY CAST('0x' || left(sha256('2025|' || desc_id), 8) AS BIGINT), desc_id) AS rank FROM rws),
dr AS (SELECT p AS pair, CAST('0x' || left(sha256('2025|i|' || p), 8) AS BIGINT) % (SELECT count(*) FROM nb) + 1 AS i, CAST('0x' || left(sha256('2025|j|' || p), 8) AS BIGINT) % (SELECT count(*) FROM nb) + 1 AS j FROM range(20000) r(p)),
xy AS MATERIALIZED (SELECT pair, x.desc_id AS x, y.desc_id AS y FROM dr JOIN nb x ON x.rank = i JOIN nb y ON y.rank = j WHERE x.work <> y.work),
dt AS (SELECT pair, sum(a.w * b.w) AS dot FROM xy JOIN v a ON a.doc = x JOIN v b ON b.doc = y AND b.term = a.term GROUP BY pair), al AS (SELECT pair, coalesce(dot, 0) AS dot FROM xy LEFT JOIN dt USING (pair))
SELECT count(*) AS pairs, round(avg(dot), 6) AS mean, round(quantile_cont(dot, 0.5), 6) AS median, round(quantile_cont(dot, 0.95), 6) AS threshold FROM al""",
    "closest_descriptions": f"""WITH {TQ._DESCRIBED}, {TQ._AGREE}, b AS (SELECT work, x AS desc_id, agreement FROM ag UNION ALL SELECT work, y, agreement FROM ag), m AS (SELECT work, desc_id, round(avg(agreement), 9) AS agreement FROM b GROUP BY ALL)
SELECT work, desc_id, round(agreement, 6) AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY agreement DESC, desc_id) AS r FROM m) WHERE r = 1""",
    "papers_loaded": """WITH p AS (SELECT work, min(nullif(topic, '')) AS topic, min(nullif(field, '')) AS field, min(nullif(domain, '')) AS domain, min(nullif(family, '')) AS family, min(nullif(role, '')) AS role FROM papers WHERE work IS NOT NULL GROUP BY work),
g AS (SELECT work, min(nullif(field, '')) AS field, min(nullif(domain, '')) AS domain, min(nullif(family, '')) AS family, min(nullif(role, '')) AS role FROM gold WHERE work IS NOT NULL GROUP BY work),
a AS (SELECT work, CAST(max(length(abstract)) AS INT) AS chars FROM abstracts WHERE work IS NOT NULL AND abstract IS NOT NULL GROUP BY work),
m AS (SELECT coalesce(p.work, g.work) AS work, topic, coalesce(p.field, g.field) AS field, coalesce(p.domain, g.domain) AS domain, coalesce(p.family, g.family) AS family, coalesce(p.role, g.role) AS role FROM p FULL JOIN g ON g.work = p.work)
SELECT m.*, chars FROM m LEFT JOIN a USING (work)""",
    "closed_vocabulary": """WITH t AS (SELECT unnest(twins) AS t FROM twins), r AS (SELECT upper(trim(t.a.work)) AS a, upper(trim(t.b.work)) AS b, t.score AS s, CASE WHEN t.trust = 'two models agree' THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM t)
SELECT 'b-' || least(a, b) || '-' || greatest(a, b) AS bridge, count(*) AS ratings, round(avg(s), 6) AS mean, round(sum(s * w) / sum(w), 6) AS weighted FROM r WHERE a <> '' AND b <> '' AND a <> b AND s IS NOT NULL GROUP BY 1""",
    "model_weights": """WITH f AS (SELECT work, model.id AS model, unnest(descriptions) AS x FROM descriptions WHERE work IS NOT NULL AND model.id IS NOT NULL), l AS (SELECT DISTINCT work, model, x.facet AS facet, lower(trim(x.label)) AS label FROM f WHERE x.facet IS NOT NULL AND trim(x.label) <> ''),
v AS (SELECT work, facet, label, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT work, facet, arg_min(label, (-n, label)) AS gold FROM v GROUP BY ALL)
SELECT model, count(*) AS judged, CAST(sum(CAST(label = gold AS INT)) AS BIGINT) AS hits, round(ln((sum(CAST(label = gold AS INT)) + 1) / (count(*) - sum(CAST(label = gold AS INT)) + 1)), 6) AS weight FROM l JOIN g USING (work, facet) GROUP BY model""",
}


def _progress_sql() -> str:
    from driftnet.plans import intake_queries as I

    return f"""WITH {I._SUBS}, {I._states()}
SELECT 'units' AS kind, status AS name, count(*) AS units, CAST(NULL AS BIGINT) AS descriptions FROM st GROUP BY status
UNION ALL SELECT 'contributor', author, count(DISTINCT (unit, issue)), count(*) FROM descriptions WHERE author IS NOT NULL GROUP BY author
UNION ALL SELECT 'model', model.id || ' (' || model.provider || ')', count(DISTINCT (unit, issue)), count(*) FROM descriptions WHERE model.id IS NOT NULL AND model.provider IS NOT NULL GROUP BY 2
UNION ALL SELECT 'total', 'papers described', count(DISTINCT work), count(*) FROM descriptions"""


SQL["progress_rows"] = _progress_sql()
