"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = "topic string, topic_name string, subfield string, field string, domain string, family string, role string"
ABSTRACT = "work string, title string, year int, abstract string"
GOLD = "work string, id string, family string, field string, role string, method_named string, domain string"
RECORD = (
    "format int, topic string, freeze int, retrieved string, train_window array<int>, recent_window array<int>, size bigint, "
    "works_by_year map<string,bigint>, instrument array<string>, usable_abstracts int, cited_by_train map<string,bigint>, "
    "cited_by_recent map<string,bigint>, cited_by_before map<string,bigint>"
)
RESULT = "author string, model struct<provider:string,id:string>, prompt string, descriptions array<struct<work:string,problem:string,approach:string>>"
WORK = (
    "id string, type string, title string, publication_year int, primary_topic string, cited_by_count bigint, "
    "counts_by_year array<struct<year:int,cited_by_count:bigint>>, referenced_works array<string>, "
    "topics array<struct<id:string,subfield:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>"
)
CORRUPT = "_corrupt_record"


def _json(spark: SparkSession, path: str, schema: str, whole: bool) -> DataFrame:
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def lines(spark: SparkSession, path: str, schema: str = ABSTRACT) -> DataFrame:
    """One JSON object a line; a line that doesn't parse is kept in _corrupt_record."""
    return _json(spark, path, schema, False)


def whole_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return _json(spark, path, schema, True)


def keyed_object(spark: SparkSession, path: str, value: str = PAPER, key: str = "work") -> DataFrame:
    """A file holding one object, whose entries are rows: (key, the fields of the values)."""
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{struct_of(value)}>>").alias("m"))
    return read.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def struct_of(ddl: str) -> str:
    """The fields of a schema as those of a struct type."""
    return ", ".join(part.strip().replace(" ", ":", 1) for part in ddl.split(", "))


def commented_csv(spark: SparkSession, path: str, schema: str = GOLD) -> DataFrame:
    """CSV with a header and lines of # comments."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").option("quote", '"').option("escape", '"').csv(path)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One file per result, unit and issue told by the path <unit>/<issue>.json."""
    read = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return read.withColumn("unit", F.element_at(parts, -2)).withColumn("issue", F.regexp_replace(F.element_at(parts, -1), r"\.json$", ""))


def filtered(works: DataFrame, **wanted: str) -> DataFrame:
    """Rows by a small filter language, one condition per column, all of which must hold.

    'x' equals, 'a|b|c' one of, '<5' less, '>5' more, '2010-2017' a closed interval, 'true' and 'false'
    present or not.
    """
    for column, said in wanted.items():
        works = works.filter(_condition(works, column, said))
    return works


def scan(works: DataFrame, where: dict[str, str] | None = None, select: list[str] | None = None, group_by: str | None = None, sort: str | None = None, sample: int | None = None, seed: int = 0, key: str = "id", limit: int | None = None) -> DataFrame:
    """A request to an index as one plan: filter, then either counts of a column's values or rows.

    group_by gives (key, count), null keys left out. sample keeps that many rows in an order given by a
    hash of the seed and the key, the same on every run. sort is a column, or `column:desc`, ties by the
    key; limit keeps the first rows of that order.
    """
    rows = filtered(works, **(where or {}))
    if group_by:
        return rows.filter(F.col(group_by).isNotNull()).groupBy(F.col(group_by).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    if sample is not None:
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
        rows = rows.filter(F.col(key).isNotNull()).orderBy(order, key).limit(sample)
    if sort:
        column, _, way = sort.partition(":")
        rows = rows.orderBy(F.desc_nulls_last(column) if way == "desc" else F.asc_nulls_last(column), key)
    if limit is not None:
        rows = rows.limit(limit)
    return rows.select(*select) if select else rows


def references(works: DataFrame, column: str = "referenced_works") -> DataFrame:
    """(work, reference, pos): the reference lists of works (work, ...), each with its place in the list."""
    return works.filter(F.col("work").isNotNull()).select("work", F.posexplode(column).alias("pos", "reference")).filter("reference is not null").select("work", "reference", "pos")


def resolve(links: DataFrame, index: DataFrame, link: str = "id") -> DataFrame:
    """links with the work and text of the index (key, work, text) that their link leads to, if the text is usable."""
    from driftnet.functions import text as T

    known = index.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("work", "text")).alias("x")).select("key", "x.work", "x.text")
    return links.withColumn("key", T.link_key(F.col(link))).join(known, "key").filter(T.usable(F.col("text")))


def sampled_works(works: DataFrame, n: int, seed: int, types: tuple[str, ...], least_words: int = 40) -> DataFrame:
    """(topic, work, text): of n works of each topic (work, topic, type, text), drawn by a seed, the research works with
    a usable text. The draw comes first, so a topic with few of them gives few."""
    from driftnet.functions import text as T
    from driftnet.operators import graph

    drawn = graph.seeded_sample(works, "topic", "work", n, seed)
    return drawn.filter(F.col("type").isin(*types) & T.usable(F.col("text"), least_words)).select("topic", "work", "text")


def stored_model(spark: SparkSession, path: str, name: str) -> tuple[dict[str, float], dict[str, float], dict[str, float], float]:
    """(means, scales, coefficients, intercept) of one model of a model file, as metrics.logit_score takes them."""
    one = "struct<features:array<string>,coef:array<double>,mean:array<double>,scale:array<double>,intercept:double>"
    m = whole_file(spark, path, f"{name} {one}").first()[name]
    return tuple(dict(zip(m["features"], m[k])) for k in ("mean", "scale", "coef")) + (m["intercept"],)


def _condition(works: DataFrame, column: str, said: str) -> Column:
    c, kind = F.col(column), dict(works.dtypes)[column]
    if said in ("true", "false") and kind != "boolean":
        return c.isNotNull() if said == "true" else c.isNull()
    if said[:1] in "<>" and said:
        bound = F.lit(said[1:]).cast(kind)
        return c < bound if said[0] == "<" else c > bound
    low, dash, high = said.partition("-")
    if dash and kind in ("int", "bigint") and low.isdigit() and high.isdigit():
        return c.between(int(low), int(high))
    return c.isin(*[F.lit(v).cast(kind) for v in said.split("|")])


def citations_up_to(works: DataFrame, year: int) -> Column:
    """Citations by the end of a year: those of now less those of each later year listed, at least 0."""
    later = F.aggregate(F.filter("counts_by_year", lambda c: c.year > year), F.lit(0).cast("bigint"), lambda a, c: a + c.cited_by_count)
    return F.greatest(F.lit(0), F.col("cited_by_count") - F.coalesce(later, F.lit(0)))


def subfields(works: DataFrame) -> Column:
    return F.transform("topics", lambda t: t.subfield.display_name)


def strict_citing(works: DataFrame, subfield: str) -> Column:
    """Articles and reviews that aren't themselves in the other topic's subfield."""
    return F.col("type").isin("article", "review") & ~F.coalesce(F.array_contains(subfields(works), F.col(subfield)), F.lit(False))
