"""Queries of the text engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet.functions import text as T
from driftnet.operators import content, intake, metrics, twins
from driftnet.operators import vectors as V
from driftnet.plans import sql as Q
from driftnet.session import stage, table


def _document_terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").filter("text is not null").withColumn("domain", F.nullif(F.lower(F.trim("source")), F.lit("")))
    return V.doc_terms(docs, "doc_id", T.terms(F.col("text")), "domain"), docs.agg(F.count(F.lit(1)).alias("n"))


def distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    tf, n = _document_terms(spark, d)
    return V.distinctive(tf, n).withColumnRenamed("doc", "doc_id")


def field_words(spark: SparkSession, d: str) -> DataFrame:
    tf, _ = _document_terms(spark, d)
    found = V.field_words(tf, "domain", never=T.DOCUMENT_WORDS)
    return found.select("term", "docs", F.round("concentration", 6).alias("concentration"), F.round("zipf", 6).alias("zipf"))


def distinctive_field_words(spark: SparkSession, d: str) -> DataFrame:
    tf, n = _document_terms(spark, d)
    return V.distinctive(tf, n, 3, V.field_words(tf, "domain", never=T.DOCUMENT_WORDS)).withColumnRenamed("doc", "doc_id")


def usable_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(F.coalesce(T.words(F.col("text")), F.array().cast("array<string>"))).alias("words"), T.usable(F.col("text")).alias("usable"))


def token_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", *[F.size(f(F.col("text"))).alias(n) for n, f in (("words", T.words), ("tokens", T.tokens), ("letter_tokens", T.letter_tokens), ("terms", T.terms))], T.word_count(F.col("text")).alias("spaced"))


def cleaned_abstracts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "abstracts").filter("abstract is not null")
    text = T.squeeze(T.clean(F.concat_ws(". ", "title", "abstract")))
    return rows.select("work", "year", F.left("title", F.lit(140)).alias("title"), text.alias("text"))


def _topic_vectors(spark: SparkSession, d: str) -> DataFrame:
    return stage(content.topic_vectors(content.topic_texts(table(spark, d, "abstracts"), table(spark, d, "papers"))), "topic-vectors")


def usable_counts(spark: SparkSession, d: str) -> DataFrame:
    return content.usable_counts(content.topic_texts(table(spark, d, "abstracts"), table(spark, d, "papers"), least=1))


def topic_top_terms(spark: SparkSession, d: str) -> DataFrame:
    mean = V.mean_vectors(_topic_vectors(spark, d), "topic").withColumn("w", F.round("w", 6))
    r = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("w"), "term"))
    return mean.withColumn("rank", r).filter("rank <= 10")


def topic_centroid_cosine(spark: SparkSession, d: str) -> DataFrame:
    return content.centroid_cosines(_topic_vectors(spark, d)).withColumn("cosine", F.round("cosine", 6))


def topic_closest_texts(spark: SparkSession, d: str) -> DataFrame:
    return content.closest_texts(_topic_vectors(spark, d)).withColumn("closest", F.round("closest", 6))


SEARCH = "fragile neural storage and the edge of a digital lake"


def search_papers(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "abstracts").filter("abstract is not null and abstract <> '' and work is not null").select("work", F.concat_ws(" ", "title", "abstract").alias("text"))
    one = said.groupBy("work").agg(F.min(F.struct(-F.length("text"), "text")).alias("x")).select("work", F.col("x.text").alias("text"))
    tf = V.doc_terms(one, "work", T.terms(F.col("text"), least=2))
    n = one.agg(F.count(F.lit(1)).alias("n"))
    vectors = V.tfidf(tf, n)
    asked = spark.createDataFrame([(SEARCH,)], "q string").select(F.explode(T.terms(F.col("q"), least=2)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = asked.join(V.document_frequency(tf), "term").crossJoin(F.broadcast(n)).select("term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # n is one row
    length = weighted.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    query = weighted.crossJoin(F.broadcast(length)).select("term", (F.col("w") / F.col("len")).alias("w"))  # length is one row
    return V.search(vectors, query, 30).withColumnRenamed("doc", "work")


def field_distance(spark: SparkSession, d: str) -> DataFrame:
    return twins.field_distances(twins.field_vectors(table(spark, d, "papers"), table(spark, d, "abstracts")))


def near_duplicate_descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "descriptions").filter("unit is not null and issue is not null").select(F.concat_ws("/", "unit", "issue").alias("result"), "desc_id", F.concat_ws(" ", "problem", "approach").alias("text"))
    return intake.near_duplicates(rows, "result", "desc_id", "text").filter("repeats is not null")


def avoided_words(spark: SparkSession, d: str) -> DataFrame:
    """Which words of its paper's title a description uses."""
    title = table(spark, d, "abstracts").filter("title is not null and work is not null").groupBy("work").agg(F.min("title").alias("title"))
    rows = table(spark, d, "descriptions").select("desc_id", "work", F.concat_ws(" ", "problem", "approach").alias("text")).join(title, "work")
    used = T.avoided(F.col("text"), F.array_sort(F.array_distinct(T.terms(F.col("title")))))
    return rows.select("desc_id", F.array_join(used, " ").alias("used"), F.size(used).alias("n")).filter("n > 0")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "descriptions").filter("model is not null")
    return rows.select("desc_id", F.sha2(T.fingerprint(F.col("problem"), F.col("approach")), 256).alias("print"), T.model_name(F.col("model")).alias("model"), T.safe_name(T.model_name(F.col("model"))).alias("file"))


def sample_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "topics").filter("id is not null").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))  # one id per topic, of which there are thousands
    return ids.select(F.left(F.sha2("ids", 256), F.lit(16)).alias("sample"))


def bridge_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "topics").filter("id is not null and domain is not null")
    a, b = t.select(F.col("id").alias("a"), F.col("field").alias("f"), F.col("domain").alias("da")), t.select(F.col("id").alias("b"), F.col("field").alias("f"), F.col("domain").alias("db"))
    return a.join(b, "f").filter("a < b").select(T.bridge_id(F.col("b"), F.col("a")).alias("bridge"))


def link_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold").select("work", "id", T.link_key(F.col("id")).alias("key"), T.short_id(F.col("id")).alias("short"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "abstracts").filter("work is not null")
    said = T.prompt(F.lit("Describe the paper."), F.col("title"), F.col("abstract"), T.terms(F.col("title")))
    return rows.select("work", F.sha2(said, 256).alias("prompt"))


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions written as a chatty model's answers and read back."""
    rows = table(spark, d, "descriptions")
    said = F.concat(F.lit("<think>{\"problem\": 3}</think>Here it is: "), F.to_json(F.struct("problem", "approach")), F.lit(" Done."))
    got = rows.select("desc_id", T.answer(said).alias("x"))
    return got.select("desc_id", "x.problem", "x.approach", F.col("x.fault").isNull().alias("ok"))


def issue_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Results rendered as issues' bodies and parsed again: one row a description, with the parser's fault."""
    rows = table(spark, d, "descriptions").filter("unit is not null and issue is not null")
    body = F.concat(F.lit("Here is a result.\n\n"), T.fenced(F.to_json(F.struct("unit", F.array(F.struct("work", "problem", "approach")).alias("descriptions")))), F.lit("\n"))
    parsed = intake.parse_submissions(rows.select(F.col("desc_id").alias("issue"), "author", body.alias("body")))
    return parsed.select(F.col("issue").alias("desc_id"), "unit", F.col("descriptions")[0].work.alias("work"), "fault")


def inverted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts taken apart into words and positions, and put together again."""
    rows = table(spark, d, "abstracts").filter("abstract is not null and work is not null").select("work", F.split(T.squeeze(F.col("abstract")), " ").alias("w"), T.squeeze(F.col("abstract")).alias("text")).distinct()
    exploded = rows.select("work", "text", F.posexplode("w").alias("p", "word")).groupBy("work", "text", "word").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    maps = exploded.groupBy("work", "text").agg(F.map_from_entries(F.collect_list(F.struct("word", "ps"))).alias("inverted"))
    return maps.select("work", F.sha2(T.abstract_text(F.col("inverted")), 256).alias("text"))


def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "neighbours").select(F.explode("neighbours").alias("x")).select(F.nanvl("x.similarity", F.lit(None).cast("double")).alias("s"))
    return metrics.histogram(values, "s")


QUERIES = [
    distinctive_words, field_words, distinctive_field_words, usable_texts, token_classes, cleaned_abstracts, usable_counts, topic_top_terms, topic_centroid_cosine,
    topic_closest_texts, search_papers, field_distance, near_duplicate_descriptions, avoided_words, fingerprints, sample_fingerprint, bridge_ids,
    link_keys, prompts, model_answers, issue_bodies, inverted_texts, similarity_histogram,
]

_TF = f"""
docs AS (SELECT doc_id AS doc, nullif(lower(trim(source)), '') AS domain, text FROM documents WHERE text IS NOT NULL),
flat AS (SELECT doc, domain, unnest({Q.terms('text')}) AS term FROM docs),
tf AS MATERIALIZED (SELECT doc, domain, term, count(*) AS tf FROM flat GROUP BY ALL)"""

_FIELD = f"""
own AS (SELECT * FROM tf WHERE domain IS NOT NULL),
size AS (SELECT domain, count(DISTINCT doc) AS size FROM own GROUP BY domain),
rates AS (SELECT term, domain, count(*) AS df, count(*) / any_value(size) AS rate FROM own JOIN size USING (domain) GROUP BY term, domain),
spread AS (SELECT term, sum(df) AS docs, sum(rate) FILTER (r <= 2) / sum(rate) AS concentration FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY rate DESC, domain) AS r FROM rates) GROUP BY term),
zipf AS (SELECT term, log10(sum(tf) / (SELECT sum(tf) FROM own) * 1e9) AS zipf FROM own GROUP BY term),
fw AS (SELECT * FROM spread JOIN zipf USING (term) WHERE CASE WHEN docs >= 10 THEN round(concentration, 9) >= 0.8 ELSE zipf < 4.0 END AND term NOT IN {Q.quoted(T.DOCUMENT_WORDS)})"""


def _distinctive(k: int, extra: str = "") -> str:
    return f"""
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT doc AS doc_id, term, round(tf * ln((SELECT count(*) FROM docs) / df), 4) AS score FROM tf JOIN dfs USING (term) {extra}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS INT) AS rank FROM scored)
SELECT doc_id, term, score, rank FROM ranked WHERE rank <= {k}"""


def topics_sql(through: int | None = None, least: int = 5, kinds: str = "") -> str:
    """CTEs up to v(doc, topic, term, w), the vectors of topics' usable texts."""
    when = (f" AND year <= {through}" if through else "") + (f" AND work IN ({kinds})" if kinds else "")
    return f"""
{Q.ONE_ABSTRACT.strip().replace("abstract <> ''", f"abstract <> ''{when}")},
ok AS (SELECT * FROM one WHERE {Q.usable('text')}),
topic AS (SELECT work, min(topic) AS topic FROM papers WHERE work IS NOT NULL AND topic IS NOT NULL GROUP BY work),
rows0 AS (SELECT ok.work, topic, {Q.clean('text')} AS text FROM ok JOIN topic USING (work)),
rows1 AS MATERIALIZED (SELECT * FROM rows0 WHERE topic IN (SELECT topic FROM rows0 GROUP BY topic HAVING count(*) >= {least})),
flat AS (SELECT work AS doc, topic, unnest({Q.tokens('text')}) AS term FROM rows1),
tf AS (SELECT doc, topic, term, count(*) AS tf FROM flat WHERE regexp_full_match(term, '{Q.LETTERS}') AND term NOT IN {Q.quoted([*T.STOP_WORDS, *T.BOILERPLATE])} GROUP BY ALL),
{Q.tfidf('v', 'tf', '(SELECT count(*) FROM rows1)', 2, 0.5, 'topic')}"""


_TOPICS = topics_sql()
CENTRES_SQL = f"""{Q.mean('m', 'v', 'topic').strip()},
cc AS MATERIALIZED (SELECT x.topic AS a, y.topic AS b, sum(x.w * y.w) AS cosine FROM m x JOIN m y ON x.term = y.term AND x.topic < y.topic GROUP BY ALL)"""
CLOSEST_SQL = """
t_place AS (SELECT * FROM (SELECT doc, topic, row_number() OVER (PARTITION BY topic ORDER BY doc) AS r FROM (SELECT DISTINCT doc, topic FROM v)) WHERE r <= 20),
t_few AS (SELECT v.* FROM v JOIN t_place USING (doc)),
t_sims AS (SELECT x.doc AS x, y.doc AS y, x.topic AS a, y.topic AS b, round(sum(x.w * y.w), 6) AS s FROM t_few x JOIN t_few y ON x.term = y.term AND x.topic < y.topic GROUP BY ALL),
t_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, least(x, y), greatest(x, y)) AS r FROM t_sims) WHERE r <= 5),
t_sizes AS (SELECT topic, count(*) AS n FROM t_place GROUP BY topic),
ct AS MATERIALIZED (SELECT a, b, sum(s) / least(5, any_value(na.n * nb.n)) AS closest FROM t_top JOIN t_sizes na ON na.topic = a JOIN t_sizes nb ON nb.topic = b GROUP BY a, b)"""
#: The same of all of the topics' texts.
WHOLE_SQL = CLOSEST_SQL.replace(" WHERE r <= 20", "")

_SEARCHED = f"""
{Q.ONE_ABSTRACT.strip()},
flat AS (SELECT work AS doc, unnest(list_filter({Q.words('text')}, lambda w: length(w) >= 2 AND w NOT IN {Q.STOPS})) AS term FROM one),
tf AS (SELECT doc, term, count(*) AS tf FROM flat GROUP BY ALL), {Q.tfidf('v', 'tf', '(SELECT count(*) FROM one)')},
q0 AS (SELECT unnest(list_filter({Q.words("'" + SEARCH + "'")}, lambda w: length(w) >= 2 AND w NOT IN {Q.STOPS})) AS term),
q1 AS (SELECT term, count(*) AS tf FROM q0 GROUP BY term),
q2 AS (SELECT q1.term, (1 + ln(q1.tf)) * (ln((1 + (SELECT count(*) FROM one)) / (1 + df)) + 1) AS w FROM q1 JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)),
q AS (SELECT term, w / (SELECT sqrt(sum(w * w)) FROM q2) AS q FROM q2)"""


def field_vectors_sql() -> str:
    return f"""
{Q.ONE_ABSTRACT.strip()}, {Q.FIELD_OF},
fr AS MATERIALIZED (SELECT one.work, field, text FROM one JOIN field_of USING (work)),
fflat AS (SELECT work AS doc, field, unnest({Q.plain_tokens('text')}) AS term FROM fr),
ftf AS (SELECT doc, field, term, count(*) AS tf FROM fflat GROUP BY ALL),
{Q.tfidf('fv', 'ftf', '(SELECT count(*) FROM fr)', 2, 1.0, 'field')}, {Q.mean('fm', 'fv', 'field')},
fd AS (SELECT x.field AS a, y.field AS b, round(greatest(0.0, least(1.0, 1 - sum(x.w * y.w))), 6) AS distance FROM fm x JOIN fm y ON x.term = y.term AND x.field < y.field GROUP BY ALL)"""


_P, _A = Q.squeeze("problem"), Q.squeeze("approach")
_OK = f"(problem IS NOT NULL AND approach IS NOT NULL AND {Q.word_count('problem')} >= 4 AND {Q.word_count('approach')} >= 4)"
_STEM = "CASE WHEN length({0}) > 3 AND {0} LIKE '%s' THEN left({0}, length({0}) - 1) ELSE {0} END"

SQL = {
    "distinctive_words": f"WITH {_TF}, {_distinctive(8)}",
    "field_words": f"WITH {_TF}, {_FIELD} SELECT term, CAST(docs AS BIGINT) AS docs, round(concentration, 6) AS concentration, round(zipf, 6) AS zipf FROM fw",
    "distinctive_field_words": f"WITH {_TF}, {_FIELD}, {_distinctive(3, 'WHERE term IN (SELECT term FROM fw)')}",
    "usable_texts": f"SELECT doc_id, CAST(coalesce(len({Q.words('text')}), 0) AS INT) AS words, {Q.usable('text')} AS usable FROM documents",
    "token_classes": f"""SELECT doc_id, CAST(len({Q.words('text')}) AS INT) AS words, CAST(len({Q.tokens('text')}) AS INT) AS tokens,
CAST(len(list_filter({Q.tokens('text')}, lambda w: regexp_full_match(w, '{Q.LETTERS}'))) AS INT) AS letter_tokens, CAST(len({Q.terms('text')}) AS INT) AS terms,
CAST({Q.word_count('text')} AS INT) AS spaced FROM documents WHERE text IS NOT NULL""",
    "cleaned_abstracts": f"SELECT work, year, left(title, 140) AS title, {Q.squeeze(Q.clean("concat_ws('. ', title, abstract)"))} AS text FROM abstracts WHERE abstract IS NOT NULL",
    "topic_top_terms": f"WITH {_TOPICS}, {Q.mean('m', 'v', 'topic')}, r AS (SELECT topic, term, round(w, 6) AS w FROM m), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY w DESC, term) AS INT) AS rank FROM r) SELECT * FROM k WHERE rank <= 10",
    "topic_centroid_cosine": f"WITH {_TOPICS}, {CENTRES_SQL} SELECT a, b, round(cosine, 6) AS cosine FROM cc",
    "topic_closest_texts": f"WITH {_TOPICS}, {CLOSEST_SQL} SELECT a, b, round(closest, 6) AS closest FROM ct",
    "usable_counts": f"WITH {topics_sql(least=1)} SELECT topic, count(*) AS usable FROM rows1 GROUP BY topic",
    "search_papers": f"WITH {_SEARCHED}, h AS (SELECT doc AS work, round(sum(w * q), 6) AS score FROM v JOIN q USING (term) GROUP BY doc) SELECT * FROM h WHERE score > 0 ORDER BY score DESC, work LIMIT 30",
    "field_distance": f"WITH {field_vectors_sql()} SELECT * FROM fd",
    "avoided_words": f"""WITH t AS (SELECT work, list_sort(list_distinct({Q.terms('min(title)')})) AS avoid FROM abstracts WHERE title IS NOT NULL AND work IS NOT NULL GROUP BY work),
r AS (SELECT desc_id, avoid, list_transform({Q.words("concat_ws(' ', problem, approach)")}, lambda w: {_STEM.format('w')}) AS used FROM descriptions JOIN t USING (work)),
u AS (SELECT desc_id, list_filter(avoid, lambda a: list_contains(used, {_STEM.format('a')})) AS u FROM r)
SELECT desc_id, array_to_string(u, ' ') AS used, CAST(len(u) AS INT) AS n FROM u WHERE len(u) > 0""",
    "fingerprints": f"""SELECT desc_id, sha256(array_to_string({Q.words("concat_ws(' ', problem, approach)")}, ' ')) AS print, model.id || ' (' || model.provider || ')' AS model,
regexp_replace(model.id || ' (' || model.provider || ')', '[^A-Za-z0-9_.-]', '_', 'g') AS file FROM descriptions WHERE model IS NOT NULL""",
    "sample_fingerprint": "SELECT left(sha256(string_agg(id, ',' ORDER BY id)), 16) AS sample FROM topics WHERE id IS NOT NULL",
    "bridge_ids": "SELECT 'b-' || x.id || '-' || y.id AS bridge FROM topics x JOIN topics y ON x.field = y.field AND x.id < y.id AND x.domain IS NOT NULL AND y.domain IS NOT NULL",
    "link_keys": r"""SELECT work, id, CASE WHEN id SIMILAR TO '\d{4}\.\d{4,5}(v\d+)?' THEN 'doi:10.48550/arxiv.' || regexp_extract(id, '^(\d{4}\.\d{4,5})', 1)
WHEN regexp_full_match(id, '[a-z-]+(\.[A-Za-z]{2})?/\d{7}(v\d+)?') THEN 'doi:10.48550/arxiv.' || lower(regexp_extract(id, '^(.*?/\d{7})', 1))
WHEN id LIKE 'PMC%' THEN 'pmcid:' || id WHEN regexp_matches(id, '^10\.\d{4,9}/\S+$') THEN 'doi:' || lower(id) END AS key, string_split(id, '/')[-1] AS short FROM gold""",
    "prompts": f"""SELECT work, sha256(concat_ws(chr(10) || chr(10), 'Describe the paper.', 'Title: ' || title, 'Abstract: ' || abstract,
CASE WHEN len({Q.terms('title')}) > 0 THEN 'Do not use: ' || array_to_string({Q.terms('title')}, ', ') END)) AS prompt FROM abstracts WHERE work IS NOT NULL""",
    "model_answers": f"SELECT desc_id, CASE WHEN {_OK} THEN {_P} END AS problem, CASE WHEN {_OK} THEN {_A} END AS approach, {_OK} AS ok FROM descriptions",
    "issue_bodies": "SELECT desc_id, unit, work, CAST(NULL AS VARCHAR) AS fault FROM descriptions WHERE unit IS NOT NULL AND issue IS NOT NULL",
    "inverted_texts": f"SELECT DISTINCT work, sha256({Q.squeeze('abstract')}) AS text FROM abstracts WHERE abstract IS NOT NULL AND work IS NOT NULL",
    "similarity_histogram": """WITH v AS (SELECT unnest(neighbours).similarity AS s FROM neighbours),
b AS (SELECT CAST(least(floor(greatest(0, least(1, s)) * 20), 19) AS INT) AS bin, count(*) AS n FROM v WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY bin)
SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n FROM range(20) t(i) LEFT JOIN b ON b.bin = i""",
}
