"""Queries of validation, unit states and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet import session
from driftnet.functions import text as T
from driftnet.operators import graph, intake, units
from driftnet.plans import sql as Q
from driftnet.session import table


def record_faults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").withColumn("fault", intake.record_fault()).groupBy("fault").agg(F.count(F.lit(1)).alias("records"), F.min("record").alias("first"))


def description_faults(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "descriptions").select("desc_id", intake.description_fault().alias("fault"))


def rejections_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "descriptions").withColumn("fault", intake.description_fault()).filter("fault is not null and issue is not null")
    return intake.latest_rejections(rows).select("desc_id", "unit", "issue", "fault")


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    return intake.submissions(table(spark, d, "descriptions"))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    return _submissions(spark, d).withColumn("arrived", F.unix_micros("arrived"))


def unit_states(spark: SparkSession, d: str) -> DataFrame:
    return intake.unit_states(_submissions(spark, d)).withColumn("models", F.array_join("models", ", "))


def units_by_status(spark: SparkSession, d: str) -> DataFrame:
    return intake.unit_states(_submissions(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("units"))


def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    """The same states, the submissions having gone through the stream in micro-batches."""
    from driftnet.streaming import intake as stream

    folder = session.stage_path(spark, "stream")
    return stream.replay(spark, _submissions(spark, d).drop("works"), folder).withColumn("models", F.array_join("models", ", "))


def contributors(spark: SparkSession, d: str) -> DataFrame:
    return intake.contributors(table(spark, d, "descriptions"), "author")


def models_ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "descriptions").withColumn("m", T.model_name(F.col("model")))
    return intake.contributors(rows, "m")


def contributors_merged(spark: SparkSession, d: str) -> DataFrame:
    """Progress of two halves of the units, merged."""
    rows = table(spark, d, "descriptions").withColumn("half", F.substring("unit", -1, 1).isin("0", "2", "4", "6", "8"))
    return intake.merge_contributors(intake.contributors(rows.filter("half"), "author"), intake.contributors(rows.filter("not half"), "author"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "descriptions")
    return rows.agg(F.countDistinct("work").alias("papers_described"), F.count(F.lit(1)).alias("descriptions"), F.countDistinct("unit").alias("units"), F.countDistinct("author").alias("people"))


def unit_fields(spark: SparkSession, d: str) -> DataFrame:
    """How many fields each unit's papers spread over."""
    field = table(spark, d, "papers").filter("work is not null").groupBy("work").agg(F.min("field").alias("field"))
    return table(spark, d, "descriptions").select("unit", "work").distinct().join(field, "work").groupBy("unit").agg(F.countDistinct("field").alias("fields"), F.count(F.lit(1)).alias("papers"))


def relevance(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "abstracts").filter("abstract is not null and abstract <> '' and work is not null").select("work", F.concat_ws(" ", "title", "abstract").alias("text"))
    one = said.groupBy("work").agg(F.min(F.struct(-F.length("text"), "text")).alias("x")).select("work", F.col("x.text").alias("abstract"))
    rows = table(spark, d, "descriptions").filter("unit is not null and issue is not null and work is not null").select("unit", "issue", "desc_id", "work", F.concat_ws(" ", "problem", "approach").alias("text"))
    return intake.relevance(rows, one)


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Every result of the descriptions, checked: a unit's papers are the known ones described in it."""
    rows = table(spark, d, "descriptions")
    papers = table(spark, d, "papers").filter("work is not null").select("work").distinct()
    works = rows.filter("unit is not null and work is not null").select("unit", "work").distinct().join(papers, "work", "left_semi")
    title = table(spark, d, "abstracts").filter("title is not null and work is not null").groupBy("work").agg(F.min("title").alias("title"))
    avoid = title.select("work", F.array_sort(F.array_distinct(T.terms(F.col("title")))).alias("avoid"))
    said = table(spark, d, "abstracts").filter("abstract is not null and abstract <> '' and work is not null").select("work", F.concat_ws(" ", "title", "abstract").alias("text"))
    one = said.groupBy("work").agg(F.min(F.struct(-F.length("text"), "text")).alias("x")).select("work", F.col("x.text").alias("abstract"))
    return session.stage(intake.checked_results(rows, works, avoid, one, RULES), "checked")


#: The test tables' results hold copies and faults by design, so that hardly one passes whole under the defaults.
RULES = intake.SubmissionRules(most_avoided=6, most_alike=2.0, least_relevant=0.1)


def submission_faults(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("unit", "issue", "described", "fault")


def submission_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return intake.outcomes(_results(spark, d))


def alike_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of which two descriptions are alike."""
    rows = table(spark, d, "descriptions").filter("unit is not null and issue is not null")
    return intake.alike_within(rows.select(F.concat_ws("/", "unit", "issue").alias("result"), "desc_id", F.concat_ws(" ", "problem", "approach").alias("text")), "result", "text", 0.8)


def batch_imported(spark: SparkSession, d: str) -> DataFrame:
    """Results of authors whose name ends in 1 as one person's batch, after all others."""
    rows = _results(spark, d)
    late = F.coalesce(F.col("author").endswith("1"), F.lit(False))
    stored = rows.filter(~late & F.col("fault").isNull()).select("unit", "issue", "model")
    return intake.import_batch(rows.filter(late).select("unit", F.concat_ws("/", "unit", "issue").alias("file"), "model", "fault"), stored, "a")


def record_results_checked(spark: SparkSession, d: str) -> DataFrame:
    """Current records handed in domain by domain, some with another checksum, unit or order of topics."""
    domain = table(spark, d, "topics").filter("id is not null and domain is not null").select(F.col("id").alias("topic"), "domain")
    rows = graph.current_records(table(spark, d, "records")).join(domain, "topic")
    unit = F.concat_ws(" ", "domain", "freeze").alias("unit")
    one = rows.groupBy("domain", "freeze").agg(F.array_sort(F.collect_list(F.struct("topic", *[c for c in rows.columns if c in RECORD_COLUMNS and c != "topic"])), lambda x, y: F.when(x.topic < y.topic, -1).when(x.topic > y.topic, 1).otherwise(0)).alias("records"))  # a unit is some ten topics
    units = one.select(unit, "freeze", F.transform("records", lambda r: r.topic).alias("topics"))
    put = F.when(F.col("domain") == "Life Sciences", F.reverse("records")).otherwise(F.col("records"))
    named = F.when(F.col("domain") == "Health Sciences", F.lit("another")).otherwise(F.concat_ws(" ", "domain", "freeze"))
    sent = one.select(unit, "freeze", F.to_json(F.struct(named.alias("unit"), F.col("freeze"), put.alias("records"))).alias("content"))
    digest = F.when((F.col("freeze") == 2011) & (F.col("unit") != "Social Sciences 2011"), F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256))
    return intake.checked_record_results(sent.select(F.col("unit").alias("result"), "unit", "content", digest.alias("sha256")), units).select("unit", "fault")


RECORD_COLUMNS = "format topic freeze retrieved train_window recent_window size works_by_year instrument usable_abstracts cited_by_train cited_by_recent cited_by_before".split()


def record_drift(spark: SparkSession, d: str) -> DataFrame:
    """The earliest and the latest record of a topic and freeze, compared."""
    rows = table(spark, d, "records").filter("format = 1")
    keys = ["topic", "freeze"]
    first = graph.latest(rows, keys, [F.asc_nulls_last("retrieved"), F.col("record")])
    last = graph.latest(rows, keys, [F.desc_nulls_last("retrieved"), F.desc("record")])
    return intake.drift(first, last, keys)


def map_unit_states(spark: SparkSession, d: str) -> DataFrame:
    """Records as results of map units, one unit per topic, results in order of retrieval."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "records").filter("topic is not null")
    n = F.row_number().over(W.partitionBy("topic").orderBy(F.asc_nulls_last("retrieved"), "record"))
    res = rows.select(F.concat(F.lit("m-"), "topic").alias("unit"), n.alias("n"), F.left(F.sha2("record", 256), F.lit(1)).alias("author"), intake.record_fault().isNull().alias("valid"), (F.coalesce("usable_abstracts", F.lit(0)) >= 10).alias("agrees"))
    return intake.map_unit_states(res).withColumn("outcomes", F.array_join("outcomes", ", "))


def units_to_check(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "topics").filter("id is not null")
    return topics.select("id", T.needs_check(F.col("id")).alias("checked"))


def paper_units(spark: SparkSession, d: str) -> DataFrame:
    return units.chunks(table(spark, d, "papers"), "work", 20, 2025)


def benchmark_units(spark: SparkSession, d: str) -> DataFrame:
    return units.mix_benchmark(table(spark, d, "gold"), table(spark, d, "papers"), "work")


def next_unit(spark: SparkSession, d: str) -> DataFrame:
    states = intake.unit_states(_submissions(spark, d), quorum=12)
    mine = _submissions(spark, d).filter("author = 'vol-000001'")
    return units.pick_unit(states, mine, "elder-4b (local)").select("unit", "status")


def papers_open_closed(spark: SparkSession, d: str) -> DataFrame:
    """Papers without any description, those described twice and more, and descriptions of unknown papers."""
    papers = table(spark, d, "papers").filter("work is not null").select("work").distinct()
    said = table(spark, d, "descriptions").filter("work is not null").groupBy("work").agg(F.countDistinct("model.id").alias("models"))
    both = papers.withColumn("p", F.lit(1)).join(said, "work", "full_outer")
    kind = F.when(F.col("p").isNull(), "unknown paper").when(F.col("models").isNull(), "not described").when(F.col("models") >= 2, "several models").otherwise("one model")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("works"))


QUERIES = [
    record_faults, description_faults, rejections_latest, submissions, unit_states, units_by_status, stream_intake, contributors, models_ranked,
    contributors_merged, progress, unit_fields, relevance, record_drift, map_unit_states, units_to_check, paper_units, benchmark_units, next_unit,
    papers_open_closed, submission_faults, submission_outcomes, alike_results, batch_imported, record_results_checked,
]

_CK = lambda c: f"({c} IS NOT NULL AND len(list_filter(map_entries({c}), lambda e: NOT coalesce(regexp_matches(e.key, '^T[0-9]+$') AND e.value >= 0, false))) = 0)"
_RULES = [
    *[(_CK(f"cited_by_{w}"), f"cited_by_{w} isn''t counts of topics") for w in ("before", "recent", "train")],
    ("format = 1", "format isn''t format 1"), ('"freeze" IS NOT NULL', "freeze isn''t a year"),
    ("len(instrument) <= 100 AND len(list_filter(instrument, lambda w: NOT coalesce(regexp_matches(w, '^W[0-9]+$'), false))) = 0", "instrument isn''t up to 100 ids of works"),
    ('recent_window = ["freeze" - 2, "freeze"]', "recent_window isn''t the three years up to the freeze"), ("regexp_matches(topic, '^T[0-9]+$')", "topic isn''t the id of a topic"),
    ('train_window = ["freeze" - 7, "freeze"]', "train_window isn''t the eight years up to the freeze"), ("usable_abstracts BETWEEN 0 AND 40", "usable_abstracts isn''t a number up to 40"),
    ("""works_by_year IS NOT NULL AND len(list_filter(map_entries(works_by_year), lambda e: NOT coalesce(regexp_matches(e.key, '^[0-9]+$') AND CAST(e.key AS INT) BETWEEN "freeze" - 7 AND "freeze" AND e.value >= 0, false))) = 0""", "works_by_year isn''t counts of the train window''s years"),
    ("size = coalesce(list_sum(map_values(works_by_year)), 0)", "size isn''t the sum of the years'' counts"),
]
_P, _A = Q.word_count("problem"), Q.word_count("approach")
_DRULES = [
    ("regexp_matches(work, '^W[0-9]+$')", "work is no work ID"), ("author IS NOT NULL", "no author"), ("model.id IS NOT NULL AND model.provider IS NOT NULL", "no model"),
    ("problem IS NOT NULL AND approach IS NOT NULL", "a part is missing"), (f"({_P}) >= 4 AND ({_A}) >= 4", "a part is too short"), (f"({_P}) <= 60 AND ({_A}) <= 60", "a part is too long"),
    (f"NOT regexp_matches(lower({Q.squeeze("concat_ws(' ', problem, approach)")}), '(^|[^a-z])(n/a|todo|tbd|lorem ipsum|placeholder)([^a-z]|$)')", "a placeholder"),
]


def _first(rules: list) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce(({ok}), false) THEN '{said}'" for ok, said in rules) + " END"


_SUBS = """
subs AS (SELECT unit, issue, arg_min(author, (arrived, desc_id)) FILTER (author IS NOT NULL) AS author, arg_min(model.id || ' (' || model.provider || ')', (arrived, desc_id)) FILTER (model.id IS NOT NULL) AS model,
count(DISTINCT work) AS works, min(arrived) AS arrived FROM descriptions WHERE unit IS NOT NULL AND issue IS NOT NULL GROUP BY unit, issue)"""


def _states(quorum: int = 2) -> str:
    return f"""
sq AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY try_cast(issue AS BIGINT) IS NULL, coalesce(try_cast(issue AS BIGINT), 0), issue) AS n FROM subs WHERE model IS NOT NULL),
nw AS (SELECT *, n = min(n) OVER (PARTITION BY unit, model) AS fresh FROM sq),
jd AS (SELECT *, fresh AND (SELECT count(*) FROM nw e WHERE e.unit = nw.unit AND e.fresh AND e.n < nw.n) < {quorum} AS ok FROM nw),
st AS (SELECT unit, CASE WHEN count(*) FILTER (ok) >= {quorum} THEN 'done' WHEN count(*) FILTER (ok) > 0 THEN 'check' ELSE 'open' END AS status,
coalesce(string_agg(DISTINCT model, ', ' ORDER BY model) FILTER (ok), '') AS models, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS refused FROM jd GROUP BY unit)"""


_REL = f"""
{Q.ONE_ABSTRACT.strip()},
k AS (SELECT unit, issue, unit || '/' || issue AS r, desc_id, concat_ws(' ', problem, approach) AS text, one.text AS abstract FROM descriptions JOIN one USING (work) WHERE unit IS NOT NULL AND issue IS NOT NULL),
x AS (SELECT r, 'd' || desc_id AS doc, text FROM k UNION ALL SELECT r, 'a' || desc_id, abstract FROM k),
f AS (SELECT r, doc, unnest({Q.plain_tokens('text')}) AS term FROM x), tf AS (SELECT r, doc, term, count(*) AS tf FROM f GROUP BY ALL),
n AS (SELECT r, count(*) AS k FROM k GROUP BY r), df AS (SELECT r, term, count(*) AS df FROM tf GROUP BY ALL),
w0 AS (SELECT tf.r, doc, term, (1 + ln(tf)) * (ln((1 + 2 * k) / (1 + df)) + 1) AS w FROM tf JOIN df USING (r, term) JOIN n USING (r)),
w AS (SELECT r, doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY r, doc)) AS w FROM w0),
s AS (SELECT x.r, x.doc AS d, y.doc AS a, round(sum(x.w * y.w), 9) AS s FROM w x JOIN w y USING (r, term) WHERE x.doc LIKE 'd%' AND y.doc LIKE 'a%' GROUP BY ALL),
o AS (SELECT r, d, coalesce(max(s) FILTER (substr(d, 2) = substr(a, 2)), 0) AS own FROM s GROUP BY ALL),
ah AS (SELECT r, d, count(*) FILTER (s > own) AS ahead FROM s JOIN o USING (r, d) GROUP BY ALL),
hit AS (SELECT n.r, k, count(*) FILTER (ahead < greatest(1, round_even(0.15::DOUBLE * k, 0))) AS hits FROM n LEFT JOIN ah USING (r) GROUP BY ALL)"""

_ALIKE = f"""
lw AS (SELECT unit || '/' || issue AS r, desc_id, unnest(list_filter({Q.words("concat_ws(' ', problem, approach)")}, lambda w: w NOT IN {Q.STOPS})) AS term FROM descriptions WHERE unit IS NOT NULL AND issue IS NOT NULL),
lt AS MATERIALIZED (SELECT r, desc_id, term, n, sqrt(sum(n * n) OVER (PARTITION BY r, desc_id)) AS len FROM (SELECT r, desc_id, term, count(*) AS n FROM lw GROUP BY ALL)),
lp AS MATERIALIZED (SELECT x.r, x.desc_id AS x, y.desc_id AS y, sum(x.n * y.n) / any_value(x.len * y.len) AS c FROM lt x JOIN lt y ON x.r = y.r AND x.term = y.term AND x.desc_id < y.desc_id GROUP BY ALL)"""
_CHECKED = f"""{_SUBS.strip()}, {_REL.strip()},
un AS (SELECT DISTINCT unit, work FROM descriptions WHERE unit IS NOT NULL AND work IN (SELECT work FROM papers WHERE work IS NOT NULL)), us AS (SELECT unit, count(*) AS papers FROM un GROUP BY unit),
tv AS (SELECT work, list_sort(list_distinct({Q.terms('min(title)')})) AS avoid FROM abstracts WHERE title IS NOT NULL AND work IS NOT NULL GROUP BY work),
dq AS (SELECT *, {_first(_DRULES)} AS own FROM descriptions WHERE unit IS NOT NULL AND issue IS NOT NULL),
dr AS (SELECT d.unit, d.issue, d.desc_id, d.work, own, un.work IS NOT NULL AS member, list_transform({Q.words("concat_ws(' ', d.problem, d.approach)")}, lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END) AS used, coalesce(avoid, []) AS avoid
FROM dq d LEFT JOIN un ON un.unit = d.unit AND un.work = d.work LEFT JOIN tv ON tv.work = d.work),
pr AS (SELECT unit, issue, count(*) AS n, count(DISTINCT work) AS described, count(*) FILTER (NOT member) AS strange, count(own) AS own,
max(len(list_filter(avoid, lambda a: list_contains(used, CASE WHEN length(a) > 3 AND a LIKE '%s' THEN left(a, length(a) - 1) ELSE a END)))) AS used FROM dr GROUP BY ALL),
ck AS MATERIALIZED (SELECT pr.unit, pr.issue, subs.author, subs.model, described, CASE WHEN strange > 0 THEN 'a paper isn''t the unit''s' WHEN n <> described THEN 'a paper is described twice' WHEN own > 0 THEN 'a description is at fault'
WHEN used > {RULES.most_avoided} THEN 'too many avoided words' WHEN described < {RULES.least_covered}::DOUBLE * coalesce(papers, 0) THEN 'too few papers are described' WHEN hit.k >= 4 AND round(hits / hit.k, 6) < {RULES.least_relevant}::DOUBLE THEN 'descriptions of other papers' END AS fault
FROM pr JOIN subs ON subs.unit = pr.unit AND subs.issue = pr.issue LEFT JOIN us ON us.unit = pr.unit LEFT JOIN hit ON hit.r = pr.unit || '/' || pr.issue)"""


def _outcomes(frm: str) -> str:
    return f"""
oq AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY try_cast(issue AS BIGINT) IS NULL, coalesce(try_cast(issue AS BIGINT), 0), issue) AS n FROM {frm}),
ow AS MATERIALIZED (SELECT *, coalesce(fault IS NULL AND model IS NOT NULL AND n = min(n) FILTER (fault IS NULL AND model IS NOT NULL) OVER (PARTITION BY unit, model), false) AS fresh FROM oq),
ox AS (SELECT *, (SELECT count(*) FROM ow e WHERE e.unit = ow.unit AND e.fresh AND e.n < ow.n) AS before FROM ow),
oz AS (SELECT unit, issue, model, CASE WHEN before >= 2 THEN 'complete' WHEN fresh THEN 'stored' ELSE 'refused' END AS outcome, CASE WHEN before >= 2 OR fresh THEN NULL ELSE coalesce(fault, CASE WHEN model IS NULL THEN 'no model' ELSE 'the unit has a result of this model' END) END AS reason FROM ox)"""


SQL = {
    "alike_results": f"WITH {_ALIKE} SELECT DISTINCT r AS result FROM lp WHERE round(c, 9) > 0.8::DOUBLE",
    "submission_faults": f"WITH {_CHECKED} SELECT unit, issue, described, fault FROM ck",
    "submission_outcomes": f"WITH {_CHECKED}, {_outcomes('ck')} SELECT unit, issue, outcome, reason FROM oz",
    "batch_imported": f"""WITH {_CHECKED}, lt AS (SELECT *, coalesce(author LIKE '%1', false) AS late FROM ck), nb AS (SELECT *, 'import-a-' || lpad(CAST(row_number() OVER (ORDER BY unit || '/' || issue, unit) AS VARCHAR), 3, '0') AS id FROM lt WHERE late),
al AS (SELECT unit, issue, model, CAST(NULL AS VARCHAR) AS fault FROM lt WHERE NOT late AND fault IS NULL UNION ALL SELECT unit, id, model, fault FROM nb), {_outcomes('al')}
SELECT id, nb.unit, nb.model, outcome = 'stored' AS accepted, coalesce(reason, CASE WHEN outcome = 'complete' THEN 'the unit is complete' END) AS reason FROM nb JOIN oz ON oz.unit = nb.unit AND oz.issue = nb.id""",
    "record_results_checked": f"""WITH {Q.RECORDS.strip()}, r AS (SELECT cur.*, domain FROM cur JOIN topics t ON t.id = cur.topic WHERE domain IS NOT NULL), o AS (SELECT *, {_first(_RULES)} AS own FROM r),
u AS (SELECT domain, "freeze" AS f, count(*) AS n, arg_min(topic || ': ' || own, topic) FILTER (own IS NOT NULL) AS own FROM o GROUP BY ALL)
SELECT domain || ' ' || f AS unit, CASE WHEN f = 2011 AND domain <> 'Social Sciences' THEN 'the checksum is another' WHEN domain = 'Health Sciences' THEN 'it is for another unit or freeze'
WHEN domain = 'Life Sciences' AND n > 1 THEN 'its topics aren''t the unit''s, in order' ELSE own END AS fault FROM u""",
    "near_duplicate_descriptions": f"""WITH RECURSIVE {_ALIKE}, nd AS MATERIALIZED (SELECT r, desc_id, row_number() OVER (PARTITION BY r ORDER BY desc_id) AS n FROM (SELECT unit || '/' || issue AS r, desc_id FROM descriptions WHERE unit IS NOT NULL AND issue IS NOT NULL)),
al AS MATERIALIZED (SELECT r, y, list(x ORDER BY x) AS xs FROM lp WHERE round(c, 9) > 0.8::DOUBLE GROUP BY ALL),
fo AS (SELECT r, n, desc_id, CAST(NULL AS BIGINT) AS repeats, [desc_id] AS taken FROM nd WHERE n = 1
UNION ALL SELECT nd.r, nd.n, nd.desc_id, list_min(list_intersect(fo.taken, xs)), CASE WHEN len(list_intersect(fo.taken, coalesce(xs, []))) > 0 THEN fo.taken ELSE list_append(fo.taken, nd.desc_id) END FROM fo JOIN nd ON nd.r = fo.r AND nd.n = fo.n + 1 LEFT JOIN al ON al.r = nd.r AND al.y = nd.desc_id)
SELECT r AS result, desc_id, repeats FROM fo WHERE repeats IS NOT NULL""",
    "map_unit_states": f"""WITH RECURSIVE rs AS (SELECT 'm-' || topic AS unit, row_number() OVER (PARTITION BY topic ORDER BY retrieved NULLS LAST, record) AS n, left(sha256(record), 1) AS author, ({_first(_RULES)}) IS NULL AS valid, coalesce(usable_abstracts, 0) >= 10 AS agrees FROM records WHERE topic IS NOT NULL),
hx AS (SELECT DISTINCT unit, sha256(unit) AS h FROM rs), fl AS (SELECT unit, list_transform(range(1, 65), lambda i: position(h[i] IN '0123456789abcdef') - 1) AS d FROM hx), ck AS (SELECT unit, d[64] % 4 = 0 AND list_sum(d) % 5 = 0 AS checked FROM fl),
x AS MATERIALIZED (SELECT * FROM rs JOIN ck USING (unit)),
s AS (SELECT unit, 0::BIGINT AS n, 'open' AS status, NULL::VARCHAR AS first, []::VARCHAR[] AS said FROM ck
UNION ALL SELECT x.unit, x.n, CASE WHEN s.status IN ('done', 'disputed') OR NOT valid THEN s.status WHEN s.status = 'open' THEN CASE WHEN checked THEN 'check' ELSE 'done' END WHEN author = first THEN s.status WHEN agrees THEN 'done' ELSE 'disputed' END,
CASE WHEN s.status = 'open' AND valid THEN author ELSE first END,
list_append(said, CASE WHEN s.status IN ('done', 'disputed') THEN 'complete' WHEN NOT valid THEN 'invalid' WHEN s.status = 'open' THEN 'accepted' WHEN author = first THEN 'another volunteer is needed' ELSE 'accepted' END) FROM s JOIN x ON x.unit = s.unit AND x.n = s.n + 1)
SELECT unit, arg_max(status, n) AS status, array_to_string(arg_max(said, n), ', ') AS outcomes FROM s GROUP BY unit""",
    "record_faults": f"SELECT {_first(_RULES)} AS fault, count(*) AS records, min(record) AS first FROM records GROUP BY fault",
    "description_faults": f"SELECT desc_id, {_first(_DRULES)} AS fault FROM descriptions",
    "rejections_latest": f"""WITH r AS (SELECT desc_id, unit, issue, {_first(_DRULES)} AS fault FROM descriptions)
SELECT * FROM r WHERE fault IS NOT NULL AND issue IS NOT NULL ORDER BY try_cast(issue AS BIGINT) IS NULL DESC, coalesce(try_cast(issue AS BIGINT), 0) DESC, issue DESC, desc_id DESC LIMIT 500""",
    "submissions": f"WITH {_SUBS} SELECT unit, issue, author, model, works, epoch_us(arrived) AS arrived FROM subs",
    "unit_states": f"WITH {_SUBS}, {_states()} SELECT * FROM st",
    "units_by_status": f"WITH {_SUBS}, {_states()} SELECT status, count(*) AS units FROM st GROUP BY status",
    "stream_intake": f"WITH {_SUBS}, {_states()} SELECT * FROM st",
    "contributors": "SELECT author AS name, count(DISTINCT unit) AS units, count(*) AS descriptions FROM descriptions WHERE author IS NOT NULL GROUP BY author",
    "models_ranked": "SELECT model.id || ' (' || model.provider || ')' AS name, count(DISTINCT unit) AS units, count(*) AS descriptions FROM descriptions WHERE model.id IS NOT NULL AND model.provider IS NOT NULL GROUP BY 1",
    "contributors_merged": "SELECT author AS name, count(DISTINCT unit) AS units, count(*) AS descriptions FROM descriptions WHERE author IS NOT NULL AND unit IS NOT NULL GROUP BY author",
    "progress": "SELECT count(DISTINCT work) AS papers_described, count(*) AS descriptions, count(DISTINCT unit) AS units, count(DISTINCT author) AS people FROM descriptions",
    "unit_fields": """WITH f AS (SELECT work, min(field) AS field FROM papers WHERE work IS NOT NULL GROUP BY work), u AS (SELECT DISTINCT unit, work FROM descriptions)
SELECT unit, count(DISTINCT field) AS fields, count(*) AS papers FROM u JOIN f USING (work) GROUP BY unit""",
    "relevance": f"WITH {_REL} SELECT string_split(r, '/')[1] AS unit, string_split(r, '/')[2] AS issue, k AS known, CASE WHEN k >= 4 THEN round(hits / k, 6) END AS relevance FROM hit",
    "record_drift": """WITH r AS (SELECT topic, "freeze", record, retrieved, coalesce(instrument, []) AS i, coalesce(list_sum(map_values(cited_by_train)), 0) AS t FROM records WHERE format = 1 AND topic IS NOT NULL AND "freeze" IS NOT NULL),
x AS (SELECT DISTINCT ON (topic, "freeze") * FROM r ORDER BY topic, "freeze", retrieved ASC NULLS LAST, record), y AS (SELECT DISTINCT ON (topic, "freeze") * FROM r ORDER BY topic, "freeze", retrieved DESC NULLS LAST, record DESC),
z AS (SELECT topic, "freeze", len(list_intersect(x.i, y.i)) / greatest(len(list_distinct(list_concat(x.i, y.i))), 1) AS j, CAST(x.t AS BIGINT) AS a, CAST(y.t AS BIGINT) AS b FROM x JOIN y USING (topic, "freeze"))
SELECT topic, "freeze", round(j, 6) AS jaccard, a, b, j >= 0.9::DOUBLE AND abs(a - b) <= greatest(5.0, 0.05::DOUBLE * greatest(a, b)) AS agrees FROM z""",
    "units_to_check": """WITH h AS (SELECT id, sha256(id) AS h FROM topics WHERE id IS NOT NULL), d AS (SELECT id, list_transform(range(1, 65), lambda i: position(h[i] IN '0123456789abcdef') - 1) AS d FROM h)
SELECT id, d[64] % 4 = 0 AND list_sum(d) % 5 = 0 AS checked FROM d""",
    "paper_units": """WITH p AS (SELECT DISTINCT work FROM papers WHERE work IS NOT NULL), r AS (SELECT work, row_number() OVER (ORDER BY sha256('2025:' || work), work) - 1 AS i FROM p)
SELECT 'u-' || lpad(CAST(i // 20 AS VARCHAR), 6, '0') AS unit, CAST(i % 20 + 1 AS INT) AS position, work FROM r""",
    "benchmark_units": """WITH g AS (SELECT DISTINCT work FROM gold WHERE work IS NOT NULL), f AS (SELECT DISTINCT work FROM papers WHERE work IS NOT NULL AND work NOT IN (SELECT work FROM g)),
u AS (SELECT work, true AS is_gold, (row_number() OVER (ORDER BY sha256('1g:' || work), work) - 1) // 5 AS i FROM g UNION ALL SELECT work, false, (row_number() OVER (ORDER BY sha256('1f:' || work), work) - 1) // 15 FROM f)
SELECT 'k-' || lpad(CAST(i AS VARCHAR), 6, '0') AS unit, CAST(row_number() OVER (PARTITION BY i ORDER BY sha256('1m:' || work)) AS INT) AS position, work, is_gold FROM u WHERE i IN (SELECT i FROM u WHERE is_gold)""",
    "next_unit": f"""WITH {_SUBS}, {_states(12)} SELECT unit, status FROM st WHERE status IN ('open', 'check') AND NOT list_contains(string_split(models, ', '), 'elder-4b (local)')
AND unit NOT IN (SELECT unit FROM subs WHERE author = 'vol-000001') ORDER BY status <> 'check', unit LIMIT 1""",
    "papers_open_closed": """WITH p AS (SELECT DISTINCT work FROM papers WHERE work IS NOT NULL), s AS (SELECT work, count(DISTINCT model.id) AS models FROM descriptions WHERE work IS NOT NULL GROUP BY work)
SELECT CASE WHEN p.work IS NULL THEN 'unknown paper' WHEN s.work IS NULL THEN 'not described' WHEN models >= 2 THEN 'several models' ELSE 'one model' END AS kind, count(*) AS works FROM p FULL JOIN s ON p.work = s.work GROUP BY kind""",
}
