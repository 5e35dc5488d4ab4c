"""Queries of twin matching and of the retrieval benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.functions import text as T
from driftnet.operators import metrics, twins
from driftnet.operators import vectors as V
from driftnet.plans import sql as Q
from driftnet.plans.text_queries import field_vectors_sql
from driftnet.session import stage, table


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = stage(twins.described(table(spark, d, "descriptions")), "described")
    return rows, stage(twins.description_vectors(rows), "vectors")


def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows, vectors = _vectors(spark, d)
    return twins.model_report(rows, twins.agreements(rows, vectors))


def paper_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows, vectors = _vectors(spark, d)
    return twins.agreements(rows, vectors).groupBy("work").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("agreement"), 5).alias("agreement"))


def mean_likeness(spark: SparkSession, d: str) -> DataFrame:
    _, vectors = _vectors(spark, d)
    return twins.mean_likeness(twins.paper_vectors(vectors)).select(F.col("doc").alias("work"), F.round("likeness", 6).alias("likeness"))


def _near(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Unit vectors of the papers, and each paper's k nearest of other fields."""
    _, vectors = _vectors(spark, d)
    papers = table(spark, d, "papers")
    whole = stage(twins.paper_vectors(vectors), "papers")
    distances = twins.field_distances(twins.field_vectors(papers, table(spark, d, "abstracts")))
    return whole, twins.near_pairs(whole, twins.field_of(papers), stage(distances, "distances"), k)


def near_papers(spark: SparkSession, d: str) -> DataFrame:
    return twins.top_partners(_near(spark, d, 5)[1], "similarity", 5).select("work", "other", "similarity", "rank")


def twin_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The pairs among either side's forty best by score; known tells those of one family."""
    k = twins.TwinRules.candidates
    found = twins.candidates(_near(spark, d, k)[1], k)
    known = twins.families(table(spark, d, "papers"))
    for s in "ab":
        found = found.join(known.select(F.col("work").alias(s), F.col("family").alias(f"k{s}")), s, "left")
    return found.select("a", "b", "similarity", "distance", "score", F.coalesce(F.col("ka") == F.col("kb"), F.lit(False)).alias("known"))


def why_words(spark: SparkSession, d: str) -> DataFrame:
    whole, near = _near(spark, d, 1)
    best = twins.top_partners(near, "similarity", 1).select(F.least("work", "other").alias("a"), F.greatest("work", "other").alias("b")).distinct()
    return V.shared_words(best, whole, "a", "b")


def known_cases(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    distances = twins.field_distances(twins.field_vectors(papers, table(spark, d, "abstracts")))
    return twins.known_pairs(twins.paper_vectors(_vectors(spark, d)[1]), twins.field_of(papers), distances, twins.families(papers))


def reliable_papers(spark: SparkSession, d: str) -> DataFrame:
    rows, vectors = _vectors(spark, d)
    return twins.reliable(twins.agreements(rows, vectors), stage(twins.paper_vectors(vectors), "papers"), F.lit(0.1))


def twins_selected(spark: SparkSession, d: str) -> DataFrame:
    """The whole flow, as nested rows."""
    papers = table(spark, d, "papers")
    found = twins.combine(table(spark, d, "descriptions"), papers, table(spark, d, "abstracts"))
    chosen = stage(found["twins"], "twins")
    return twins.nested(chosen, V.shared_words(chosen, found["vectors"], "a", "b"), twins.field_of(papers))


def twins_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that the whole flow chooses, confirmed ones first, each paper in two at most."""
    found = twins.combine(table(spark, d, "descriptions"), table(spark, d, "papers"), table(spark, d, "abstracts"))
    return found["twins"].select("a", "b", "similarity", "distance", "score", "trust")


def twin_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Published pairs laid flat, each once in one direction with its best score, by trust."""
    flat = table(spark, d, "twins").select(F.explode("twins").alias("t"))
    name = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    rows = flat.select(name("t.a.work").alias("x"), name("t.b.work").alias("y"), F.col("t.score").alias("score"), F.coalesce("t.trust", F.lit("unknown")).alias("trust"))
    ok = rows.filter("x is not null and y is not null and x <> y")
    return ok.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("times"), F.array_join(F.array_sort(F.collect_set("trust")), ", ").alias("trust"))


def twin_words(spark: SparkSession, d: str) -> DataFrame:
    """How often each word explains a published pair, and with what share on average."""
    flat = table(spark, d, "twins").select(F.explode("twins").alias("t")).select(F.explode("t.why").alias("w"))
    return flat.filter("w.word is not null").groupBy(F.col("w.word").alias("word")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("w.share"), 6).alias("share"))


def open_index(spark: SparkSession, d: str) -> DataFrame:
    """One row a paper: its descriptions in order, as the open index nests them."""
    rows = twins.described(table(spark, d, "descriptions"))
    nested = rows.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("model", "text"))).alias("d"))
    joined = F.array_join(F.transform("d", lambda x: F.concat(x.model, F.lit(": "), x.text)), " | ")
    return nested.join(twins.field_of(table(spark, d, "papers")), "work", "left").select("work", "field", F.size("d").alias("descriptions"), F.sha2(joined, 256).alias("said"))


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(query, item, s) over gold texts, and the gold rows."""
    gold = table(spark, d, "gold").filter("work is not null and text is not null").dropDuplicates(["work"])
    tf = V.doc_terms(gold, "work", T.without(T.tokens(F.col("text")), list(T.STOP_WORDS)))
    near = V.cosine_pairs(V.tfidf(tf, gold.agg(F.count(F.lit(1)).alias("n")), 2), "doc")
    both = twins.both_sides(near).select(F.col("work").alias("query"), F.col("other").alias("item"), F.col("cosine").alias("s"))
    return both, gold


def known_twin_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of each benchmark paper: relevant are members of its family from other fields."""
    near, gold = _gold(spark, d)
    q = gold.filter("role = 'member' and family is not null").select(F.col("work").alias("query"), F.col("family").alias("qf"), F.coalesce("field", F.lit("")).alias("qd"))
    p = gold.select(F.col("work").alias("item"), F.col("family").alias("pf"), F.coalesce("field", F.lit("")).alias("pd"), F.col("role").alias("pr"))
    relevant = F.coalesce((F.col("qf") == F.col("pf")) & (F.col("qd") != F.col("pd")) & (F.col("pr") == "member"), F.lit(False))
    return metrics.retrieval(near, q, p, relevant).select("query", F.round("ap", 6).alias("ap"), "first")


def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    """MAP and precision at 1, of all papers and of those whose method has no name."""
    gold = table(spark, d, "gold").select(F.col("work").alias("query"), F.col("method_named").isNull().alias("unnamed")).dropDuplicates(["query"])
    each = known_twin_retrieval(spark, d).join(gold, "query")
    subset = F.explode(F.when(F.col("unnamed"), F.array(F.lit("all"), F.lit("unnamed"))).otherwise(F.array(F.lit("all")))).alias("subset")
    return each.select("ap", "first", subset).groupBy("subset").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("first"), 6).alias("p1"))


def family_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """95% interval of MAP, families drawn with replacement 2,000 times; draws by hash, so any rerun agrees."""
    fam = table(spark, d, "gold").filter("family is not null").select(F.col("work").alias("query"), "family").dropDuplicates(["query"])
    per = known_twin_retrieval(spark, d).join(fam, "query").groupBy("family").agg(F.sum("ap").alias("s"), F.count(F.lit(1)).alias("n"))
    numbered = stage(metrics.ranked(per.withColumn("z", F.lit(0)), "z", ["family"]), "families")
    size = numbered.agg(F.max("rank").alias("k"))
    draws = spark.range(2000).select(F.col("id").alias("draw")).crossJoin(F.broadcast(size))  # size is one row
    picks = draws.select("draw", "k", F.explode(F.sequence(F.lit(1).cast("bigint"), "k")).alias("i")).select("draw", (F.conv(F.left(F.sha2(F.concat_ws("|", F.lit("2025"), "draw", "i"), 256), F.lit(8)), 16, 10).cast("bigint") % F.col("k") + 1).alias("rank"))
    means = picks.join(numbered, "rank").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("map"))
    p = lambda q, n: F.round(F.percentile("map", F.lit(q)), 6).alias(n)
    return means.agg(F.count(F.lit(1)).alias("draws"), p(0.025, "low"), p(0.5, "median"), p(0.975, "high"))


def paper_layout(spark: SparkSession, d: str) -> DataFrame:
    """Positions of described papers on a map."""
    from driftnet.operators import layout

    rows = twins.described(table(spark, d, "descriptions"))
    vectors = stage(twins.paper_vectors(stage(twins.description_vectors(rows), "vectors")), "papers")
    return layout.layout(stage(layout.truncated_svd(vectors), "reduced"))


QUERIES = [
    model_agreement, paper_agreement, mean_likeness, near_papers, twin_candidates, why_words, known_cases, reliable_papers, twins_selected, twins_chosen, twin_pairs,
    twin_words, open_index, known_twin_retrieval, retrieval_summary, family_bootstrap, paper_layout,
]

_DESCRIBED = f"""
rws AS MATERIALIZED (SELECT desc_id, work, concat_ws('/', model.provider, model.id) AS model, concat_ws(' ', problem, approach) AS text FROM descriptions
  WHERE work IS NOT NULL AND model IS NOT NULL AND desc_id IS NOT NULL AND trim(concat_ws(' ', problem, approach)) <> ''),
dflat AS (SELECT desc_id AS doc, work, unnest({Q.plain_tokens('text')}) AS term FROM rws),
dtf AS (SELECT doc, work, term, count(*) AS tf FROM dflat GROUP BY ALL),
{Q.tfidf('v', 'dtf', '(SELECT count(*) FROM rws)', 2, 1.0, 'work')}"""
_AGREE = """
pr AS (SELECT x.work, x.desc_id AS x, y.desc_id AS y, x.model AS mx, y.model AS my FROM rws x JOIN rws y ON x.work = y.work AND x.desc_id < y.desc_id AND x.model <> y.model),
dt AS (SELECT pr.x, pr.y, sum(a.w * b.w) AS dot FROM pr JOIN v a ON a.doc = pr.x JOIN v b ON b.doc = pr.y AND b.term = a.term GROUP BY ALL),
ag AS MATERIALIZED (SELECT pr.*, coalesce(dot, 0) AS agreement FROM pr LEFT JOIN dt ON dt.x = pr.x AND dt.y = pr.y)"""
_PV = Q.mean("pv", "v", "work")
_SIM = f"""{field_vectors_sql().strip()},
fam AS (SELECT work, min(family) AS family FROM papers WHERE family IS NOT NULL AND role = 'member' AND work IS NOT NULL GROUP BY work),
pl AS MATERIALIZED (SELECT pv.*, coalesce(f.field, pv.work) AS field FROM pv LEFT JOIN field_of f USING (work)),
s0 AS (SELECT x.work AS a, y.work AS b, any_value(x.field) AS fa, any_value(y.field) AS fb, round(sum(x.w * y.w), 6) AS similarity FROM pl x JOIN pl y ON x.term = y.term AND x.work < y.work AND x.field <> y.field GROUP BY x.work, y.work),
sp AS MATERIALIZED (SELECT s0.a, s0.b, similarity, coalesce(fd.distance, 1.0) AS distance, round(similarity * coalesce(fd.distance, 1.0), 6) AS score, coalesce(ka.family = kb.family, false) AS known
FROM s0 LEFT JOIN fd ON fd.a = least(fa, fb) AND fd.b = greatest(fa, fb) LEFT JOIN fam ka ON ka.work = s0.a LEFT JOIN fam kb ON kb.work = s0.b WHERE similarity > 0),
sides AS (SELECT a AS work, b AS other, similarity, score FROM sp UNION ALL SELECT b, a, similarity, score FROM sp)"""
_ALL = f"WITH {_DESCRIBED}, {_PV}, {_SIM}"
_GOLD = f"""
g AS (SELECT DISTINCT ON (work) * FROM gold WHERE work IS NOT NULL AND text IS NOT NULL),
gflat AS (SELECT work AS doc, unnest({Q.plain_tokens('text')}) AS term FROM g), gtf AS (SELECT doc, term, count(*) AS tf FROM gflat GROUP BY ALL),
{Q.tfidf('gv', 'gtf', '(SELECT count(*) FROM g)', 2)},
gs AS (SELECT x.doc AS query, y.doc AS item, sum(x.w * y.w) AS s FROM gv x JOIN gv y ON x.term = y.term AND x.doc <> y.doc GROUP BY ALL),
rk AS (SELECT q.work AS query, round(coalesce(s, 0), 6) AS s, p.work AS item, CAST(coalesce(q.family = p.family AND coalesce(q.field, '') <> coalesce(p.field, '') AND p.role = 'member', false) AS INT) AS rel
FROM g q JOIN g p ON q.work <> p.work LEFT JOIN gs ON gs.query = q.work AND gs.item = p.work WHERE q.role = 'member' AND q.family IS NOT NULL),
hh AS (SELECT *, row_number() OVER w AS r, sum(rel) OVER w AS hits FROM rk WINDOW w AS (PARTITION BY query ORDER BY s DESC, item)),
ap AS MATERIALIZED (SELECT query, round(sum(CASE WHEN rel = 1 THEN hits / r ELSE 0 END) / sum(rel), 6) AS ap, CAST(max(rel) FILTER (r = 1) AS INT) AS first FROM hh GROUP BY query HAVING sum(rel) > 0)"""

_CHOSEN = f"""WITH RECURSIVE {_DESCRIBED.strip()}, {_AGREE.strip()}, {_PV.strip()}, {_SIM.strip()},
nb AS MATERIALIZED (SELECT desc_id, work, row_number() OVER (ORDER BY CAST('0x' || left(sha256('2025|' || desc_id), 8) AS BIGINT), desc_id) AS rank FROM rws),
ch AS (SELECT p AS pair, CAST('0x' || left(sha256('2025|i|' || p), 8) AS BIGINT) % (SELECT count(*) FROM nb) + 1 AS i, CAST('0x' || left(sha256('2025|j|' || p), 8) AS BIGINT) % (SELECT count(*) FROM nb) + 1 AS j FROM range(20000) r(p)),
xy AS MATERIALIZED (SELECT pair, x.desc_id AS x, y.desc_id AS y FROM ch JOIN nb x ON x.rank = i JOIN nb y ON y.rank = j WHERE x.work <> y.work),
xd AS (SELECT pair, sum(a.w * b.w) AS dot FROM xy JOIN v a ON a.doc = x JOIN v b ON b.doc = y AND b.term = a.term GROUP BY pair),
th AS (SELECT quantile_cont(coalesce(dot, 0), 0.95) AS t FROM xy LEFT JOIN xd USING (pair)),
mm AS (SELECT work, avg(agreement) AS agreement FROM ag GROUP BY work HAVING avg(agreement) > (SELECT t FROM th)), al AS (SELECT DISTINCT work FROM pv),
ss AS (SELECT x.work, y.work AS other, sum(x.w * y.w) AS s FROM pv x JOIN pv y ON x.term = y.term AND x.work <> y.work WHERE x.work IN (SELECT work FROM mm) GROUP BY ALL),
ff AS (SELECT mm.work, mm.agreement, coalesce(ss.s, 0) AS s FROM mm JOIN al ON al.work <> mm.work LEFT JOIN ss ON ss.work = mm.work AND ss.other = al.work),
tr AS MATERIALIZED (SELECT work FROM ff GROUP BY work HAVING round(any_value(agreement), 6) > round(quantile_cont(s, 0.99) + 0.0001::DOUBLE, 6)),
tt AS (SELECT term, sum(w) AS t FROM pv GROUP BY term), lk AS MATERIALIZED (SELECT work, round((sum(w * t) - sum(w * w)) / greatest((SELECT count(*) FROM al) - 1, 1), 9) AS likeness FROM pv JOIN tt USING (term) GROUP BY work),
gn AS MATERIALIZED (SELECT work FROM lk WHERE likeness > (SELECT quantile_cont(likeness, 0.95) FROM lk)),
cd AS (SELECT DISTINCT least(work, other) AS a, greatest(work, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY score DESC, other) AS r FROM sides) WHERE r <= 40),
cl AS (SELECT sp.*, a IN (SELECT work FROM tr) AND b IN (SELECT work FROM tr) AS sure, a IN (SELECT work FROM gn) OR b IN (SELECT work FROM gn) AS generic FROM sp JOIN cd USING (a, b) WHERE NOT known),
rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sure DESC, score DESC, a, b) AS i FROM cl WHERE sure OR NOT generic),
st AS (SELECT 0::BIGINT AS i, 0 AS sure_n, 0 AS lead_n, []::VARCHAR[] AS used, []::BIGINT[] AS chosen
UNION ALL SELECT rk.i, sure_n + CASE WHEN sure AND take THEN 1 ELSE 0 END, lead_n + CASE WHEN NOT sure AND take THEN 1 ELSE 0 END, CASE WHEN take THEN used || [a, b] ELSE used END, CASE WHEN take THEN chosen || [rk.i] ELSE chosen END
FROM (SELECT st.*, q.*, CASE WHEN q.sure THEN sure_n ELSE lead_n END < 50 AND len(list_filter(used, lambda u: u = q.a)) < 2 AND len(list_filter(used, lambda u: u = q.b)) < 2 AS take FROM st JOIN (SELECT i AS j, a, b, sure FROM rk) q ON q.j = st.i + 1 WHERE lead_n < 50) z JOIN (SELECT i FROM rk) rk ON rk.i = z.j)
SELECT a, b, similarity, distance, score, CASE WHEN sure THEN 'two models agree' ELSE 'one model so far' END AS trust FROM rk WHERE i IN (SELECT unnest(chosen) FROM (SELECT chosen FROM st ORDER BY i DESC LIMIT 1))"""

SQL = {
    "twins_chosen": _CHOSEN,
    "model_agreement": f"""WITH {_DESCRIBED}, {_AGREE}, c AS (SELECT model, count(*) AS descriptions, count(DISTINCT work) AS papers FROM rws GROUP BY model),
m AS (SELECT model, count(*) AS pairs, round(avg(agreement), 4) AS agreement FROM (SELECT mx AS model, agreement FROM ag UNION ALL SELECT my, agreement FROM ag) GROUP BY model)
SELECT model, descriptions, papers, coalesce(pairs, 0) AS pairs, agreement FROM c LEFT JOIN m USING (model)""",
    "paper_agreement": f"WITH {_DESCRIBED}, {_AGREE} SELECT work, count(*) AS pairs, round(avg(agreement), 5) AS agreement FROM ag GROUP BY work",
    "mean_likeness": f"""WITH {_DESCRIBED}, {_PV}, t AS (SELECT term, sum(w) AS t FROM pv GROUP BY term), n AS (SELECT count(DISTINCT work) AS n FROM pv)
SELECT work, round(round((sum(w * t) - sum(w * w)) / greatest(any_value(n) - 1, 1), 9), 6) AS likeness FROM pv JOIN t USING (term), n GROUP BY work""",
    "near_papers": f"{_ALL} SELECT work, other, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY similarity DESC, other) AS rank FROM sides) WHERE rank <= 5",
    "twin_candidates": f"""{_ALL}, t AS (SELECT DISTINCT least(work, other) AS a, greatest(work, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY score DESC, other) AS r FROM sides) WHERE r <= 40)
SELECT a, b, similarity, distance, score, known FROM sp JOIN t USING (a, b)""",
    "why_words": f"""{_ALL}, t AS (SELECT DISTINCT least(work, other) AS a, greatest(work, other) AS b FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY similarity DESC, other) AS r FROM sides) WHERE r = 1),
w AS (SELECT a, b, x.term, round(x.w * y.w, 6) AS share FROM t JOIN pv x ON x.work = a JOIN pv y ON y.work = b AND y.term = x.term)
SELECT a, b, term, share, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY share DESC, term) AS rank FROM w WHERE share > 0) WHERE rank <= 6""",
    "known_cases": f"{_ALL} SELECT a, b, similarity, distance, score FROM sp WHERE known",
    "reliable_papers": f"""WITH {_DESCRIBED}, {_AGREE}, {_PV}, m AS (SELECT work, avg(agreement) AS agreement FROM ag GROUP BY work HAVING avg(agreement) > 0.1::DOUBLE),
al AS (SELECT DISTINCT work FROM pv), s AS (SELECT x.work, y.work AS other, sum(x.w * y.w) AS s FROM pv x JOIN pv y ON x.term = y.term AND x.work <> y.work WHERE x.work IN (SELECT work FROM m) GROUP BY ALL),
f AS (SELECT m.work, m.agreement, coalesce(s.s, 0) AS s FROM m JOIN al ON al.work <> m.work LEFT JOIN s ON s.work = m.work AND s.other = al.work),
c AS (SELECT work, any_value(agreement) AS agreement, quantile_cont(s, 0.99) AS cut FROM f GROUP BY work)
SELECT work, round(agreement, 6) AS agreement FROM c WHERE round(agreement, 6) > round(cut + 0.0001::DOUBLE, 6)""",
    "twin_pairs": """WITH t AS (SELECT unnest(twins) AS t FROM twins),
r AS (SELECT nullif(upper(trim(t.a.work)), '') AS x, nullif(upper(trim(t.b.work)), '') AS y, t.score AS score, coalesce(t.trust, 'unknown') AS trust FROM t)
SELECT least(x, y) AS a, greatest(x, y) AS b, max(score) AS score, count(*) AS times, string_agg(DISTINCT trust, ', ' ORDER BY trust) AS trust FROM r WHERE x <> y GROUP BY 1, 2""",
    "twin_words": """WITH t AS (SELECT unnest(twins) AS t FROM twins), w AS (SELECT unnest(t.why) AS w FROM t)
SELECT w.word AS word, count(*) AS pairs, round(avg(w.share), 6) AS share FROM w WHERE w.word IS NOT NULL GROUP BY 1""",
    "open_index": f"""WITH {_DESCRIBED}, {Q.FIELD_OF} SELECT work, any_value(field) AS field, CAST(count(*) AS INT) AS descriptions, sha256(string_agg(model || ': ' || text, ' | ' ORDER BY model, text)) AS said
FROM rws LEFT JOIN field_of USING (work) GROUP BY work""",
    "known_twin_retrieval": f"WITH {_GOLD} SELECT query, ap, first FROM ap",
    "family_bootstrap": f"""WITH {_GOLD}, fm AS (SELECT family, sum(ap) AS s, count(*) AS n FROM ap JOIN g ON g.work = query WHERE family IS NOT NULL GROUP BY family),
nr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY family) AS rank, count(*) OVER () AS k FROM fm),
pk AS (SELECT d, CAST('0x' || left(sha256('2025|' || d || '|' || i.rank), 8) AS BIGINT) % k + 1 AS rank FROM range(2000) r(d), nr i), mp AS (SELECT d, sum(s) / sum(n) AS map FROM pk JOIN nr USING (rank) GROUP BY d)
SELECT count(*) AS draws, round(quantile_cont(map, 0.025), 6) AS low, round(quantile_cont(map, 0.5), 6) AS median, round(quantile_cont(map, 0.975), 6) AS high FROM mp""",
    "retrieval_summary": f"""WITH {_GOLD}, e AS (SELECT ap.*, m.method_named IS NULL AS unnamed FROM ap JOIN g m ON m.work = query)
SELECT 'all' AS subset, count(*) AS queries, round(avg(ap), 6) AS map, round(avg(first), 6) AS p1 FROM e UNION ALL SELECT 'unnamed', count(*), round(avg(ap), 6), round(avg(first), 6) FROM e WHERE unnamed HAVING count(*) > 0""",
}
