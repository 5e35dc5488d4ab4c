"""The queries of the training-data operators, each over its whole tables, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.llm import components, consensus, formatdups, leakage, mixing, similar, splitting, termcount, topn
from driftnet.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _neighbours(spark: SparkSession, d: str, **how) -> DataFrame:
    texts = similar.paper_texts(table(spark, d, "abstracts"), table(spark, d, "descriptions"))
    return similar.most_similar(texts, k=5, least=4, **how)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = _neighbours(spark, d, least_cosine=0.53)
    return near.select(F.least("work", "neighbour").alias("work_a"), F.greatest("work", "neighbour").alias("work_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every paper's five nearest, whatever their cosine, by the index."""
    return _neighbours(spark, d)


def p1_searched(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest among all papers of every paper whose id is divisible by 50, exactly."""
    return _neighbours(spark, d, exact=True, asked=F.substring("work", 2, 20).cast("bigint") % 50 == 0)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_neighbours_and_references(table(spark, d, "neighbours"), table(spark, d, "records"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return termcount.count_terms(table(spark, d, "abstracts"), table(spark, d, "descriptions")).marked(3, 0.12)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter("mark is not null").select("term", "mark")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("term", "occurrences", "records", "mark")


def p3_updated(spark: SparkSession, d: str) -> DataFrame:
    """Counts kept through updates: abstracts and approaches are loaded, each approach is changed to its row's
    problem, and abstracts without a year, or of one before 2010, are deleted. Only differences are counted."""
    abstracts, said = table(spark, d, "abstracts"), table(spark, d, "descriptions")
    kept = abstracts.filter("year >= 2010")
    text = lambda df, c: df.select(F.col(c).alias("text"))
    state = termcount.TermCounts(spark, least=3)
    state.apply(text(abstracts, "abstract").unionByName(text(said, "approach")))
    state.apply(text(said, "problem"), text(said, "approach"))
    state.apply(text(kept, "abstract"), text(abstracts, "abstract"))
    return state.marked(3, 0.12)


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return formatdups.collapse(table(spark, d, "descriptions"), "desc_id", ["problem", "approach"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[1]


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    labels = consensus.label_consensus(table(spark, d, "descriptions")).labels.filter("raters >= 3")
    key = F.split("item", "\x1f", 2)
    return labels.select(key[0].alias("work"), key[1].alias("facet"), "label")


def p5_models(spark: SparkSession, d: str) -> DataFrame:
    found = consensus.label_consensus(table(spark, d, "descriptions")).annotators
    return found.select("annotator", "rated", "matched", F.round("reliability", 6).alias("reliability"), F.round("weight", 6).alias("weight"), F.round("kappa", 6).alias("kappa"))


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.label_consensus(table(spark, d, "descriptions")).agreement.withColumn("alpha", F.round("alpha", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = components.twin_groups(table(spark, d, "twins"))
    return found.filter("node <> group").select(F.col("group").alias("group_work"), F.col("node").alias("work"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_runs(spark, d).select("doc_id", "work")


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of words that a document has in common with an evaluation text, from 12 words on.

    A run has no other words in it, so no gap is needed.
    """
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "gold"), least_run=12, gap=0)
    return found.filter("run >= 12").select("doc_id", "work", "run")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """All leaks, paraphrases included, with what was found of each."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "gold"))
    return found.select("doc_id", "work", "run", "lcs", "answer", F.round("cosine", 3).alias("cosine"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares.filter("capped").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split(table(spark, d, "documents"), oversized_only=True)
    return pieces.filter("piece = 1").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents"))


def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each text put together again: their bytes without what repeats, and whether all are within the limit."""
    pieces = splitting.split(table(spark, d, "documents"))
    own = F.substring(F.col("text").cast("binary"), F.col("repeated") + 1, F.octet_length("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex(own).alias("b")))), lambda x: x.b), "")  # a text's own pieces
    each = pieces.groupBy("doc_id").agg(joined.alias("b"), F.max("tokens").alias("most"), F.min(F.when(F.col("piece") > 1, F.col("repeated"))).alias("again"))
    return each.select("doc_id", F.sha2(F.unhex("b"), 256).alias("text"), (F.col("most") <= 2048).alias("within"), (F.coalesce("again", F.lit(1)) > 0).alias("overlap"))


def queries() -> dict[str, Query]:
    named = [p1_found, p1_neighbours, p1_searched, p2_found, p3_found, p3_counts, p3_updated, p4_found, p4_classes, p5_found, p5_models, p5_agreement, p6_found, p7_found, p7_runs, p7_leaks, p8_found, p8_mix, p8_shares, p9_found, p9_pieces, p9_cover]
    return {f.__name__: f for f in named}


_P1 = r"""
WITH texts AS (SELECT work, abstract AS t FROM abstracts UNION ALL SELECT work, problem FROM descriptions UNION ALL SELECT work, approach FROM descriptions),
w AS MATERIALIZED (SELECT DISTINCT work, unnest(regexp_extract_all(lower(t), '\p{L}{4,}')) AS word FROM texts WHERE work IS NOT NULL AND t IS NOT NULL),
n AS (SELECT work, count(*) AS n FROM w GROUP BY work),
s AS (SELECT a.work AS a, b.work AS b, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.work <> b.work GROUP BY ALL),
x AS (SELECT a, b, c / sqrt(na.n * nb.n) AS cosine FROM s JOIN n na ON na.work = a JOIN n nb ON nb.work = b),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM x)
"""

_P3 = r"""
WITH r AS (SELECT abstract AS t FROM abstracts WHERE abstract IS NOT NULL UNION ALL SELECT problem FROM descriptions WHERE problem IS NOT NULL),
k AS (SELECT row_number() OVER () AS id, t FROM r),
w AS (SELECT id, unnest(regexp_extract_all(lower(t), '\p{L}{3,}')) AS term FROM k),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM w GROUP BY term),
m AS (SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.12::DOUBLE * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)
"""

_P4 = r"""
WITH c AS (SELECT desc_id, regexp_replace(lower(problem), '[^\p{L}\p{N}]+', '', 'g') AS p, regexp_replace(lower(approach), '[^\p{L}\p{N}]+', '', 'g') AS q FROM descriptions WHERE desc_id IS NOT NULL),
k AS (SELECT desc_id, CASE WHEN length(p) >= 3 AND length(q) >= 3 THEN least(p, q) || chr(31) || greatest(p, q) ELSE 'alone ' || desc_id END AS key FROM c),
g AS (SELECT desc_id, min(desc_id) OVER (PARTITION BY key) AS keep_id FROM k)
"""


_P7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT work, row_number() OVER () AS g, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT coalesce(work, '') AS work, text FROM gold WHERE text IS NOT NULL)),
gg AS (SELECT work, g, i AS j, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT work, g, w, unnest(range(1, len(w) - 10)) AS i FROM g)),
dd AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
m AS (SELECT DISTINCT doc_id, work, g, i, j FROM dd JOIN gg USING (s))"""


def _p5(rounds: int = 20) -> str:
    """The rounds of reweighted voting written out, more than it takes the weights to become stable."""
    trim = r"[\s\p{Z}\p{Cc}]+"
    out = rf"""
WITH f AS (SELECT work, coalesce(model.provider, '') || '/' || coalesce(model.id, '') AS annotator, unnest(descriptions) AS d FROM descriptions WHERE model IS NOT NULL AND work IS NOT NULL),
c AS (SELECT work, d.facet AS scope, work || chr(31) || d.facet AS item, annotator, regexp_replace(lower(d.label), '^{trim}|{trim}$', '', 'g') AS label FROM f WHERE d.facet IS NOT NULL),
e AS (SELECT work, scope, item, annotator, label, count(*) AS n FROM c WHERE label <> '' GROUP BY ALL),
rt AS MATERIALIZED (SELECT work, scope, item, annotator, arg_min(label, (-n, label)) AS label FROM e GROUP BY ALL),
k AS (SELECT greatest(2.0, count(*) / greatest(1, count(DISTINCT scope)))::DOUBLE AS k FROM (SELECT DISTINCT scope, label FROM rt)),
w0 AS (SELECT DISTINCT annotator, 1.0::DOUBLE AS weight FROM rt)"""
    for i in range(1, rounds + 1):
        out += f""",
v{i} AS (SELECT item, label, round(sum(weight), 9) AS t FROM rt JOIN w{i - 1} USING (annotator) GROUP BY item, label),
r{i} AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY t DESC, label) AS r FROM v{i}),
l{i} AS MATERIALIZED (SELECT item, max(label) FILTER (r = 1) AS best, max(t) FILTER (r = 1) AS t1, max(label) FILTER (r = 2) AS next, max(t) FILTER (r = 2) AS t2 FROM r{i} GROUP BY item),
m{i} AS (SELECT annotator, CASE WHEN label <> best THEN 0 WHEN round(t1 - weight, 9) <= 0 AND next IS NULL THEN NULL WHEN round(t1 - weight, 9) > 0 AND (next IS NULL OR round(t1 - weight, 9) > t2
 OR (round(t1 - weight, 9) = t2 AND best < next)) THEN 1 ELSE 0 END AS m FROM rt JOIN w{i - 1} USING (annotator) JOIN l{i} USING (item)),
w{i} AS MATERIALIZED (SELECT annotator, count(m) AS rated, coalesce(sum(m), 0) AS matched, (coalesce(sum(m), 0) + 1) / (count(m) + 2) AS reliability,
 greatest(0.01, ln((coalesce(sum(m), 0) + 1) / (count(m) + 2) * ((SELECT k FROM k) - 1) / (1 - (coalesce(sum(m), 0) + 1) / (count(m) + 2)))) AS weight FROM m{i} GROUP BY annotator)"""
    return out + f""",
w AS (SELECT * FROM w{rounds}),
t AS MATERIALIZED (SELECT work, scope, item, label, round(sum(weight), 9) AS t, count(*) AS n FROM rt JOIN w USING (annotator) GROUP BY ALL)"""


_P5_MODELS = """, o AS (SELECT annotator, scope, label, count(*) AS c FROM rt GROUP BY ALL), h AS (SELECT scope, label, sum(c) AS w FROM o GROUP BY ALL), a AS (SELECT scope, sum(w) AS t FROM h GROUP BY scope),
x AS (SELECT annotator, sum(c * w / t) / sum(c) AS e FROM o JOIN h USING (scope, label) JOIN a USING (scope) GROUP BY annotator)
SELECT annotator, rated, CAST(matched AS BIGINT) AS matched, round(reliability, 6) AS reliability, round(weight, 6) AS weight, round(CASE WHEN e < 1 AND rated > 0 THEN (matched / rated - e) / (1 - e) END, 6) AS kappa FROM w JOIN x USING (annotator)"""
_P5_AGREEMENT = """, s AS (SELECT scope, item, sum(n) AS m, sum(n * (n - 1)) AS same FROM t GROUP BY ALL HAVING sum(n) > 1),
o AS (SELECT scope, count(*) AS items, CAST(sum(m) AS BIGINT) AS ratings, sum(same / (m - 1)) AS same FROM s GROUP BY scope),
u AS (SELECT t.scope, label, sum(n) AS c FROM t WHERE item IN (SELECT item FROM s) GROUP BY ALL), p AS (SELECT scope, sum(c * (c - 1)) AS pairs FROM u GROUP BY scope)
SELECT scope, items, ratings, round(1 - (1 - same / ratings) / (1 - pairs / (ratings * (ratings - 1))), 6) AS alpha, true AS stable FROM o JOIN p USING (scope)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT DISTINCT least(a, b) AS work_a, greatest(a, b) AS work_b FROM r WHERE rank <= 5 AND cosine >= 0.53",
        "p1_searched": _P1 + "SELECT a AS work, b AS neighbour, cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5 AND CAST(substr(a, 2) AS BIGINT) % 50 = 0",
        "p2_found": """
WITH n AS (SELECT work AS g, unnest(neighbours) AS c FROM neighbours),
z AS (SELECT topic || ':' || "freeze" AS g, unnest(instrument) AS item, unnest(instrument_cites) AS v FROM records),
x AS (SELECT 'neighbours' AS scope, g, c.work AS item, c.similarity AS v, 5 AS k FROM n WHERE c.work <> g
      UNION ALL SELECT 'instrument', g, item, CAST(v AS DOUBLE), 10 FROM z),
b AS (SELECT scope, g, item, max(v) AS v, k FROM x WHERE g IS NOT NULL AND item IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, g ORDER BY v DESC, item) AS pos FROM b)
SELECT scope, g AS group_key, CAST(pos AS INT) AS pos, item FROM r WHERE pos <= k""",
        "p3_found": _P3 + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p3_counts": _P3 + "SELECT term, occurrences, records, mark FROM m",
        "p3_updated": _P3.replace("WHERE abstract IS NOT NULL", "WHERE abstract IS NOT NULL AND year >= 2010") + "SELECT term, occurrences, records, mark FROM m",
        "p4_found": _P4 + "SELECT keep_id, desc_id AS copy_id FROM g WHERE desc_id <> keep_id",
        "p4_classes": _P4 + "SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id",
        "p5_found": _p5() + """, y AS (SELECT work, scope AS facet, arg_min(label, (-t, label)) AS label, sum(n) AS raters FROM t GROUP BY ALL)
SELECT work, facet, label FROM y WHERE raters >= 3""",
        "p5_models": _p5() + _P5_MODELS,
        "p5_agreement": _p5() + _P5_AGREEMENT,
        "p6_found": r"""
WITH RECURSIVE t AS (SELECT unnest(twins) AS x FROM twins),
p AS (SELECT nullif(upper(trim(x.a.work)), '') AS a, nullif(upper(trim(x.b.work)), '') AS b FROM t),
e AS MATERIALIZED (SELECT DISTINCT a AS u, b AS v FROM p WHERE a <> b UNION SELECT DISTINCT b, a FROM p WHERE a <> b),
reach AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON e.u = r.seen),
g AS (SELECT node, min(seen) AS group_work FROM reach GROUP BY node)
SELECT group_work, node AS work FROM g WHERE node <> group_work""",
        "p7_found": _P7 + "SELECT DISTINCT doc_id, work FROM m",
        "p7_runs": _P7 + """, k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, g, i - j ORDER BY i) AS island FROM m)
SELECT doc_id, work, CAST(max(n) AS INT) AS run FROM (SELECT doc_id, work, count(*) + 11 AS n FROM k GROUP BY doc_id, g, work, i - j, island) GROUP BY doc_id, work""",
        "p9_cover": "SELECT doc_id, sha256(text) AS text, true AS within, true AS overlap FROM documents WHERE text <> ''",
    }
