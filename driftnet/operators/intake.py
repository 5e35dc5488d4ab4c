"""Validation of submissions, unit states, progress. Batch functions; streaming/ calls them per micro-batch."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.functions import text as T

TOPIC, WORK = r"^T[0-9]+$", r"^W[0-9]+$"
MOST_BYTES = 5_000_000


def first_fault(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that is broken; null if none is. A rule that comes out null is broken."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules])


def counts_ok(c: str) -> Column:
    """A map of topic ids to counts of 0 or more, none of them null."""
    return F.col(c).isNotNull() & F.forall(F.map_entries(c), lambda e: e.key.rlike(TOPIC) & F.coalesce(e.value >= 0, F.lit(False)))


def years_ok(c: str, first: Column, last: Column) -> Column:
    """A map of years within first..last to counts of 0 or more, none of them null."""
    return F.forall(F.map_entries(c), lambda e: e.key.rlike("^[0-9]+$") & e.key.cast("int").between(first, last) & F.coalesce(e.value >= 0, F.lit(False)))


def ids_ok(c: str, pattern: str, most: int) -> Column:
    """At most so many ids of a kind, none of them null."""
    return (F.size(c) <= most) & F.forall(c, lambda w: F.coalesce(w.rlike(pattern), F.lit(False)))


def record_rules(fmt: int = 1, most_references: int = 100, most_abstracts: int = 40) -> dict[str, tuple[Column, str]]:
    """What each column of a record must be: (condition, how a breach is told)."""
    f = F.col("freeze")
    total = F.aggregate(F.map_values("works_by_year"), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)))
    counts = {f"cited_by_{w}": (counts_ok(f"cited_by_{w}"), "counts of topics") for w in ("before", "recent", "train")}
    return counts | {
        "format": (F.col("format") == fmt, f"format {fmt}"),
        "freeze": (f.isNotNull(), "a year"),
        "instrument": (ids_ok("instrument", WORK, most_references), f"up to {most_references} ids of works"),
        "recent_window": (F.col("recent_window") == F.array(f - 2, f), "the three years up to the freeze"),
        "topic": (F.col("topic").rlike(TOPIC), "the id of a topic"),
        "train_window": (F.col("train_window") == F.array(f - 7, f), "the eight years up to the freeze"),
        "usable_abstracts": (F.col("usable_abstracts").between(0, most_abstracts), f"a number up to {most_abstracts}"),
        "works_by_year": (years_ok("works_by_year", f - 7, f), "counts of the train window's years"),
        "size": (F.col("size") == total, "the sum of the years' counts"),
    }


def record_fault(**rules: int) -> Column:
    """What is wrong with a record, `<column> isn't <what it must be>` of the first rule it breaks, or null.

    A null list or map breaks its rule; so does a null within works_by_year or a window's counts.
    """
    return first_fault([(ok, f"{column} isn't {what}") for column, (ok, what) in record_rules(**rules).items()])


def description_fault(most_words: int = 60, least_words: int = 4) -> Column:
    """What is wrong with a description row on its own, or null."""
    p, a = T.word_count(F.col("problem")), T.word_count(F.col("approach"))
    placeholder = F.lower(T.squeeze(F.concat_ws(" ", "problem", "approach"))).rlike(r"(^|[^a-z])(n/a|todo|tbd|lorem ipsum|placeholder)([^a-z]|$)")
    return first_fault([
        (F.col("work").rlike(WORK), "work is no work ID"),
        (F.col("author").isNotNull(), "no author"),
        (F.col("model.id").isNotNull() & F.col("model.provider").isNotNull(), "no model"),
        (F.col("problem").isNotNull() & F.col("approach").isNotNull(), "a part is missing"),
        ((p >= least_words) & (a >= least_words), "a part is too short"),
        ((p <= most_words) & (a <= most_words), "a part is too long"),
        (~placeholder, "a placeholder"),
    ])


def likeness(a: Counter, b: Counter) -> float:
    """Cosine of content-word counts; 0 if either has none."""
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    size = (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
    return dot / size if size else 0.0


def near_duplicates(rows: DataFrame, group: str, order: str, text: str, most: float = 0.8, stops: list[str] = T.STOP_WORDS) -> DataFrame:
    """rows (group, order) with `repeats`: the order of the first accepted earlier row of the group that is
    alike beyond `most`, else null. A rejected row is no reason to reject a later one, so this is a fold;
    groups are units of a few rows. Null texts are accepted and like nothing.
    """
    word, stop = re.compile(r"[^\W\d_]+"), frozenset(stops)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, out = pdf.sort_values(order), [], []
        for o, t in zip(pdf[order], pdf[text]):
            c = Counter(w for w in word.findall((t or "").lower()) if w not in stop)
            hit = next((p for p, d in taken if likeness(c, d) > most), None)
            out.append(hit)
            if hit is None:
                taken.append((o, c))
        return pd.DataFrame({group: pdf[group], order: pdf[order], "repeats": pd.array(out, dtype="Int64")})

    slim = rows.select(group, F.col(order).cast("bigint").alias(order), text)
    return slim.groupBy(group).applyInPandas(fold, f"{group} string, {order} bigint, repeats bigint")


def received_order(issue: str = "issue") -> list[Column]:
    """Issues by number first, then imports by name."""
    number = F.col(issue).try_cast("bigint") if hasattr(Column, "try_cast") else F.expr(f"try_cast({issue} AS bigint)")
    return [number.isNull().cast("int"), F.coalesce(number, F.lit(0)), F.col(issue)]


def submissions(rows: DataFrame) -> DataFrame:
    """(unit, issue, author, model, works, arrived): one row per unit and issue; author and model are those given
    first, by arrival then desc_id, nulls last."""
    model = F.when(F.col("model.id").isNotNull(), T.model_name(F.col("model")))
    known = rows.filter("unit is not null and issue is not null").withColumn("m", model)
    at = F.struct("arrived", "desc_id")
    return known.groupBy("unit", "issue").agg(
        F.min_by("author", F.when(F.col("author").isNotNull(), at)).alias("author"), F.min_by("m", F.when(F.col("m").isNotNull(), at)).alias("model"),
        F.countDistinct("work").alias("works"), F.min("arrived").alias("arrived"),
    )


def unit_states(subs: DataFrame, quorum: int = 2) -> DataFrame:
    """(unit, status, models, accepted, refused) after all submissions (unit, issue, model), in the order received.

    A unit needs results of `quorum` different models. The first submission of each model is accepted
    until the quorum is full; the same model again is refused, and so is what comes after. Written as
    windows: a submission's model is new if it is the first of its unit's rows with that model, and
    it is in time if fewer than quorum new models came before.
    """
    order = received_order()
    seq = subs.filter("model is not null").withColumn("n", F.row_number().over(W.partitionBy("unit").orderBy(*order)))
    new = seq.withColumn("new", (F.row_number().over(W.partitionBy("unit", "model").orderBy("n")) == 1).cast("int"))
    before = F.coalesce(F.sum("new").over(W.partitionBy("unit").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    judged = new.withColumn("ok", ((F.col("new") == 1) & (before < quorum)).cast("int"))
    states = judged.groupBy("unit").agg(F.sum("ok").alias("accepted"), F.sum(1 - F.col("ok")).alias("refused"), F.array_sort(F.collect_set(F.when(F.col("ok") == 1, F.col("model")))).alias("models"))
    status = F.when(F.col("accepted") >= quorum, "done").when(F.col("accepted") > 0, "check").otherwise("open")
    return states.select("unit", status.alias("status"), "models", "accepted", "refused")


def drift(first: DataFrame, second: DataFrame, keys: list[str], overlap: float = 0.9, absolute: int = 5, share: float = 0.05) -> DataFrame:
    """(keys, jaccard, a, b, agrees): whether two results for the same topics agree within the drift of a live index."""
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda x, y: x + F.coalesce(y, F.lit(0)))
    slim = lambda df, s: df.select(*keys, F.coalesce("instrument", F.array().cast("array<string>")).alias(f"i{s}"), F.coalesce(total("cited_by_train"), F.lit(0)).alias(s))
    both = slim(first, "a").join(slim(second, "b"), keys)
    jaccard = F.size(F.array_intersect("ia", "ib")) / F.greatest(F.size(F.array_union("ia", "ib")), F.lit(1))
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(float(absolute)), F.lit(share) * F.greatest("a", "b"))
    return both.select(*keys, F.round(jaccard, 6).alias("jaccard"), "a", "b", ((jaccard >= overlap) & near).alias("agrees"))


def map_unit_states(results: DataFrame) -> DataFrame:
    """(unit, status, outcomes) of map units from results (unit, n, author, valid, agrees) in order n.

    open: the first valid result makes it done, or check for one unit in twenty. check: the first valid
    result of another author makes it done if it agrees with the first, else disputed.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, status, first, said = pdf.sort_values("n"), "open", None, []
        for r in pdf.itertuples():
            if status in ("done", "disputed"):
                said.append("complete")
            elif not r.valid:
                said.append("invalid")
            elif status == "open":
                status, first = ("check" if r.checked else "done"), r.author
                said.append("accepted")
            elif r.author == first:
                said.append("another volunteer is needed")
            else:
                status = "done" if r.agrees else "disputed"
                said.append("accepted")
        return pd.DataFrame({"unit": [pdf["unit"].iloc[0]], "status": [status], "outcomes": [said]})

    flagged = results.withColumn("checked", T.needs_check(F.col("unit")))
    return flagged.groupBy("unit").applyInPandas(walk, "unit string, status string, outcomes array<string>")


def contributors(rows: DataFrame, who: str) -> DataFrame:
    """(name, units, descriptions) by descriptions, most first, then name; null names are left out."""
    known = rows.filter(F.col(who).isNotNull())
    return known.groupBy(F.col(who).alias("name")).agg(F.countDistinct("unit").alias("units"), F.count(F.lit(1)).alias("descriptions")).orderBy(F.desc("descriptions"), "name")


def merge_contributors(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, units, descriptions) of two progress tables together: a full outer join by name."""
    l, r = left.select("name", F.col("units").alias("u1"), F.col("descriptions").alias("d1")), right.select("name", F.col("units").alias("u2"), F.col("descriptions").alias("d2"))
    plus = lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    return l.join(r, "name", "full_outer").select("name", plus("u1", "u2").alias("units"), plus("d1", "d2").alias("descriptions"))


def latest_rejections(faulty: DataFrame, limit: int = 500) -> DataFrame:
    """The latest rejections, imports last in arrival so first here."""
    a, b, c = received_order()
    return faulty.orderBy(a.desc(), b.desc(), c.desc(), F.desc("desc_id")).limit(limit)


def relevance(rows: DataFrame, abstracts: DataFrame, top: float = 0.15, least: int = 4) -> DataFrame:
    """(unit, issue, known, relevance): share of a result's descriptions that find their own paper's abstract in the top share.

    rows (unit, issue, desc_id, work, text), abstracts (work, abstract), one row a work. TF-IDF is over
    the result's own abstracts and descriptions. Null below `least` known abstracts. Python's rounding
    half to even gives the size of the top.
    """
    from driftnet.operators import vectors as V

    key = F.concat_ws("\x1f", "unit", "issue")
    known = session.stage(rows.join(abstracts.filter("abstract is not null and abstract <> ''"), "work").withColumn("r", key), "known")
    said = known.select("r", F.concat_ws("\x1f", F.lit("d"), "r", F.col("desc_id").cast("string")).alias("id"), "text")
    own = known.select("r", F.concat_ws("\x1f", F.lit("a"), "r", F.col("desc_id").cast("string")).alias("id"), F.col("abstract").alias("text"))
    tf = V.doc_terms(said.unionByName(own), "id", T.without(T.tokens(F.col("text")), list(T.STOP_WORDS)), "r")
    n = known.groupBy("r").agg(F.count(F.lit(1)).alias("k"))
    df = tf.groupBy("r", "term").agg(F.count(F.lit(1)).alias("df"))
    raw = (1 + F.log("tf")) * (F.log((1 + 2 * F.col("k")) / (1 + F.col("df"))) + 1)
    w = tf.join(df, ["r", "term"]).join(n, "r").select("r", "doc", "term", raw.alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc")))  # a text's own terms
    w = session.stage(w.select("r", "doc", "term", (F.col("w") / length).alias("w")), "weights")
    d = w.filter("doc like 'd%'").select("r", "term", F.col("doc").alias("d"), F.col("w").alias("wd"))
    a = w.filter("doc like 'a%'").select("r", "term", F.col("doc").alias("a"), F.col("w").alias("wa"))
    sims = session.stage(d.join(a, ["r", "term"]).groupBy("r", "d", "a").agg(F.round(F.sum(F.col("wd") * F.col("wa")), 9).alias("s")), "likeness")
    mine = F.substring("d", 2, 10_000) == F.substring("a", 2, 10_000)
    own = sims.groupBy("r", "d").agg(F.coalesce(F.max(F.when(mine, F.col("s"))), F.lit(0.0)).alias("own"))
    ahead = sims.join(own, ["r", "d"]).groupBy("r", "d").agg(F.count_if(F.col("s") > F.col("own")).alias("ahead"))
    hits = n.join(ahead, "r", "left").groupBy("r", "k").agg(F.sum((F.col("ahead") < F.greatest(F.lit(1), F.bround(F.lit(top) * F.col("k")))).cast("int")).alias("hits"))
    parts = F.split("r", "\x1f")
    return hits.select(parts[0].alias("unit"), parts[1].alias("issue"), F.col("k").alias("known"), F.when(F.col("k") >= least, F.round(F.coalesce("hits", F.lit(0)) / F.col("k"), 6)).alias("relevance"))


def parse_submissions(issues: DataFrame) -> DataFrame:
    """(issue, author, unit, prompt, model, descriptions, fault) from issues (issue, author, body)."""
    schema = "unit string, prompt string, model struct<provider:string,id:string>, descriptions array<struct<work:string,problem:string,approach:string>>"
    block = T.json_block(F.col("body"))
    parsed = issues.withColumn("block", block).withColumn("x", F.from_json("block", schema, {"mode": "PERMISSIVE"}))
    fault = first_fault([
        (F.col("block").isNotNull(), "no fenced JSON block"),
        (F.octet_length("block") <= MOST_BYTES, "the result is too large"),
        (F.try_parse_json("block").isNotNull(), "the block is not JSON"),
        (F.col("x.unit").isNotNull(), "no unit"),
        (F.size("x.descriptions") > 0, "no descriptions"),
    ])
    return parsed.select("issue", "author", "x.unit", "x.prompt", "x.model", "x.descriptions", fault.alias("fault"))


def content_fault(content: Column, most: int = MOST_BYTES) -> Column:
    """What is wrong with a submitted file's content before it is parsed, or null."""
    return F.when(content.isNull(), "no content").when(content == "", "nothing in it").when(F.octet_length(content) > most, f"larger than {most} bytes")


def progress_rows(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(kind, name, units, descriptions): units by status; results and descriptions of each contributor and model; works
    described and descriptions in all. `units` counts results, or works in the last row."""
    done = F.struct("unit", "issue")
    parts = [states.groupBy(F.lit("units").alias("kind"), F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("units"), F.lit(None).cast("bigint").alias("descriptions"))]
    for kind, name in (("contributor", F.col("author")), ("model", T.model_name(F.col("model")))):
        parts.append(rows.filter(name.isNotNull()).groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.countDistinct(done).alias("units"), F.count(F.lit(1)).alias("descriptions")))
    parts.append(rows.agg(F.countDistinct("work").alias("units"), F.count(F.lit(1)).alias("descriptions")).select(F.lit("total").alias("kind"), F.lit("papers described").alias("name"), "units", "descriptions"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def bridge_ratings(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(bridge, ratings, mean, weighted) of ratings (a, b, rating, expertise): plain and by the rater's expertise;
    an expertise that isn't listed weighs 1."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("expertise")), F.lit(1.0))
    return rows.groupBy(T.bridge_id(F.col("a"), F.col("b")).alias("bridge")).agg(F.count(F.lit(1)).alias("ratings"), F.avg("rating").alias("mean"), (F.sum(F.col("rating") * w) / F.sum(w)).alias("weighted"))


def shrunk_weights(judged: DataFrame, prior: float = 1.0) -> DataFrame:
    """(model, judged, hits, weight) from rows (model, hit): the log odds of a model's share of hits, drawn towards one
    half by `prior` hits and misses, so that an untried model weighs nothing."""
    n, h = F.count(F.lit(1)), F.sum("hit")
    return judged.groupBy("model").agg(n.alias("judged"), h.cast("bigint").alias("hits"), F.log((h + prior) / (n - h + prior)).alias("weight"))


@dataclass(frozen=True)
class SubmissionRules:
    prompt: str | None = None
    most_avoided: int = 2
    most_alike: float = 0.8
    least_covered: float = 0.75
    least_relevant: float = 0.5
    quorum: int = 2


def alike_within(rows: DataFrame, group: str, text: str, most: float, stops: list[str] = T.STOP_WORDS) -> DataFrame:
    """(group) of groups in which two texts' content words are alike beyond `most`, by cosine of their counts.

    rows (group, desc_id, text). Groups are results of a unit's few papers; keep others out before.
    """
    words = T.without(T.words(F.col(text)), stops)
    tf = rows.select(group, "desc_id", F.explode(words).alias("term")).groupBy(group, "desc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    tf = tf.withColumn("len", F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(group, "desc_id")).cast("double")))
    x = tf.select(group, "term", F.col("desc_id").alias("x"), F.col("n").alias("nx"), F.col("len").alias("lx"))
    y = tf.select(group, "term", F.col("desc_id").alias("y"), F.col("n").alias("ny"), F.col("len").alias("ly"))
    both = x.join(y, [group, "term"]).filter("x < y").groupBy(group, "x", "y").agg((F.sum(F.col("nx") * F.col("ny")) / F.first(F.col("lx") * F.col("ly"))).alias("c"))
    return both.filter(F.round("c", 9) > most).select(group).distinct()


def checked_results(rows: DataFrame, works: DataFrame, avoid: DataFrame, abstracts: DataFrame, rules: SubmissionRules = SubmissionRules()) -> DataFrame:
    """(unit, issue, author, model, described, relevance, fault): each result (unit, issue) with what is wrong with it, or null.

    rows: one description each (unit, issue, desc_id, work, author, model, problem, approach, arrived, and
    prompt if the rules name one); works (unit, work): the papers of each unit; avoid (work, avoid): words a
    description may use most_avoided of; abstracts (work, abstract), one a work. A result is whole or
    nothing: one bad description refuses it. Faults in order: prompt, a paper that isn't the unit's, one
    described twice, a description's own fault, avoided words, two descriptions alike, too few papers
    described, descriptions that don't find their own papers' abstracts. Rows without a unit or issue
    are of no result.
    """
    r = F.concat_ws("\x1f", "unit", "issue").alias("r")
    rows = session.stage(rows.filter("unit is not null and issue is not null").withColumn("own", description_fault()).select("*", r), "submitted")
    member = works.select("unit", "work", F.lit(1).alias("member"))
    used = F.size(T.avoided(F.concat_ws(" ", "problem", "approach"), F.coalesce("avoid", F.array().cast("array<string>"))))
    each = rows.join(member, ["unit", "work"], "left").join(avoid.select("work", "avoid"), "work", "left").withColumn("used", used)
    prompt = F.count_if(F.lit(False)) if rules.prompt is None else F.count_if(~F.coalesce(F.col("prompt") == rules.prompt, F.lit(False)))
    per = each.groupBy("r", "unit", "issue").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("work").alias("described"), F.count_if(F.col("member").isNull()).alias("strange"), prompt.alias("prompts"),
        F.min_by("own", F.when(F.col("own").isNotNull(), F.col("desc_id"))).alias("own"), F.max("used").alias("used"), F.min("arrived").alias("arrived"),
    )
    per = session.stage(per.join(submissions(rows).select("unit", "issue", "author", "model"), ["unit", "issue"]), "results")
    few = per.filter("strange = 0 and n = described").select("r")  # so none has more rows than its unit has papers
    alike = alike_within(rows.join(few, "r", "left_semi").select("r", "desc_id", F.concat_ws(" ", "problem", "approach").alias("text")), "r", "text", rules.most_alike).withColumn("alike", F.lit(1))
    found = relevance(rows.filter("work is not null").select("unit", "issue", "desc_id", "work", F.concat_ws(" ", "problem", "approach").alias("text")), abstracts).select("unit", "issue", "relevance")
    size = works.groupBy("unit").agg(F.countDistinct("work").alias("papers"))
    told = per.join(alike, "r", "left").join(found, ["unit", "issue"], "left").join(size, "unit", "left")
    fault = first_fault([
        (F.col("prompts") == 0, "made with another prompt"), (F.col("strange") == 0, "a paper isn't the unit's"), (F.col("n") == F.col("described"), "a paper is described twice"),
        (F.col("own").isNull(), "a description is at fault"), (F.col("used") <= rules.most_avoided, "too many avoided words"), (F.col("alike").isNull(), "two descriptions are alike"),
        (F.col("described") >= rules.least_covered * F.coalesce("papers", F.lit(0)), "too few papers are described"), (F.coalesce("relevance", F.lit(1.0)) >= rules.least_relevant, "descriptions of other papers"),
    ])
    return told.select("unit", "issue", "author", "model", "described", "relevance", fault.alias("fault"))


def outcomes(results: DataFrame, quorum: int = 2) -> DataFrame:
    """(unit, issue, outcome, reason) of results (unit, issue, model, fault) in the order received.

    complete: the unit had results of `quorum` models before. refused: the result's fault, or its model's
    result is there already. stored: all others. A result without a model is refused.
    """
    order = received_order()
    seq = results.withColumn("n", F.row_number().over(W.partitionBy("unit").orderBy(*order)))
    ok = F.col("fault").isNull() & F.col("model").isNotNull()
    first = F.min(F.when(ok, F.col("n"))).over(W.partitionBy("unit", "model"))
    new = seq.withColumn("new", (ok & (F.col("n") == first)).cast("int"))
    before = F.coalesce(F.sum("new").over(W.partitionBy("unit").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    said = new.withColumn("before", before)
    outcome = F.when(F.col("before") >= quorum, "complete").when(F.col("new") == 1, "stored").otherwise("refused")
    reason = F.when(outcome == "refused", F.coalesce("fault", F.when(F.col("model").isNull(), "no model").otherwise("the unit has a result of this model")))
    return said.select("unit", "issue", outcome.alias("outcome"), reason.alias("reason"))


def import_batch(results: DataFrame, stored: DataFrame, batch: str, quorum: int = 2) -> DataFrame:
    """(id, unit, model, accepted, reason): results of a batch (unit, file, model, fault) through the same rules, after the
    stored ones (unit, issue, model), under names import-<batch>-<n> in order of their files."""
    numbered = results.withColumn("n", F.row_number().over(W.orderBy("file", "unit")))  # a batch is what one person brings
    named = numbered.withColumn("issue", F.format_string(f"import-{batch}-%03d", "n"))
    both = stored.select("unit", "issue", "model", F.lit(None).cast("string").alias("fault")).unionByName(named.select("unit", "issue", "model", "fault"))
    told = outcomes(both, quorum)
    return named.join(told, ["unit", "issue"]).select(F.col("issue").alias("id"), "unit", "model", (F.col("outcome") == "stored").alias("accepted"), F.coalesce("reason", F.when(F.col("outcome") == "complete", "the unit is complete")).alias("reason"))


def checked_record_results(results: DataFrame, units: DataFrame, fmt: int = 1) -> DataFrame:
    """(result, unit, fault) of results (result, unit, content, sha256) for units (unit, freeze, topics): checksum, JSON, unit and
    freeze, topics exactly and in order, then every record's own faults; the first fault by that order, or null."""
    from driftnet.sources import readers

    parsed = results.join(units.select("unit", F.col("freeze").alias("wanted"), F.col("topics").alias("expected")), "unit", "left")
    parsed = parsed.withColumn("x", F.from_json("content", f"unit string, freeze int, records array<struct<{readers.struct_of(readers.RECORD)}>>"))
    topics = F.transform("x.records", lambda r: r.topic)
    fault = first_fault([
        (F.col("expected").isNotNull(), "there is no such unit"), (F.sha2("content", 256) == F.col("sha256"), "the checksum is another"), (F.try_parse_json("content").isNotNull(), "it isn't JSON"),
        ((F.col("x.unit") == F.col("unit")) & (F.col("x.freeze") == F.col("wanted")), "it is for another unit or freeze"), (topics == F.col("expected"), "its topics aren't the unit's, in order"),
    ])
    parsed = session.stage(parsed.select("result", "unit", "x.records", fault.alias("fault")), "parsed")
    bad = parsed.filter("fault is null").select("result", F.posexplode("records").alias("at", "r")).select("result", "at", "r.*").withColumn("own", record_fault(fmt=fmt)).filter("own is not null")
    first = bad.groupBy("result").agg(F.min_by(F.concat_ws(": ", "topic", "own"), "at").alias("own"))
    return parsed.join(first, "result", "left").select("result", "unit", F.coalesce("fault", "own").alias("fault"))


def ranking_fault(ranking: Column, items: Column) -> Column:
    """What is wrong with a ranking of a unit's items, or null: each must be ranked once, and nothing else."""
    return first_fault([
        (ranking.isNotNull() & (F.size(ranking) > 0), "nothing is ranked"), (F.size(F.array_distinct(ranking)) == F.size(ranking), "an item is ranked twice"),
        (F.size(F.array_except(ranking, items)) == 0, "an item isn't the unit's"), (F.size(ranking) == F.size(F.array_distinct(items)), "an item isn't ranked"),
    ])


def rehearsal(papers: DataFrame, words: int = 8) -> DataFrame:
    """(kind, work, problem, approach): for each paper (work, abstract) a sound description, of its abstract's own words, and
    a junk one, to rehearse the checks with."""
    said = F.split(T.squeeze(F.col("abstract")), " ")
    part = lambda start: F.array_join(F.slice(said, start, words), " ")
    sound = papers.select(F.lit("sound").alias("kind"), "work", part(1).alias("problem"), part(words + 1).alias("approach"))
    junk = papers.select(F.lit("junk").alias("kind"), "work", F.lit("TODO fill this in later").alias("problem"), F.lit("n/a").alias("approach"))
    return sound.unionByName(junk)
