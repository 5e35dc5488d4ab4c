"""Citation records, neighbourhoods and features of topic pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.operators import content as C

WINDOWS = ("before", "train", "recent")


def latest(records: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by `order`. Rows with a null key are left out."""
    known = records
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def current_records(records: DataFrame, fmt: int = 1) -> DataFrame:
    """The latest record of the current format for each topic and freeze, ties by the record's name."""
    own = records.filter(F.col("format") == fmt)
    return latest(own, ["topic", "freeze"], [F.desc_nulls_last("retrieved"), F.col("record")])


def works_by_year(records: DataFrame) -> DataFrame:
    """(topic, freeze, year, n) from the map of counts by year; null counts are left out."""
    flat = records.select("topic", "freeze", F.explode("works_by_year").alias("year", "n"))
    return flat.select("topic", "freeze", F.col("year").cast("int").alias("year"), "n").filter("n is not null")


def citing_counts(records: DataFrame) -> DataFrame:
    """(freeze, window, cited, citing, n), one row per map entry; unknown, blank and null sides are left out."""
    parts = [records.select("freeze", F.lit(w).alias("window"), F.col("topic").alias("cited"), F.explode(f"cited_by_{w}").alias("citing", "n")) for w in WINDOWS]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.filter("n is not null and citing <> '' and lower(citing) <> 'unknown'")


def growth(records: DataFrame) -> DataFrame:
    """(topic, freeze, growth): log ratio of the last four to the first four years of the train window."""
    years = works_by_year(records).join(records.select("topic", "freeze", F.col("train_window")[0].alias("s"), F.col("train_window")[1].alias("e")), ["topic", "freeze"])
    early = F.sum(F.when(F.col("year").between(F.col("s"), F.col("s") + 3), F.col("n")).otherwise(0))
    late = F.sum(F.when(F.col("year").between(F.col("e") - 3, F.col("e")), F.col("n")).otherwise(0))
    return years.groupBy("topic", "freeze").agg(F.log((late + 1) / (early + 1)).alias("growth"))


def citation_links(works: DataFrame, references: DataFrame, instrument: DataFrame, windows: DataFrame) -> DataFrame:
    """(cited, window, citing, n): works of each topic and window that cite a topic's reference papers.

    works (work, topic, year), references (work, reference), instrument (topic, reference), windows
    (window, first, last; a null bound is open). A work counts once for a topic however many of its
    papers it cites. Windows are a few rows and joined by range; the rest are equal joins.
    """
    dated = works.join(F.broadcast(windows), (F.col("first").isNull() | (F.col("year") >= F.col("first"))) & (F.col("last").isNull() | (F.col("year") <= F.col("last"))))
    cites = references.join(instrument.withColumnRenamed("topic", "cited"), "reference").select("work", "cited").distinct()
    joined = cites.join(dated.select("work", F.col("topic").alias("citing"), "window"), "work")
    return joined.filter("citing is not null").groupBy("cited", "window", "citing").agg(F.count(F.lit(1)).alias("n"))


def reference_papers(candidates: DataFrame, first: int = 400, then: int = 100) -> DataFrame:
    """(topic, reference, cites, pos): from (topic, reference, now, asof) the `first` most cited now, of
    these the `then` most cited up to the freeze, ties by name; those never cited by then are dropped after."""
    a = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("now"), "reference"))
    b = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("asof"), "reference"))
    kept = candidates.withColumn("_a", a).filter(F.col("_a") <= first).withColumn("pos", b).filter(F.col("pos") <= then)
    return kept.filter("asof > 0").select("topic", "reference", F.col("asof").alias("cites"), "pos")


@dataclass(frozen=True)
class PairRules:
    """Which pairs are eligible, and what counts as connected."""

    most_prior: int = 1
    least_after: int = 3
    least_size: int = 0
    least_usable: int = 0


#: The domains, and the names of what a pair of topics is told by. The first pair of domains has no indicator.
DOMAINS = ("Health Sciences", "Life Sciences", "Physical Sciences", "Social Sciences")
INDICATORS = {f"{a} / {b}": f"dp_{a.split()[0].lower()}_{b.split()[0].lower()}" for a, b in list(combinations(DOMAINS, 2))[1:]}
POPULARITY = ["log_size_hi", "log_size_lo", "growth_hi", "growth_lo", "log_usable_hi", "log_usable_lo", *INDICATORS.values()]
NETWORK = ["log_deg_hi", "log_deg_lo", "log_recent_deg_hi", "log_recent_deg_lo", "log_common", "log_recent_common", "jaccard", "adamic_adar", "cocite_cosine", "log_two_hop", "prior_links"]
CONTENT = ["centroid_cos", "top_pairs_cos"]
FEATURES = POPULARITY + NETWORK + CONTENT
FEATURE_SETS = {"popularity": POPULARITY, "network": POPULARITY + NETWORK, "semantic": POPULARITY + CONTENT, "combined": FEATURES}
#: Topics a citer may cite before its pairs are spread over SPREAD tasks.
HUB, SPREAD = 1000, 16


def neighbourhoods(counts: DataFrame, sample: DataFrame, window: str) -> DataFrame:
    """(topic, citer, n): topics citing each sampled topic, without itself."""
    own = counts.filter(F.col("window") == window).join(sample.select(F.col("id").alias("cited")), "cited", "left_semi")
    return own.filter("cited <> citing").groupBy(F.col("cited").alias("topic"), F.col("citing").alias("citer")).agg(F.sum("n").alias("n"))


def degree_reach(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Degrees and norms of topics (topic, deg, norm), and how many sampled topics each citer cites (citer, reach)."""
    degree = near.groupBy("topic").agg(F.count(F.lit(1)).alias("deg"), F.coalesce(F.nullif(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")), F.lit(0.0)), F.lit(1.0)).alias("norm"))
    return degree, near.groupBy("citer").agg(F.count(F.lit(1)).alias("reach"))


def common_neighbours(near: DataFrame, domains: DataFrame) -> DataFrame:
    """(a, b, common, adamic_adar, dot) over pairs of different domains, a before b by position, that share a citer.

    The topics of a citer meet in pairs; those of one that cites more than HUB topics are spread: each
    on the left goes to one of SPREAD parts, and those on the right to all.
    """
    reach = near.groupBy("citer").agg(F.count(F.lit(1)).alias("reach"))
    placed = near.join(domains.select(F.col("id").alias("topic"), "pos", "domain"), "topic").join(reach, "citer")
    hub = F.col("reach") > HUB
    part = F.when(hub, F.pmod(F.xxhash64("topic"), F.lit(SPREAD)).cast("int")).otherwise(0).alias("part")
    parts = F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("part")
    l = placed.select("citer", part, "reach", F.col("topic").alias("a"), F.col("pos").alias("pa"), F.col("domain").alias("da"), F.col("n").alias("na"))
    r = placed.select("citer", parts, F.col("topic").alias("b"), F.col("pos").alias("pb"), F.col("domain").alias("db"), F.col("n").alias("nb"))
    both = l.join(r, ["citer", "part"]).filter("pa < pb and da <> db")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(1 / F.log(F.col("reach") + 1.0)).alias("adamic_adar"), F.sum(F.col("na") * F.col("nb")).alias("dot"))


def two_step_paths(near: DataFrame, sample: DataFrame, domains: DataFrame) -> DataFrame:
    """(a, b, paths): sampled z with a citing z and z citing b, plus those the other way, z neither a nor b."""
    ends = domains.select("id", "pos", "domain")
    inside = near.join(sample.select(F.col("id").alias("citer")), "citer", "left_semi").select("topic", "citer")
    # x cites z, z cites y: (topic z, citer x) and (topic y, citer z)
    first = inside.select(F.col("citer").alias("x"), F.col("topic").alias("z"))
    second = near.select(F.col("citer").alias("z"), F.col("topic").alias("y"))
    path = first.join(second, "z").filter("x <> y and z <> x and z <> y")
    px, py = (ends.select(F.col("id").alias(c), F.col("pos").alias(f"p{c}"), F.col("domain").alias(f"d{c}")) for c in "xy")
    placed = path.join(px, "x").join(py, "y").filter("dx <> dy")
    swap = F.col("px") < F.col("py")
    return placed.select(F.when(swap, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("paths"))


#: What is known of few pairs, or computed for all: whole numbers, then others.
COUNTS = ["p_ab", "p_ba", "common", "dot", "recent_common", "paths", "ab", "ba"]
REALS = ["adamic_adar", *CONTENT]


def _facts(key: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(ia, ib, COUNTS, REALS): what tables (a, b, some of these) say of pairs of topics numbered in key (id, idx), a before b.

    Columns named _ab and _ba change places where a comes after b. Tables may list a pair in either order.
    """
    key, parts = F.broadcast(key), []  # topics, of which there are thousands
    turned = lambda c: {"ab": "ba", "ba": "ab"}.get(c[-2:], c[-2:])
    for t in tables:
        rows = t.join(key.select(F.col("id").alias("a"), F.col("idx").alias("i")), "a").join(key.select(F.col("id").alias("b"), F.col("idx").alias("j")), "b").filter("i <> j")
        swap = F.col("i") > F.col("j")
        value = lambda c, t=t: F.when(swap, F.col(c[:-2] + turned(c))).otherwise(F.col(c)) if c.endswith(("ab", "ba")) else F.col(c)
        parts.append(rows.select(F.least("i", "j").alias("ia"), F.greatest("i", "j").alias("ib"), *[value(c).alias(c) if c in t.columns else F.lit(None).cast("bigint" if c in COUNTS else "double").alias(c) for c in COUNTS + REALS]))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("ia", "ib").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint" if c in COUNTS else "double")).alias(c) for c in COUNTS + REALS])


def _pairs_in_tiles(fit: DataFrame, n: int, cells: DataFrame | None, facts: DataFrame, most_prior: int) -> DataFrame:
    """(ia, ib, COUNTS, REALS) of every eligible pair of fit's topics (idx, pos, domain, id), n of them.

    Blocks of topics meet in pairs, with the facts of their pairs, so the pairs themselves, which are
    quadratic, are never shuffled.
    """
    blocks = C.blocks_of(n)
    own = lambda c: F.floor(F.col(c) * blocks / max(1, n)).cast("int")
    topics = fit.select("idx", F.col("pos").cast("bigint").alias("pos"), "domain", "id")
    if cells is not None:
        topics = topics.join(cells.withColumnRenamed("topic", "id"), "id", "left")
    topics = C.in_tiles(topics.drop("id"), own("idx"), blocks)
    both = topics.unionByName(facts.withColumns({"x": own("ia"), "y": own("ib")}), allowMissingColumns=True)
    texts, names = cells is not None, ["ia", "ib", *COUNTS, *REALS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        known = rows.filter(rows.column("ia").is_valid()).sort_by("ia")
        own, x, y = (np.asarray(rows.column(c).fill_null(-1)) for c in ("own", "x", "y"))
        one, two = (rows.filter(pa.array(own == side[0])).sort_by("idx") for side in (x, y))
        (ni, pi, di), (nj, pj, dj) = ((np.asarray(t.column("idx")), np.asarray(t.column("pos")), np.array(t.column("domain").to_pylist(), dtype=object)) for t in (one, two))
        if not len(ni) or not len(nj):
            return
        fa, fb = np.searchsorted(ni, np.asarray(known.column("ia"))), np.searchsorted(nj, np.asarray(known.column("ib")))
        values = {c: np.asarray(known.column(c)) for c in names[2:]}
        near = C.compared(C.Topics(one), C.Topics(two)) if texts else ((i, min(i + C.SLICE, len(ni)), None, None, None) for i in range(0, len(ni), C.SLICE))
        for i, j, centre, closest, _ in near:
            lo, hi = np.searchsorted(fa, [i, j])
            at = fa[lo:hi] - i, fb[lo:hi]
            cols = {c: np.zeros((j - i, len(nj)), dtype=np.int64 if c in COUNTS else np.float64) for c in names[2:]}
            for c, m in cols.items():
                m[at] = values[c][lo:hi]
            if texts:
                cols["centroid_cos"], cols["top_pairs_cos"] = centre, closest
            ok = (pi[i:j, None] < pj[None, :]) & (di[i:j, None] != dj[None, :]).astype(bool) & (cols["p_ab"] + cols["p_ba"] <= most_prior)
            r, c = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(ni[i:j][r]), pa.array(nj[c]), *[pa.array(m[r, c]) for m in cols.values()]], names=names)

    schema = ", ".join(["ia int", "ib int", *[f"{c} bigint" for c in COUNTS], *[f"{c} double" for c in REALS]])
    return both.groupBy("x", "y").applyInArrow(run, schema)


def pair_table(topics: DataFrame, records: DataFrame, rules: PairRules, outcome: DataFrame | None = None, usable: DataFrame | None = None, content: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Features of every eligible pair of topics of different domains, and its outcome.

    topics (pos, id, domain), records at one freeze, outcome (cited, citing, n) the counts of the years
    after, usable (topic, usable) the number of usable texts of each topic, by default the records' own,
    content (a, b, centroid_cos, top_pairs_cos) in either order, 0 where a pair isn't listed, or instead of
    it cells as from content.topic_cells, staged, which it is computed from. Rows (a, b,
    domain_pair, FEATURES, prior, ab, ba, label): a comes before b by position; ab counts works in a that
    cite b's papers; label is null without an outcome. Topics below least_size leave the sample; one with
    fewer than least_usable texts only loses its pairs. Eligibility comes before features. What several
    features need is staged: the records' counts and neighbourhoods. Pairs are neither shuffled nor staged
    here, and are made again by every reader.
    """
    records = session.stage(records, "records")
    if usable is None:
        usable = records.select("topic", F.coalesce("usable_abstracts", F.lit(0)).alias("usable"))
    sized = records.select(F.col("topic").alias("id"), F.coalesce("size", F.lit(0)).alias("size"))
    sample = topics.filter("id is not null and domain is not null").join(sized.filter(F.col("size") >= rules.least_size), "id")
    sample = session.stage(sample.join(usable.select(F.col("topic").alias("id"), "usable"), "id", "left").fillna(0, ["usable"]), "sample")
    ends = sample.select("id", "pos", "domain", "size")
    counts = session.stage(citing_counts(records), "counts")
    fit = sample.filter((F.col("usable") >= rules.least_usable) & F.col("pos").isNotNull())
    fit = session.stage(fit.withColumn("idx", F.row_number().over(W.orderBy("pos", "id")) - 1), "fit")  # topics, of which there are thousands
    before = counts.filter(F.col("window").isin("before", "train")).groupBy("cited", "citing").agg(F.sum("n").alias("n"))
    near, recent = (session.stage(neighbourhoods(counts, sample, w), w) for w in ("train", "recent"))
    degree, _ = degree_reach(near)
    recent_degree = recent.groupBy("topic").agg(F.count(F.lit(1)).alias("rdeg"))
    grown = growth(records).select("topic", "growth")
    each = fit.withColumnRenamed("id", "topic").join(degree, "topic", "left").join(recent_degree, "topic", "left").join(grown, "topic", "left")
    each = session.stage(each.fillna({"deg": 0, "norm": 1.0, "rdeg": 0, "growth": 0.0}), "each")
    directed = lambda t, ab, ba: t.select(F.col("citing").alias("a"), F.col("cited").alias("b"), F.col("n").cast("bigint").alias(ab), F.lit(0).cast("bigint").alias(ba))
    said = [
        directed(before, "p_ab", "p_ba"), common_neighbours(near, ends), two_step_paths(near, sample, ends),
        common_neighbours(recent, ends).select("a", "b", F.col("common").alias("recent_common")),
    ]
    if outcome is not None:
        said.append(directed(outcome, "ab", "ba"))
    if content is not None:
        said.append(content.select("a", "b", *CONTENT))
    facts = session.stage(_facts(fit.select("id", "idx"), said), "facts")
    pairs = _pairs_in_tiles(fit, fit.count(), cells, facts, rules.most_prior).withColumn("prior", F.col("p_ab") + F.col("p_ba"))
    for s in "ab":
        side = each.select(F.col("idx").alias(f"i{s}"), F.col("topic").alias(s), *[F.col(c).alias(f"{k}{s}") for c, k in (("domain", "d"), ("size", "s"), ("usable", "u"), ("deg", "deg_"), ("norm", "norm_"), ("rdeg", "rdeg_"), ("growth", "growth_"))])
        pairs = pairs.join(F.broadcast(side), f"i{s}")
    dp = domain_pair("da", "db")
    hi = lambda x, y: F.log1p(F.greatest(x, y).cast("double"))
    lo = lambda x, y: F.log1p(F.least(x, y).cast("double"))
    joint = F.col("deg_a") + F.col("deg_b") - F.col("common")
    features = {
        "log_size_hi": hi("sa", "sb"), "log_size_lo": lo("sa", "sb"),
        "growth_hi": F.greatest("growth_a", "growth_b"), "growth_lo": F.least("growth_a", "growth_b"),
        "log_usable_hi": F.log(F.greatest("ua", "ub", F.lit(1))), "log_usable_lo": F.log(F.greatest(F.least("ua", "ub"), F.lit(1))),
        **{name: (dp == pair).cast("double") for pair, name in INDICATORS.items()},
        "log_deg_hi": hi("deg_a", "deg_b"), "log_deg_lo": lo("deg_a", "deg_b"),
        "log_recent_deg_hi": hi("rdeg_a", "rdeg_b"), "log_recent_deg_lo": lo("rdeg_a", "rdeg_b"),
        "log_common": F.log1p(F.col("common").cast("double")), "log_recent_common": F.log1p(F.col("recent_common").cast("double")),
        "jaccard": F.when(joint > 0, F.col("common") / joint).otherwise(0.0), "adamic_adar": F.col("adamic_adar"),
        "cocite_cosine": F.col("dot") / (F.col("norm_a") * F.col("norm_b")), "log_two_hop": F.log1p(F.col("paths").cast("double")),
        "prior_links": F.col("prior").cast("double"),
    }
    pairs = pairs.withColumns(features).withColumn("domain_pair", dp)
    if outcome is not None:
        pairs = pairs.withColumn("label", (F.col("ab") + F.col("ba") >= rules.least_after).cast("int"))
    else:
        pairs = pairs.withColumns({"ab": F.lit(None).cast("bigint"), "ba": F.lit(None).cast("bigint"), "label": F.lit(None).cast("int")})
    return pairs.select("a", "b", "domain_pair", *FEATURES, "prior", "ab", "ba", "label")


def both_ways(pairs: DataFrame, counts: DataFrame, ab: str, ba: str) -> DataFrame:
    """pairs (a, b) with the counts in both directions, 0 where there are none: ab is a citing b."""
    forward = counts.select(F.col("citing").alias("a"), F.col("cited").alias("b"), F.col("n").alias(ab))
    backward = counts.select(F.col("cited").alias("a"), F.col("citing").alias("b"), F.col("n").alias(ba))
    return pairs.join(forward, ["a", "b"], "left").join(backward, ["a", "b"], "left").fillna(0, [ab, ba])


def domain_pair(a: str, b: str) -> Column:
    return F.concat_ws(" / ", F.least(a, b), F.greatest(a, b))


def citation_verdict(pairs: DataFrame, references: DataFrame) -> DataFrame:
    """pairs (a, b) with `cites`: both, a cites b, b cites a, or neither, by rows (work, reference)."""
    known = references.select("work", "reference").distinct()
    forward = known.select(F.col("work").alias("a"), F.col("reference").alias("b"), F.lit(True).alias("_f"))
    backward = known.select(F.col("work").alias("b"), F.col("reference").alias("a"), F.lit(True).alias("_g"))
    joined = pairs.join(forward, ["a", "b"], "left").join(backward, ["a", "b"], "left")
    f, g = F.col("_f").isNotNull(), F.col("_g").isNotNull()
    said = F.when(f & g, "both").when(f, "a cites b").when(g, "b cites a").otherwise("neither")
    return joined.withColumn("cites", said).drop("_f", "_g")


def merged(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of both tables together; where both know a key, the right side's value holds."""
    l, r = left.select(key, F.col(value).alias("_l")), right.select(key, F.col(value).alias("_r"))
    return l.join(r, key, "full_outer").select(key, F.coalesce("_r", "_l").alias(value))


def replaced(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored with all rows of fresh's keys replaced by fresh's rows."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with each key once, the first by `order`."""
    return latest(rows, [key], [F.col(c) for c in order])


def strict_links(works: DataFrame, references: DataFrame, instrument: DataFrame, subfields: DataFrame, pairs: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(a, b, n): for the pairs (a, b) given, citing works that can't be misfiled, in both directions together.

    As citation_links, but a citing work must be of one of the types, and its subfields (work, subfield) mustn't
    hold that of the topic it cites (topic, subfield in instrument). Pairs without such works have 0.
    """
    cites = references.join(instrument.withColumnRenamed("topic", "cited"), "reference").select("work", "cited", "subfield").distinct()
    own = cites.join(works.filter(F.col("type").isin(*types)).select("work", F.col("topic").alias("citing")), "work")
    clear = own.join(subfields.select("work", "subfield"), ["work", "subfield"], "left_anti").groupBy("cited", "citing").agg(F.countDistinct("work").alias("n"))
    both = both_ways(pairs.select("a", "b"), clear, "ab", "ba")
    return both.select("a", "b", (F.col("ab") + F.col("ba")).alias("n"))


def missing_records(sample: DataFrame, records: DataFrame, fmt: int = 1) -> DataFrame:
    """Sampled topics and freezes without a record of the current format."""
    return sample.join(records.filter(F.col("format") == fmt).select("topic", "freeze"), ["topic", "freeze"], "left_anti")


def require_complete(sample: DataFrame, records: DataFrame, fmt: int = 1) -> None:
    """Raise unless every sampled topic has its record."""
    gone = missing_records(sample, records, fmt).orderBy("topic").limit(1).collect()
    if gone:
        raise ValueError(f"records are missing or in another format, first: {gone[0]['topic']} at {gone[0]['freeze']}")


def seeded_sample(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group in an order given by a hash of the seed and the key: the same on every run."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rank = F.row_number().over(W.partitionBy(group).orderBy(order, key))
    return rows.filter(F.col(group).isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= n)
