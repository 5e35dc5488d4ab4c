"""The study of pairs: models fitted on earlier pairs, held against later ones, and what is concluded from them."""

from __future__ import annotations

import json
import platform
import subprocess
from collections.abc import Callable
from importlib.metadata import version

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet import session
from driftnet.functions import text as T
from driftnet.operators import content, graph, metrics, replicates, stats

#: A gain below this share of the network model's average precision isn't worth having.
SMALLEST = 0.10
BOOTSTRAP = 2000
TOP = 200


class NotEnough(ValueError):
    """Pairs lack what an analysis needs; the message says what."""


def boosted(fitting: DataFrame, later: DataFrame, label: str = "label", rounds: int = 20, depth: int = 3, seed: int = 1) -> DataFrame:
    """later with score_trees: gradient-boosted trees on all features, classes weighing the same, fitted on the cluster."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    share = fitting.agg(F.avg(label).alias("p")).first()["p"]
    weight = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)).alias("_w")
    join = VectorAssembler(inputCols=graph.FEATURES, outputCol="_x")
    model = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed).fit(join.transform(fitting.select(*graph.FEATURES, F.col(label).cast("double").alias("_y"), weight)))
    scored = model.transform(join.transform(later))
    return scored.withColumn("score_trees", vector_to_array("probability")[1]).select(*later.columns, "score_trees")


def random_score(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone: the floor that any model must beat."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) for k in keys]), 256)
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / float(1 << 32)


def require_both_kinds(pairs: DataFrame, label: str, what: str) -> tuple[int, int]:
    """(pairs, positives); raises NotEnough unless there are pairs of both kinds."""
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("p")).first()
    if not r["n"]:
        raise NotEnough(f"there are no {what} pairs")
    if r["p"] in (0, r["n"]):
        raise NotEnough(f"no {what} pair is {'connected' if not r['p'] else 'unconnected'}")
    return r["n"], r["p"]


def fit_models(pairs: DataFrame, sets: dict[str, list[str]] | None = None, label: str = "label", most: int = stats.MOST_ROWS) -> dict[str, stats.Logit]:
    """One model for each set of features, on the driver up to `most` pairs and on the cluster beyond."""
    sets = sets or graph.FEATURE_SETS
    names = sorted({c for cols in sets.values() for c in cols})
    if pairs.count() > most:
        return stats.fit_together(pairs, sets, label)
    rows = stats.bounded_pandas(pairs.select(*names, label), most)
    return {m: stats.fit(rows[cols].to_numpy(float), rows[label].to_numpy(float), cols) for m, cols in sets.items()}


def model_score(model: stats.Logit) -> Column:
    return metrics.logit_score(dict(zip(model.names, model.mean)), dict(zip(model.names, model.scale)), dict(zip(model.names, model.coef)), model.intercept)


def with_scores(pairs: DataFrame, models: dict[str, stats.Logit], seed: int = 1) -> DataFrame:
    """pairs with a column score_<model> for each model, and score_random."""
    return pairs.withColumns({f"score_{m}": model_score(x) for m, x in models.items()} | {"score_random": random_score(seed, "a", "b")})


def long_scores(scored: DataFrame, *keep: str) -> DataFrame:
    """(model, score, label, and the columns kept), a row for each model and pair."""
    names = [c for c in scored.columns if c.startswith("score_")]
    each = F.explode(F.array(*[F.struct(F.lit(c[6:]).alias("model"), F.col(c).alias("score")) for c in names])).alias("x")
    return scored.select(*keep, "label", each).select("x.model", "x.score", "label", *keep)


def measures(scored: DataFrame, ks: tuple[int, ...] = (100, 1000)) -> DataFrame:
    """(model, average_precision, roc_auc, precision_at_<k>) of every score."""
    rows = long_scores(scored, "a", "b")
    out = metrics.curves(rows, "score", "label", ["model"]).select("model", F.col("ap").alias("average_precision"), F.col("auc").alias("roc_auc"))
    for k in ks:
        out = out.join(metrics.precision_at(rows, "score", "label", k, ["a", "b"], ["model"]).withColumnRenamed("precision", f"precision_at_{k}"), "model")
    return out


def by_domain_pair(scored: DataFrame, least: int = 5) -> DataFrame:
    """(domain_pair, model, pairs, positives, ap): ap is null with fewer than `least` positives or no other pair."""
    rows = long_scores(scored, "domain_pair")
    n = rows.groupBy("domain_pair", "model").agg(F.count(F.lit(1)).alias("pairs"))
    found = metrics.average_precision(rows, "score", "label", ["domain_pair", "model"]).join(n, ["domain_pair", "model"])
    ok = (F.col("positives") >= least) & (F.col("positives") < F.col("pairs"))
    return found.select("domain_pair", "model", "pairs", F.col("positives").cast("bigint").alias("positives"), F.when(ok, F.col("ap")).alias("ap"))


def top_predictions(scored: DataFrame, score: str, topics: DataFrame, n: int = TOP) -> DataFrame:
    """The n pairs of highest score, ties by name, with both sides' names and what is known of their links."""
    first = scored.orderBy(F.desc(score), "a", "b").limit(n)
    placed = metrics.ranked(first, score, ["a", "b"])
    for s in "ab":
        placed = placed.join(topics.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("name", "field", "domain")]), s, "left")
    return placed.select("rank", "a", "name_a", "field_a", "domain_a", "b", "name_b", "field_b", "domain_b", F.col(score).alias("score"), F.col("prior").alias("links_before"), (F.col("ab") + F.col("ba")).alias("links_after"), F.col("label").alias("connected_later"))


def outcome(low: Column, high: Column, worth: Column) -> Column:
    """What the interval of a difference says: supported above 0, negative below what is worth having, else inconclusive."""
    return F.when(low > 0, "supported").when(high < worth, "negative").when(low.isNotNull() & high.isNotNull(), "inconclusive")


def conclusions(differences: dict[str, tuple[float, float, float]], network_ap: float, strict: dict | None) -> dict:
    """Hypotheses and decision from differences {H1, H2, H3: (difference, low, high)}.

    H1 (combined over network) holds by its interval, H2 (network over popularity) and H3 (semantic over
    popularity) by their sign. Without the stricter check the decision is `incomplete`; else `continue`
    if H1, H2 and that check hold, else `stop`.
    """
    said = stats.decision(differences["H1"][1], differences["H1"][2], SMALLEST * network_ap)
    out = {k: {"diff": d, "diff_ci": [lo, hi], "holds": d > 0} for k, (d, lo, hi) in differences.items()}
    out["H1"] |= {"outcome": said, "holds": said == "supported"}
    if strict is None:
        decision = "incomplete"
    else:
        decision = "continue" if out["H1"]["holds"] and out["H2"]["holds"] and strict["holds"] else "stop"
    return {"hypotheses": out, "decision": decision}


def provenance(folder: str = ".", packages: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict:
    """The commit that code comes from, whether it was changed since, and the versions it ran with."""

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True, timeout=30).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return ""

    return {"commit": git("rev-parse", "HEAD"), "code_changed": bool(git("status", "--porcelain")), "python": platform.python_version(), **{p: version(p) for p in packages}}


def resampled(fitting: DataFrame, later: DataFrame, domains: dict[str, str], draws: int, seed: int = 0, strict: bool = False, models: dict[str, stats.Logit] | None = None, most: int = 5_000) -> DataFrame:
    """(draw, model, ap) of a topic bootstrap with refit: replicates are tasks up to `most` pairs, which are sent to all of
    them; of more pairs, which stay where they lie, every task does its part of all replicates. models are those of fitting, if known."""
    fit = fitting.select("a", "b", *graph.FEATURES, "label")
    kept = later.select("a", "b", *graph.FEATURES, "label", *["strict"] * strict)
    if max(fit.count(), kept.count()) > most:
        require_both_kinds(fit, "label", "fitting")
        return replicates.bootstrap(fit, kept, domains, models or fit_models(fit), draws, seed, strict)
    take = lambda df: stats.bounded_pandas(df.orderBy("a", "b"))
    return stats.bootstrap(later.sparkSession, take(fit), take(kept), domains, graph.FEATURE_SETS, draws, seed, strict=strict)


def report(fitting: DataFrame, later: DataFrame, domains: dict[str, str], draws: int = BOOTSTRAP, strict: DataFrame | None = None, least_after: int = 3, config: dict | None = None, seed: int = 0) -> dict:
    """The whole analysis as a tree: pairs, models with their measures and intervals, hypotheses, the stricter
    check, decision, measures by pair of domains, directions of links, shift of features, highest predictions.

    fitting and later are tables as from graph.pair_table, staged. strict (a, b, n) counts links by the
    stricter rule; a pair without a row has none. Everything that reaches the driver is a few rows, but for what
    the bootstrap and the fits hold there, which is bounded.
    """
    n_fit, p_fit = require_both_kinds(fitting, "label", "fitting")
    n_later, p_later = require_both_kinds(later, "label", "later")
    models = fit_models(fitting)
    marked = later
    if strict is not None:
        marked = later.join(strict.select("a", "b", F.col("n").alias("_n")), ["a", "b"], "left").withColumn("strict", (F.coalesce("_n", F.lit(0)) >= least_after).cast("int")).drop("_n")
    scored = with_scores(marked, models)
    positives = scored.agg(F.sum("strict").alias("p")).first()["p"] if strict is not None else None
    boot = resampled(fitting, marked, domains, draws, seed, bool(positives), models).toPandas()  # draws times models
    value = lambda m: boot[boot["model"] == m].set_index("draw")["ap"].astype(float)
    ci = lambda v: [None if v.dropna().empty else float(v.quantile(q)) for q in (0.025, 0.975)]
    told = {r["model"]: r.asDict() for r in measures(scored).collect()}
    for m in told:
        told[m]["average_precision_ci"] = ci(value(m))
        if m in models:
            told[m]["coef"] = dict(zip(models[m].names, map(float, models[m].coef)))
    gap = lambda a, b, suffix="": (value(a + suffix) - value(b + suffix))
    diff = lambda a, b: (told[a]["average_precision"] - told[b]["average_precision"], *ci(gap(a, b)))
    check = None
    if strict is not None and not positives:
        check = {"positive": 0, "holds": False, "diff": None, "diff_ci": None, "outcome": None}
    elif strict is not None:
        ap = {r["model"]: r["ap"] for r in metrics.average_precision(long_scores(scored.withColumn("label", F.col("strict"))), "score", "label", ["model"]).collect()}
        lo, hi = ci(gap("combined", "network", "_strict"))
        check = {"positive": int(positives), "diff": ap["combined"] - ap["network"], "diff_ci": [lo, hi], "network_ap": ap["network"], "holds": ap["combined"] > ap["network"], "outcome": stats.decision(lo, hi, SMALLEST * ap["network"])}
    said = conclusions({"H1": diff("combined", "network"), "H2": diff("network", "popularity"), "H3": diff("semantic", "popularity")}, told["network"]["average_precision"], check)
    links = scored.filter("label = 1").agg(F.count_if(F.expr("ab > 0 and ba > 0")).alias("both"), F.count_if(F.expr("(ab > 0) <> (ba > 0)")).alias("one_way")).first()
    shift = {r["feature"]: {"mean": r["mean"], "sd": r["sd"]} for r in metrics.mean_sd(fitting, graph.FEATURES).collect()}
    now = {r["feature"]: {"mean": r["mean"], "sd": r["sd"]} for r in metrics.mean_sd(scored, graph.FEATURES).collect()}
    return {
        "config": (config or {}) | {"bootstrap": draws, "smallest_effect": SMALLEST} | provenance(),
        "pairs": {"fit": n_fit, "fit_positive": int(p_fit), "later": n_later, "later_positive": int(p_later), "base_rate": p_later / n_later},
        "models": told, **said, "strict": check,
        "by_domain_pair": [r.asDict() for r in by_domain_pair(scored).orderBy("domain_pair", "model").collect()],
        "directions": links.asDict(), "feature_shift": {f: {"fit": shift[f], "later": now[f]} for f in graph.FEATURES},
        "top_predictions": [r.asDict() for r in scored.orderBy(F.desc("score_combined"), "a", "b").limit(TOP).select("a", "b", "score_combined", "prior", "ab", "ba", "label").collect()],
    }


def summary(tree: dict) -> dict:
    """The part of a report that a table of robustness checks shows."""
    few = {m: {k: v.get(k) for k in ("average_precision", "average_precision_ci")} for m, v in tree["models"].items()}
    return {"pairs": tree["pairs"], "models": few, "hypotheses": tree["hypotheses"]}


def robustness(main: dict, variants: list[tuple[str, str, dict]], run: Callable[..., dict], save: Callable[[list[dict]], None] | None = None) -> list[dict]:
    """The main report's summary, then each variant's (key, label, settings) by run(**settings), in order.

    A variant that lacks data is listed as skipped, with the reason. save gets the list after each one,
    so that an interruption loses one at most.
    """
    out = [{"key": "main", "label": "as planned", **summary(main)}]
    strict = main.get("strict")
    if strict is not None:
        entry = {"key": "strict", "label": "by the stricter rule"}
        out.append(entry | ({"hypotheses": {"H1": strict}} if strict.get("diff") is not None else {"skipped": "no pair is connected by the stricter rule"}))
    for key, label, settings in variants:
        try:
            out.append({"key": key, "label": label, **summary(run(**settings))})
        except NotEnough as e:
            out.append({"key": key, "label": label, "skipped": str(e)})
        if save:
            save(out)
    return out


def replaced(entries: list[dict], entry: dict) -> list[dict]:
    """entries with the one of entry's key replaced, or added at the end."""
    return [e for e in entries if e["key"] != entry["key"]] + [entry]


def publishable(tree: dict, checks: list[dict] | None = None, known_commit: Callable[[str], bool] = lambda c: True) -> dict:
    """What may be published; raises ValueError if the report is undecided, comes from changed or unknown code, or
    its robustness checks are of another run."""
    if tree.get("decision") not in ("continue", "stop"):
        raise ValueError("no decision: the stricter check is missing")
    commit = tree.get("config", {}).get("commit")
    if not commit or tree["config"].get("code_changed", True):
        raise ValueError("the code that made the report was not committed")
    if not known_commit(commit):
        raise ValueError(f"commit {commit[:7]} is unknown here")
    if checks is not None and next((c for c in checks if c["key"] == "main"), {}).get("hypotheses") != tree["hypotheses"]:
        raise ValueError("the robustness checks are of another run")
    return {"status": "complete", "commit": commit, "report": tree} | ({"robustness": checks} if checks is not None else {})


def require_close(model: stats.Logit, published: dict[str, float], tolerance: float = 1e-4) -> float:
    """The largest difference of a refitted model's coefficients from those published; raises beyond the tolerance."""
    worst = max(abs(c - published[n]) for n, c in zip(model.names, model.coef))
    if worst > tolerance:
        raise ValueError(f"coefficients differ by {worst:.2g} from those published")
    return float(worst)


def model_row(spark: SparkSession, name: str, model: stats.Logit) -> DataFrame:
    """(model, feature, coef, mean, scale), the intercept as a feature of its own."""
    rows = [(name, n, float(c), float(a), float(s)) for n, c, a, s in zip(model.names, model.coef, model.mean, model.scale)]
    return spark.createDataFrame(rows + [(name, "intercept", float(model.intercept), 0.0, 1.0)], "model string, feature string, coef double, mean double, scale double")


def gradient(pairs: DataFrame, model: stats.Logit, label: str = "label", penalty: float = 1.0) -> DataFrame:
    """(feature, gradient) of the fitted objective at the model's coefficients, one pass over the pairs: 0 at the optimum."""
    one = pairs.agg(F.avg(label).alias("p"), F.count(F.lit(1)).alias("n")).first()
    weight = F.when(F.col(label) == 1, F.lit(0.5 / one["p"])).otherwise(F.lit(0.5 / (1 - one["p"])))
    error = weight * (model_score(model) - F.col(label))
    z = {n: (F.col(n) - F.lit(float(m))) / F.lit(float(s)) for n, m, s in zip(model.names, model.mean, model.scale)} | {"intercept": F.lit(1.0)}
    ridge = {n: penalty * float(c) for n, c in zip(model.names, model.coef)} | {"intercept": 0.0}
    sums = pairs.agg(*[(F.sum(error * z[n]) + F.lit(ridge[n])).alias(n) for n in z])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("gradient")) for n in z])).alias("x")).select("x.feature", "x.gradient")


def set_features(pairs: DataFrame, near: DataFrame, recent: DataFrame) -> DataFrame:
    """(a, b, log_deg_hi, log_deg_lo, log_common, log_recent_common, jaccard, cocite_cosine) by another way than
    graph.pair_table: each topic's neighbours as one list, which goes to the blocks of topics that it is compared in, not to
    every pair. For checking that both agree."""
    one = lambda df, n: df.groupBy("topic").agg(F.collect_list(F.struct("citer", "n")).alias(n))  # noqa: E731  # as many as there are topics
    maps = one(near, "m").join(one(recent, "r"), "topic", "full_outer")
    maps = session.stage(maps.select("topic", F.col("m.citer").alias("mk"), F.col("m.n").alias("mn"), F.col("r.citer").alias("rk")), "maps")
    blocks = content.blocks_of(maps.count())
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = maps.select("*", F.lit(0).alias("side"), own("topic").alias("x"), every.alias("y"))
    right = maps.select("*", F.lit(1).alias("side"), every.alias("x"), own("topic").alias("y"))
    asked = pairs.select("a", "b", F.lit(2).alias("side"), own("a").alias("x"), own("b").alias("y"))
    wide = left.unionByName(right).unionByName(asked, allowMissingColumns=True).groupBy("x", "y").applyInArrow(_compared_sets, "a string, b string, " + ", ".join(f"{c} bigint" for c in _SETS))
    norm = lambda c: F.coalesce(F.nullif(F.sqrt(F.col(c).cast("double")), F.lit(0.0)), F.lit(1.0))
    size = lambda c: F.col(c).cast("double")
    return wide.select(
        "a", "b", F.log1p(F.greatest(size("da"), size("db"))).alias("log_deg_hi"), F.log1p(F.least(size("da"), size("db"))).alias("log_deg_lo"), F.log1p(size("common")).alias("log_common"),
        F.log1p(size("recent_common")).alias("log_recent_common"), (size("common") / F.greatest("joint", F.lit(1))).alias("jaccard"), (F.col("dot") / (norm("na") * norm("nb"))).alias("cocite_cosine"),
    )


_SETS = ["da", "db", "na", "nb", "common", "joint", "dot", "recent_common"]
#: Citers whose columns are compared at once.
WIDTH = 2048


def _compared_sets(rows: pa.Table) -> pa.Table:
    """Of two blocks of topics (sides 0 and 1) and pairs of them (side 2): what each pair's sets of citers have, by columns of citers."""
    side = np.asarray(rows.column("side"))
    asked = rows.filter(pa.array(side == 2)).select(["a", "b"])
    sides = [rows.filter(pa.array(side == z)) for z in (0, 1)]

    def cells(key: str, value: str | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of either side: row, citer's number and value of each entry, by citer. The last row is of topics without any."""
        flat = [t.column(key).combine_chunks().drop_null() for t in sides]
        sizes = [np.asarray(pc.list_value_length(t.column(key)).fill_null(0)) for t in sides]
        code = np.asarray(pa.chunked_array([f.flatten() for f in flat], pa.string()).combine_chunks().dictionary_encode().indices)
        out, at = [], 0
        for t, n in zip(sides, sizes):
            own, at = code[at : at + n.sum()], at + n.sum()
            order = np.argsort(own, kind="stable")
            v = np.asarray(t.column(value).combine_chunks().drop_null().flatten()) if value else np.ones(len(own), dtype=np.int64)
            out.append((np.repeat(np.arange(len(n)), n)[order], own[order], v[order]))
        return out

    tall = [len(t) + 1 for t in sides]

    def sums(entries: list, what: list) -> list[np.ndarray]:
        """For each f of what: the sum over citers of f's product for all rows of both sides; whole numbers, exact below 2^53."""
        out, most = [np.zeros(tall) for _ in what], max([0, *[int(c.max()) + 1 for _, c, _ in entries if len(c)]])
        for lo in range(0, most, WIDTH):
            width, dense = min(WIDTH, most - lo), []
            for (r, c, v), n in zip(entries, tall):
                i, j = np.searchsorted(c, [lo, lo + width])
                m = np.zeros((n, width))
                m[r[i:j], c[i:j] - lo] = v[i:j]
                dense.append(m)
            for o, f in zip(out, what):
                o += f(dense[0]) @ f(dense[1]).T
        return [*out, most]

    has, lacks = (lambda m: (m != 0).astype(np.float32)), (lambda m: (m == 0).astype(np.float32))
    train = cells("mk", "mn")
    common, neither, most = sums(cells("mk", None), [has, lacks])
    dot, _ = sums(train, [lambda m: m])
    recent, _ = sums(cells("rk", None), [has])
    deg = [np.bincount(r, minlength=n) for (r, _, _), n in zip(train, tall)]
    square = [np.bincount(r, weights=v.astype(float) ** 2, minlength=n) for (r, _, v), n in zip(train, tall)]
    i, j = (np.asarray(pc.fill_null(pc.index_in(asked.column(c), t.column("topic").combine_chunks(), skip_nulls=True), len(t))) for c, t in zip("ab", sides))
    values = [deg[0][i], deg[1][j], square[0][i], square[1][j], common[i, j], most - neither[i, j], dot[i, j], recent[i, j]]
    return pa.table({"a": asked.column("a"), "b": asked.column("b"), **{c: pa.array(v.astype(np.int64)) for c, v in zip(_SETS, values)}})


def largest_difference(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(feature, largest): the largest difference of each column between two tables of the same keys; keys that only
    one of them has count as infinite."""
    both = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns]).join(right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns]), keys, "full_outer")
    wide = both.agg(*[F.max(F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")), F.lit(float("inf")))).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("largest")) for c in columns])).alias("x")).select("x.feature", "x.largest")


def file_name(model: str, prior: int, after: int) -> str:
    """The name of a report's file."""
    return f"report_e{prior}_k{after}_{T.safe_text(model)}.json"


def flat(tree, at: str = "") -> list[tuple[str, str]]:
    """(path, value as JSON) of every leaf of a report."""
    if isinstance(tree, dict):
        return [x for k, v in tree.items() for x in flat(v, f"{at}/{k}")]
    if isinstance(tree, list) and any(isinstance(v, (dict, list)) for v in tree):
        return [x for i, v in enumerate(tree) for x in flat(v, f"{at}/{i}")]
    return [(at, json.dumps(tree))]
