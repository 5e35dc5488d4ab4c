"""Mixing sources to target shares of tokens, with capped repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.llm import tokens

SLICES = 4096


def source_name(column: str):
    return F.nullif(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), F.lit(""))


def _count(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoding(folder)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(sizes, pa.int64())], names=[*[batch.schema.names[i] for i in keep], "tokens"])

    return run


def sized(documents: DataFrame, folder: str = tokens.FOLDER) -> DataFrame:
    """(doc_id, source, text_key, quality, tokens) of every document with a source, staged.

    source is trimmed and lower-cased; a null or blank one is none. A null text has no tokens, like an
    empty one. quality is the share of letters and spaces in the text, at least 0.05. text_key tells
    texts apart. Documents are counted where they lie, in one pass that shuffles nothing.
    """
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\s]+", "")) / F.greatest(F.length("text"), F.lit(1))
    quality = F.greatest(F.lit(0.05), F.coalesce(letters, F.lit(0.0)))
    slim = documents.select("doc_id", source_name("source").alias("source"), F.xxhash64("text").alias("text_key"), quality.alias("quality"), "text")
    out = slim.filter("source is not null").mapInArrow(_count(folder), "doc_id bigint, source string, text_key bigint, quality double, tokens bigint")
    return session.stage(out, "sized")


class Mix:
    """rows (doc_id, source, tokens, uses) and shares (source, weight, max_repeats, texts, held, target,
    epochs, reached, share, short, capped); short is how many tokens of the target were not reached."""

    def __init__(self, rows: DataFrame, shares: DataFrame):
        self.rows, self.shares = rows, shares


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, folder: str = tokens.FOLDER, slices: int = SLICES) -> Mix:
    """Choose documents so that each source of targets gets its weight of `total` tokens.

    total is the number of tokens of all documents with a source unless given. A source's documents are
    taken whole: first in as many complete epochs as fit its target, at most max_repeats, then, if
    repeats are left, a fraction drawn without replacement by exponential keys -ln(u) / quality, in
    rising order while the running sum of tokens stays within what is missing. So no source goes
    beyond its target, and none uses a document more than max_repeats times. Texts that several
    documents of a source share are used through the one of smallest id; null and empty texts are
    never used. A source is `capped` if its documents, each text counted as often as it occurs, hold
    fewer tokens than its target even max_repeats times over, a source without texts included.
    Texts that repeat within a source hold more than they can give, so a source may fall short without being
    capped; `short` tells by how many tokens each source stays below its target, for whatever reason.
    Sources outside targets contribute nothing; repeated targets add up, null weights are 0.

    A document's key is a hash of its text and the seed, so any rerun draws the same rows. The order
    within a source is found in slices of the key's range: token sums by slice tell the one slice
    where the budget ends, and only that slice's rows are sorted, so a source with most of the rows
    is never gathered.
    """
    docs = sized(documents, folder)
    wanted = targets.select(source_name("source").alias("source"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    size = total if total is not None else docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    texts = docs.filter("tokens > 0").groupBy("source", "text_key").agg(F.min_by(F.struct("doc_id", "quality", "tokens"), "doc_id").alias("x"), F.sum("tokens").alias("all"))
    u = (F.pmod(F.xxhash64("text_key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    texts = texts.select("source", "x.doc_id", "x.tokens", "all", (-F.log(u) / F.col("x.quality")).alias("key"))
    # 1 - exp(-key) rises with the key and spreads it over [0, 1)
    texts = session.stage(texts.withColumn("slice", F.least(F.lit(slices - 1), F.floor((1 - F.exp(-F.col("key"))) * slices)).cast("int")), "texts")
    held = texts.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("once"), F.sum("all").alias("held"))
    plan = wanted.join(held, "source", "left").fillna(0, ["texts", "once", "held"])
    plan = plan.withColumn("target", F.col("weight") * F.lit(float(size)))
    fit = F.when(F.col("once") > 0, F.floor(F.col("target") / F.col("once"))).otherwise(0)
    plan = plan.withColumn("epochs", F.least(fit, F.col("max_repeats")).cast("bigint"))
    missing = F.when((F.col("epochs") < F.col("max_repeats")), F.col("target") - F.col("epochs") * F.col("once")).otherwise(0.0)
    plan = session.stage(plan.withColumn("missing", missing), "plan")
    by_slice = texts.groupBy("source", "slice").agg(F.sum("tokens").alias("n"))
    before = by_slice.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("slice"))).join(plan.select("source", "epochs", "missing"), "source")
    ends = session.stage(before.select("source", "slice", "epochs", "missing", (F.col("upto") - F.col("n")).alias("below"), "upto"), "slices")
    # at most one row a source: the slice in which the budget runs out
    cut = ends.filter("below <= missing and upto > missing").groupBy("source").agg(F.min_by(F.struct("slice", "below", "missing", "epochs"), "slice").alias("c"))
    cut = cut.select("source", F.col("c.slice").alias("cut"), "c.below", "c.missing", F.col("c.epochs").alias("e"))
    whole = texts.join(plan.select("source", "epochs"), "source").join(cut.select("source", "cut"), "source", "left")
    clear = whole.filter("cut is null or slice <> cut")
    extra = F.when(F.col("cut").isNull(), 0).otherwise((F.col("slice") < F.col("cut")).cast("int"))
    clear = clear.select("doc_id", "source", "tokens", (F.col("epochs") + extra).alias("uses"))
    edge = texts.join(cut.withColumnRenamed("cut", "slice"), ["source", "slice"])
    running = F.sum("tokens").over(W.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("running", F.col("below") + running).select("doc_id", "source", "tokens", (F.col("e") + (F.col("running") <= F.col("missing")).cast("int")).alias("uses"))
    rows = session.stage(clear.unionByName(edge).filter("uses > 0"), "mix")
    reached = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached"))
    shares = plan.join(reached, "source", "left").fillna(0, ["reached"])
    everything = F.sum("reached").over(W.partitionBy(F.lit(0)))  # one row a source
    capped = F.col("held") * F.col("max_repeats") < F.col("target")
    short = F.greatest(F.lit(0.0), F.col("target") - F.col("reached"))
    shares = shares.select("source", "weight", "max_repeats", "texts", "held", "target", "epochs", "reached", F.when(everything > 0, F.col("reached") / everything).alias("share"), short.alias("short"), capped.alias("capped"))
    return Mix(rows, shares)
