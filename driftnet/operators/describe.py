"""Descriptions of papers by a text model that is an argument, with one retry and a rule for units."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet import session
from driftnet.functions import text as T

#: A unit is dropped if more than this share of its papers can't be described.
MOST_FAILED = 0.25


def asked(rows: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """rows (key, prompt) with `said`: what the model answers, called on the executors; an error of the model is ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = []
            for p in batch["prompt"]:
                try:
                    said.append(ask(p))
                except Exception:  # a model that fails for one paper mustn't end the job
                    said.append("")
            yield pd.DataFrame({"key": batch["key"], "said": said})

    return rows.select("key", "prompt").mapInPandas(run, "key string, said string")


def describe(papers: DataFrame, ask: Callable[[str], str], instructions: str, most_avoided: int = 2) -> DataFrame:
    """(unit, work, problem, approach, tries, fault) of papers (unit, work, title, abstract, avoid).

    Each paper is asked for once, and if its answer can't be used once more, with the reason. fault is
    the second answer's, null for a description. Answers are staged between the two, so no paper is
    asked for again when a task is lost later on.
    """
    keyed = papers.withColumns({"key": F.concat_ws("\x1f", "unit", "work"), "prompt": T.prompt(F.lit(instructions), F.col("title"), F.col("abstract"), F.col("avoid"))})
    keyed = session.stage(keyed.select("key", "unit", "work", "avoid", "prompt"), "prompts")

    def tried(rows: DataFrame, n: int) -> DataFrame:
        got = session.stage(asked(rows, ask), f"answers-{n}").withColumn("x", T.answer(F.col("said")))
        used = F.size(T.avoided(F.concat_ws(" ", "x.problem", "x.approach"), F.coalesce("avoid", F.array().cast("array<string>"))))
        fault = F.coalesce("x.fault", F.when(used > most_avoided, "too many avoided words"))
        told = rows.join(got.select("key", "x"), "key").withColumn("fault", fault)
        return session.stage(told.select("key", "unit", "work", "avoid", "prompt", F.when(F.col("fault").isNull(), F.col("x.problem")).alias("problem"), F.when(F.col("fault").isNull(), F.col("x.approach")).alias("approach"), F.lit(n).alias("tries"), "fault"), f"tried-{n}")

    first = tried(keyed, 1)
    again = first.filter("fault is not null").withColumn("prompt", F.concat_ws("\n\n", "prompt", F.concat(F.lit("Your last answer could not be used: "), "fault")))
    both = first.filter("fault is null").unionByName(tried(again.select("key", "unit", "work", "avoid", "prompt"), 2))
    return both.select("unit", "work", "problem", "approach", "tries", "fault")


def whole_units(described: DataFrame, most_failed: float = MOST_FAILED) -> DataFrame:
    """The descriptions of units of which no more than a share of the papers failed."""
    failed = F.avg(F.col("fault").isNotNull().cast("int")).over(W.partitionBy("unit"))  # a unit is some twenty papers
    return described.withColumn("_failed", failed).filter((F.col("_failed") <= most_failed) & F.col("fault").isNull()).drop("_failed", "fault")
