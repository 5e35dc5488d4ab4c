"""Work packages: seeded shuffles, chunks, and mixing a benchmark into them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chunks(ids: DataFrame, key: str, size: int, seed: int | str, prefix: str = "u-") -> DataFrame:
    """(unit, position, key): ids, each once and without nulls, in an order given by a hash of the seed,
    in units of `size`, the last maybe shorter. The order of input rows makes no difference.

    Rows are numbered by a range partitioning, so no task holds them all.
    """
    from driftnet.operators.metrics import ranked

    once = ids.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct()
    hashed = once.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256))
    placed = ranked(hashed.withColumn("minus", F.lit(0)), "minus", ["h", key])
    at = F.col("rank") - 1
    return placed.select(F.concat(F.lit(prefix), F.lpad((F.floor(at / size)).cast("string"), 6, "0")).alias("unit"), (at % size + 1).cast("int").alias("position"), key)


def shuffled_units(ids: list[str], size: int, seed: int, prefix: str = "u-") -> list[dict]:
    """The same on the driver with the standard generator, for a list that is small by nature."""
    order = sorted(set(ids))
    random.Random(seed).shuffle(order)
    return [{"unit": f"{prefix}{i // size:06d}", "ids": order[i : i + size], "status": "open"} for i in range(0, len(order), size)]


def mix_benchmark(gold: DataFrame, filler: DataFrame, key: str, per_unit: int = 5, size: int = 20, seed: int = 1, prefix: str = "k-") -> DataFrame:
    """(unit, position, key, is_gold): units of up to per_unit benchmark items, filled up to `size` with others.

    Both sides are numbered in hashed order; the last unit may hold fewer benchmark items and then as
    many fewer fillers. Positions are in hashed order again, so that neither kind comes first.
    """
    g = chunks(gold, key, per_unit, f"{seed}g", prefix).withColumn("is_gold", F.lit(True))
    f = chunks(filler.join(gold.select(F.col(key)).distinct(), key, "left_anti"), key, size - per_unit, f"{seed}f", prefix).withColumn("is_gold", F.lit(False))
    whole = g.unionByName(f.join(g.select("unit").distinct(), "unit", "left_semi"))
    place = F.row_number().over(W.partitionBy("unit").orderBy(F.sha2(F.concat(F.lit(f"{seed}m:"), F.col(key)), 256)))  # a unit has `size` rows
    return whole.select("unit", place.alias("position"), key, "is_gold")


def pick_unit(units: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """The one unit to do next: not done by me nor by this model, those waiting for a second model first."""
    open_ = units.filter(F.col("status").isin("open", "check") & ~F.coalesce(F.array_contains("models", model), F.lit(False)))
    return open_.join(done.select("unit").distinct(), "unit", "left_anti").orderBy((F.col("status") != "check").cast("int"), "unit").limit(1)
