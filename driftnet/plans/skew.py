"""Plans that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from this share of the rows on, so there are at most 1 / HOT_SHARE such keys,
#: and from this number of rows on, since below it one task copes.
HOT_SHARE = 0.02
HOT_ROWS = 100_000
#: Share of the rows read to look for hot keys. It steers the plan only, never the result.
PROBE = 0.05


def hot_keys(df: DataFrame, key: str | Column, weight: Column | None = None, rows: int | None = None, share: float | None = None, probe: float | None = None) -> list:
    """Keys that hold at least `share` of the rows (or of `weight`) and at least `rows` of them.

    At most 1 / share keys reach the driver. Null keys are never returned. Pass a scan or a staged
    table: the probe reads the input once more.
    """
    rows, share, probe = (d if v is None else v for v, d in ((rows, HOT_ROWS), (share, HOT_SHARE), (probe, PROBE)))
    key = F.col(key) if isinstance(key, str) else key
    sized = df.select(key.alias("k"), (weight if weight is not None else F.lit(1)).cast("double").alias("w"))
    sized = sized.sample(probe, seed=11) if probe < 1 else sized
    per_key = sized.groupBy("k").agg(F.sum("w").alias("w")).filter(F.col("k").isNotNull() & (F.col("w") >= F.lit(rows * probe)))
    many = per_key.orderBy(F.desc("w"), "k").limit(int(1 / share)).collect()
    if not many:  # the usual case: one small job, and no total is needed
        return []
    total = sized.agg(F.sum("w").alias("t")).first()["t"]
    return [r["k"] for r in many if r["w"] >= share * total]


def salted(hot: list, key: Column, by: Column, salts: int) -> Column:
    """A salt in [0, salts) for rows of hot keys, 0 for all others."""
    return F.when(key.isin(hot), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)


def lookup_join(big: DataFrame, dim: DataFrame, on: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join big with dim, whose `on` is unique, without sending a hot key's rows to one task.

    Hot keys' rows of big stay where they are: the few rows of dim for them (at most 1 / HOT_SHARE)
    are broadcast. All other rows go through a shuffle join, or whatever the planner finds best.
    """
    hot = hot_keys(big, on) if hot is None else hot
    if not hot:
        return big.join(dim, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    few = F.broadcast(dim.filter(F.col(on).isin(hot)))
    return big.filter(~is_hot).join(dim, on, how).unionByName(big.filter(is_hot).join(few, on, how))
