"""Writers. Spark's committer makes each atomic; small single files are for people and other programs."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table_and_csv(rows: DataFrame, folder: str, name: str, order: list[str]) -> None:
    """Parquet for further work, and one CSV with a header in a fixed order for people."""
    rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def ranking(rows: DataFrame, folder: str, score: str) -> None:
    """A ranking with scores printed to six decimals."""
    printed = rows.withColumn(score, F.format_string("%.6f", score))
    printed.orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/ranking.csv")


def open_index(described: DataFrame, papers: DataFrame, folder: str) -> None:
    """One JSON line per paper, its descriptions nested, ordered by work."""
    described_by = described.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("model", "problem", "approach"))).alias("descriptions"))
    papers.join(described_by, "work").orderBy("work").write.mode("overwrite").json(f"{folder}/index")


class _Encoder(json.JSONEncoder):
    """JSON as browsers read it: numbers that don't exist are null, NumPy's are plain."""

    def iterencode(self, o, _one_shot=False):
        # strings are passed over whole; elsewhere what the standard writer can only name becomes null
        text = "".join(super().iterencode(o, _one_shot))
        yield re.sub(r'("(?:[^"\\]|\\.)*")|-?Infinity|NaN', lambda m: m.group(1) or "null", text)

    def default(self, o):
        return o.item() if hasattr(o, "item") else str(o)


def as_json(tree) -> str:
    return json.dumps(tree, indent=1, ensure_ascii=False, cls=_Encoder)


def report(tree: dict, path: str) -> None:
    """A small report as JSON, through a temporary name; NaN and infinities are null."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(as_json(tree))
    os.replace(f"{path}.tmp", path)


def model_file(models: dict[str, tuple[dict, dict, dict, float]], path: str) -> None:
    """Models (means, scales, coefficients, intercept) by name, as readers.stored_model reads them."""
    report({m: {"features": list(coefs), "coef": list(coefs.values()), "mean": [means[f] for f in coefs], "scale": [scales[f] for f in coefs], "intercept": intercept} for m, (means, scales, coefs, intercept) in models.items()}, path)


def digest(spark, path: str):
    """(file, sha256) of every file under a path, wherever it is stored; files are read where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!._]*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def checksums(folder: str) -> dict[str, str]:
    """SHA-256 of each plain file under a local folder; also written as SHA256SUMS."""
    out = {}
    for base, _, names in sorted(os.walk(folder)):
        for name in sorted(names):
            if name != "SHA256SUMS" and not name.startswith((".", "_")):
                with open(os.path.join(base, name), "rb") as f:
                    out[os.path.relpath(os.path.join(base, name), folder)] = hashlib.file_digest(f, "sha256").hexdigest()
    with open(os.path.join(folder, "SHA256SUMS"), "w", encoding="utf-8") as f:
        f.writelines(f"{v}  {k}\n" for k, v in out.items())
    return out


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with fresh merged in: one row per key, the latest by `order`, fresh before stored on ties."""
    both = stored.withColumn("_f", F.lit(1)).unionByName(fresh.withColumn("_f", F.lit(0)))
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(order), "_f"))
    return both.withColumn("_r", r).filter("_r = 1").drop("_r", "_f")
