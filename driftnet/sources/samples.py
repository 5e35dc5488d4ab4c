"""A sample of topics that is drawn once and then read as it was drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet.operators import graph


def fingerprint(sample: DataFrame) -> str:
    """The first 16 digits of the SHA-256 of the ids in order; records for one sample are no use for another."""
    ids = F.array_join(F.array_sort(F.collect_list("id")), ",")  # a sample is some hundreds of topics
    return sample.agg(F.left(F.sha2(ids, 256), F.lit(16)).alias("x")).first()["x"]


def load_or_draw(spark: SparkSession, folder: str, topics: DataFrame, per_domain: int, seed: int) -> DataFrame:
    """The folder's sample, with `pos` in order of domain and draw; drawn from topics (id, domain, ...) if there is none.

    A sample drawn with another seed or size, or one that was changed since, is refused with a
    ValueError: records collected for it would no longer match.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        drawn = graph.seeded_sample(topics, "domain", "id", per_domain, seed)
        pos = F.row_number().over(W.orderBy("domain", "rank"))  # some hundreds of rows
        drawn.withColumn("pos", pos).drop("rank").write.mode("overwrite").parquet(f"{folder}/sample")
        row = [(seed, per_domain, fingerprint(spark.read.parquet(f"{folder}/sample")))]
        spark.createDataFrame(row, "seed bigint, per_domain bigint, sample string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")
    meta, sample = spark.read.parquet(f"{folder}/meta").first(), spark.read.parquet(f"{folder}/sample")
    if (meta["seed"], meta["per_domain"]) != (seed, per_domain):
        raise ValueError(f"{folder} holds a sample drawn with seed {meta['seed']} and {meta['per_domain']} per domain")
    if fingerprint(sample) != meta["sample"]:
        raise ValueError(f"the sample in {folder} was changed since it was drawn")
    return sample
