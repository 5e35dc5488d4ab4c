"""Submissions as a stream. Each micro-batch goes through the batch functions; state lives in versioned tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftnet.operators import intake

SUBMISSION = "unit string, issue string, author string, model string, arrived timestamp"


class Store:
    """Accepted submissions as parts of a table in a folder all executors share, one part a micro-batch.

    A batch writes its new submissions as a part of its own, then a head of its own that names the batch
    and makes the part count. Nothing is ever overwritten, so a crash in between leaves the last head in
    place, and a batch that comes again changes nothing. The source gives at-least-once delivery; issues
    already seen are dropped.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _names(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def head(self) -> dict:
        """The last version and its batch; a head is an empty file head-<version>-<batch>."""
        heads = [tuple(map(int, n.split("-")[1:])) for n in self._names() if n.startswith("head-")]
        version, batch = max(heads, default=(0, -1))
        return {"version": version, "batch": batch}

    def submissions(self) -> DataFrame:
        """All submissions of parts that count."""
        parts = [f"{self.folder}/part-{v}" for v in range(1, self.head()["version"] + 1)]
        return self.spark.read.schema(SUBMISSION).parquet(*parts) if parts else self.spark.createDataFrame([], SUBMISSION)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        head = self.head()
        if batch_id <= head["batch"]:
            return
        fresh = batch.select("unit", "issue", "author", "model", "arrived").filter("unit is not null and issue is not null")
        first = F.row_number().over(W.partitionBy("unit", "issue").orderBy("arrived", "author", "model"))
        new = fresh.withColumn("r", first).filter("r = 1").drop("r").join(self.submissions().select("unit", "issue"), ["unit", "issue"], "left_anti")
        version = head["version"] + 1
        new.write.mode("overwrite").parquet(f"{self.folder}/part-{version}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/head-{version}-{batch_id}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False).close()

    def states(self, quorum: int = 2) -> DataFrame:
        return intake.unit_states(self.submissions(), quorum)


def run(source: DataFrame, store: Store, checkpoint: str, then: Callable[[Store, int], None] | None = None):
    """Start the stream of submissions (unit, issue, author, model, arrived) into the store; processes what is there.

    then is called with the store and the batch's number after each batch, to bring up to date what hangs
    on the submissions: states, progress, matches. It must bear to be called again for the same batch.
    """

    def each(df: DataFrame, i: int) -> None:
        store.apply(df, i)
        if then is not None:
            then(store, i)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted_by_day(source: DataFrame, delay: str = "7 days") -> DataFrame:
    """A streaming aggregate: submissions per day of arrival and model, late ones admitted up to `delay`."""
    return source.withWatermark("arrived", delay).groupBy(F.window("arrived", "1 day").alias("day"), "model").agg(F.approx_count_distinct("issue").alias("issues"), F.count(F.lit(1)).alias("rows"))


def replay(spark: SparkSession, rows: DataFrame, folder: str, quorum: int = 2, files: int = 4) -> DataFrame:
    """States of units after rows went through the stream as `files` input files, one micro-batch each."""
    source = os.path.join(folder, "in")
    rows.repartition(files).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store = Store(spark, f"{folder}/store")
    run(stream, store, f"{folder}/checkpoint").awaitTermination()
    return store.states(quorum)
