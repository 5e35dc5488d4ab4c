"""Occurrences and record counts of every term, kept up to date by signed deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet import session

#: Terms in a bucket, about: buckets grow in number with the terms, so that no task writes more than a few times as many.
BUCKET_TERMS = 20_000
MOST_BUCKETS = 100_000
SCHEMA = "term string, occurrences bigint, records bigint"


def letter_words(text: Column, least: int = 1) -> Column:
    """The longest runs of Unicode letters of the lower-cased text, of at least `least` letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{%d,}" % least), F.lit(0))


def signed(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(text, sign) of records that differ between two snapshots of a collection of texts.

    new and old hold one text per record in column `text`; rows need no key, so a record is its text
    and repeated records count. sign is the number of records with that text added (positive) or gone
    (negative); a changed record is one of each; texts held as often as before give no row. Null texts
    are no records. With no old snapshot every row of new is added, and nothing is shuffled.
    """
    added = new.filter("text is not null").select("text", F.lit(1).alias("sign"))
    if old is None:
        return added
    gone = old.filter("text is not null").select("text", F.lit(-1).alias("sign"))
    by_hash = added.unionByName(gone).groupBy(F.xxhash64("text").alias("h"), "text")  # hash first: cheap to compare
    return by_hash.agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0").select("text", "sign")


def term_changes(changes: DataFrame, least: int = 1) -> DataFrame:
    """(term, occurrences, records): the change in each term's two counts due to signed records, and with a
    null term the change in the number of records.

    A record's words are sorted, so that the first of equal ones counts the record: each record is
    counted inside its own row and only partial sums by term are shuffled, so no common term weighs
    on one task.
    """
    words = F.sort_array(letter_words(F.col("text"), least))
    rows = changes.select("sign", words.alias("w"))
    marked = F.transform("w", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get("w", i - 1) == x), 0).otherwise(1).alias("first")))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("first")))
    flat = rows.select("sign", F.explode(F.concat(marked, itself)).alias("x"))
    return flat.groupBy(F.col("x.term").alias("term")).agg(
        F.sum(F.col("sign").cast("bigint")).alias("occurrences"), F.sum((F.col("sign") * F.col("x.first")).cast("bigint")).alias("records")
    )


class TermCounts:
    """Term counts of a collection, persisted in the shared folder, partitioned by a hash of the term.

    apply() adds the effect of changed records only. It rewrites the buckets that hold a changed term and no
    others, then writes the version's row, which tells the number of records and where each bucket lies and
    makes the version valid. So a lost executor or a failed job leaves the last one in place, and another
    session finds it by the path. Files that neither the last version nor the one before needs are deleted.
    Once terms are four times as many as the buckets are made for, all are spread over more buckets.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = 1, bucket_terms: int = BUCKET_TERMS):
        self.spark, self.path, self.least, self.bucket_terms = spark, path or session.stage_path(spark, "terms"), least, bucket_terms
        self.version, self.n_records, self.n_terms, self.buckets, self.at = 0, 0, 0, 1, {}
        if path:
            done = [int(n[5:]) for n in self._names("") if n.startswith("meta-") and "_SUCCESS" in self._names(n)]
            if done:
                self._read(max(done))

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._fs(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self, version: int) -> None:
        row = self.spark.read.parquet(f"{self.path}/meta-{version}").first()  # one row; at most MOST_BUCKETS places
        self.version, self.n_records, self.n_terms, self.buckets = version, row["records"], row["terms"], row["buckets"]
        self.at = {b: v for b, v in zip(row["bucket"], row["held"])}

    def _held(self, buckets) -> DataFrame:
        """The stored rows of some buckets."""
        paths = [f"{self.path}/v{self.at[b]}/bucket={b}" for b in sorted(buckets) if b in self.at]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(*paths)

    def counts(self) -> DataFrame:
        """(term, occurrences, records) as of the last version; empty before the first."""
        return self._held(self.at)

    def apply(self, new: DataFrame, old: DataFrame | None = None) -> TermCounts:
        """Merge the records that differ between old and new (column `text` each). Returns self."""
        return self.apply_changes(signed(new, old))

    def apply_changes(self, changes: DataFrame) -> TermCounts:
        """Merge changes (text, sign) as they are: 1 for an added record, -1 for a deleted one, both for a changed one."""
        changes = changes.filter("text is not null").select("text", "sign")
        delta = session.stage(term_changes(changes, self.least).filter("term is null or occurrences <> 0 or records <> 0"), "delta")
        told = delta.filter("term is null").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
        fresh = delta.filter("term is not null").count()
        buckets, version = self.buckets, self.version + 1
        if self.n_terms + fresh > 4 * self.bucket_terms * buckets or not self.version:
            buckets = min(MOST_BUCKETS, max(buckets, 1 << max(0, int((self.n_terms + fresh - 1) // self.bucket_terms).bit_length())))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        terms = delta.filter("term is not null").select("term", "occurrences", "records")
        if buckets != self.buckets:
            touched, stored = set(range(buckets)), self.counts()
        else:
            touched = {r["bucket"] for r in terms.select(bucket).distinct().toLocalIterator()}  # at most MOST_BUCKETS
            stored = self._held(touched)
        merged = stored.unionByName(terms).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")) if self.at else terms
        merged = merged.filter("occurrences <> 0 or records <> 0").select("term", "occurrences", "records", bucket)
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        written = {int(n.partition("=")[2]) for n in self._names(f"v{version}") if n.startswith("bucket=")}
        at = {b: v for b, v in self.at.items() if b not in touched} | {b: version for b in written}
        n_terms = self._count(at)
        row = [(self.n_records + told, n_terms, buckets, list(at), list(at.values()))]
        self.spark.createDataFrame(row, "records bigint, terms bigint, buckets int, bucket array<int>, held array<int>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta-{version}")
        before = set(self.at.values())
        self._read(version)
        for name in self._names(""):
            kind, n = ("v", name[1:]) if name.startswith("v") else ("meta-", name[5:])
            if n.isdigit() and int(n) < version and (int(n) not in before | set(at.values()) if kind == "v" else int(n) < version - 1):
                fs, path = self._fs(name)
                fs.delete(path, True)
        return self

    def _count(self, at: dict[int, int]) -> int:
        """Terms held, from the files' footers."""
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in at.items()]
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(*paths).count() if paths else 0

    def marked(self, least_records: int = 3, most_share: float = 0.12) -> DataFrame:
        """counts() with `mark`: 'rare' in fewer than least_records records, 'common' in more than
        most_share of all records, null otherwise; 'rare' wins where both hold. No records, no rows."""
        mark = F.when(F.col("records") < least_records, "rare").when(F.col("records") > F.lit(most_share) * self.n_records, "common")
        return self.counts().select("term", "occurrences", "records", mark.alias("mark"))


def count_terms(abstracts: DataFrame, descriptions: DataFrame, least: int = 3) -> TermCounts:
    """Counts over abstracts.abstract and descriptions.problem, brought in as two deltas."""
    state = TermCounts(abstracts.sparkSession, least=least)
    state.apply(abstracts.select(F.col("abstract").alias("text")))
    return state.apply(descriptions.select(F.col("problem").alias("text")))
