"""Two-dimensional layouts: truncated SVD on the cluster, then t-SNE in one task for a bounded number of points."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exact t-SNE is quadratic in time and memory: points that tsne() takes; more are refused.
MOST_POINTS = 10_000
#: Points of a layout that are laid out among each other; all others are placed by these.
LANDMARKS = 5_000


def truncated_svd(vectors: DataFrame, dims: int = 50, width: int = 4096, rounds: int = 2, seed: int = 9) -> DataFrame:
    """(doc, coordinates): documents projected on the leading right singular directions of their vectors.

    Terms are hashed into `width` columns, so what meets on the driver is at most width x dims however
    large the vocabulary. Directions come from randomised subspace iteration. Signs are fixed by making
    each direction's largest entry positive.
    """
    from driftnet import session

    spark = vectors.sparkSession
    cell = F.pmod(F.xxhash64("term"), F.lit(width)).cast("int")
    rows = session.stage(vectors.groupBy("doc").agg(F.collect_list(F.struct(cell.alias("c"), F.col("w").cast("double").alias("w"))).alias("v")), "rows")
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, dims + 10)))[0]
    for step in range(rounds + 1):
        shared = spark.sparkContext.broadcast(q)

        def product(batches, shared=shared):
            q = shared.value
            out = np.zeros(q.shape)
            for pdf in batches:
                for v in pdf["v"]:
                    c, w = np.array([x["c"] for x in v]), np.array([x["w"] for x in v])
                    np.add.at(out, c, np.outer(w, w @ q[c]))
            yield pd.DataFrame({"m": [out.tobytes()]})

        total = sum((np.frombuffer(r["m"]).reshape(q.shape) for r in rows.select("v").mapInPandas(product, "m binary").toLocalIterator()), np.zeros(q.shape))
        if step == rounds:
            values, u = np.linalg.eigh(q.T @ total)
            q = q @ u[:, np.argsort(-values)[:dims]]
        else:
            q = np.linalg.qr(total)[0]
    q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])
    shared = spark.sparkContext.broadcast(q)

    def project(batches):
        for pdf in batches:
            at = [(np.array([x["w"] for x in v]) @ shared.value[[x["c"] for x in v]]).tolist() for v in pdf["v"]]
            yield pd.DataFrame({"doc": pdf["doc"], "coordinates": at})

    return rows.mapInPandas(project, f"doc {vectors.schema['doc'].dataType.simpleString()}, coordinates array<double>")


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 300, seed: int = 0, start: np.ndarray | None = None) -> np.ndarray:
    """Exact t-SNE, scaled to 0..1000 on both axes."""
    n = len(x)
    if n > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    if n < 3:
        return np.full((n, 2), 500.0)
    square = (x * x).sum(axis=1)
    d = np.maximum(square[:, None] + square - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    goal, low, high, beta = np.log(min(perplexity, (n - 1) / 3)), np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(40):  # precision of each point by bisection
        p = np.exp(-(d - d.min(axis=1, keepdims=True)) * beta[:, None])
        s = p.sum(axis=1)
        p /= s[:, None]
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = entropy > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).standard_normal((n, 2)) * 1e-4 if start is None else start / max(1e-9, np.abs(start).max()) * 1e-2
    step, gain = np.zeros_like(y), np.ones_like(y)
    for r in range(rounds):
        sy = (y * y).sum(axis=1)
        q = 1 / (1 + np.maximum(sy[:, None] + sy - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        force = ((12 if r < 100 else 1) * p - q / q.sum()) * q
        g = 4 * (force.sum(axis=1)[:, None] * y - force @ y)
        gain = np.maximum(np.where(np.sign(g) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if r < 100 else 0.8) * step - max(n / 48, 50) * gain * g
        y = y + step - (y + step).mean(axis=0)
    span = np.maximum(y.max(axis=0) - y.min(axis=0), 1e-9)
    return (y - y.min(axis=0)) / span * 1000


def scaled(points: DataFrame, to: int = 1000) -> DataFrame:
    """(doc, x, y) with both coordinates spread over 0..to; a coordinate that never changes is 0."""
    ends = points.agg(*[f(c).alias(n + c) for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c: F.round((F.col(c) - F.col("lo" + c)) / F.greatest(F.col("hi" + c) - F.col("lo" + c), F.lit(1e-9)) * to).cast("int").alias(c)
    return points.crossJoin(F.broadcast(ends)).select("doc", at("x"), at("y"))  # ends is one row


def layout(coordinates: DataFrame, rounds: int = 300, landmarks: int = LANDMARKS, near: int = 5) -> DataFrame:
    """(doc, x, y) on a map of 0..1000: t-SNE in one task of all documents up to `landmarks`.

    Of more, that many are drawn by a hash and laid out; each other one is placed at the mean of its
    `near` nearest landmarks, weighted by closeness. Landmarks are sent to all tasks.
    """
    kind = coordinates.schema["doc"].dataType.simpleString()
    rows = coordinates.count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc")
        at = tsne(np.array(pdf["coordinates"].tolist()), rounds=rounds).round().astype(int)
        return pd.DataFrame({"doc": pdf["doc"], "x": at[:, 0], "y": at[:, 1]})

    placed = f"doc {kind}, x int, y int"
    if rows <= landmarks:
        return coordinates.groupBy(F.lit("all")).applyInPandas(run, placed)
    from driftnet import session

    chosen = session.stage(coordinates.orderBy(F.sha2(F.col("doc").cast("string"), 256), "doc").limit(landmarks), "landmarks")
    fixed = session.stage(chosen.groupBy(F.lit("all")).applyInPandas(run, placed), "placed")
    held = fixed.join(chosen, "doc").toPandas()  # at most `landmarks` rows
    shared = coordinates.sparkSession.sparkContext.broadcast((np.array(held["coordinates"].tolist()), held[["x", "y"]].to_numpy(float)))

    def place(batches):
        points, at = shared.value
        for pdf in batches:
            c = np.array(pdf["coordinates"].tolist()).reshape(len(pdf), -1)
            d = np.maximum((c * c).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * c @ points.T, 0)
            j = np.argpartition(d, min(near, len(points)) - 1, axis=1)[:, :near]
            w = 1 / (1e-9 + np.sqrt(np.take_along_axis(d, j, 1)))
            xy = ((at[j] * w[:, :, None]).sum(axis=1) / w.sum(axis=1, keepdims=True)).round().astype(int)
            yield pd.DataFrame({"doc": pdf["doc"], "x": xy[:, 0], "y": xy[:, 1]})

    rest = coordinates.join(fixed.select("doc"), "doc", "left_anti")
    return fixed.unionByName(rest.mapInPandas(place, placed))


def reused(folder: str, vectors: DataFrame, make) -> DataFrame:
    """make(vectors), or what it gave before if the vectors are the same: their digest lies beside the map.

    The digest is the sum and the exclusive or of rows' hashes, so the order of rows makes no difference.
    """
    spark = vectors.sparkSession
    h = F.xxhash64(*vectors.columns)
    one = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")).cast("string"), F.lit("")).alias("s"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")).first()
    name = hashlib.sha256(repr(tuple(one)).encode()).hexdigest()[:16]
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/map-{name}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make(vectors).write.mode("overwrite").parquet(f"{folder}/map-{name}")
    return spark.read.parquet(f"{folder}/map-{name}")
