"""Clustering: assignment and update as DataFrame steps, seeding, Lloyd's loop, hierarchy, and quality.

Centroids are a small model (clusters x dimensions) that the driver holds and sends to the tasks; vectors never leave the
executors except as sums. An update is one partial sum for each task and cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.functions import vector
from quarry.operators.knn import matrix


@dataclass
class Clustering:
    centroids: np.ndarray
    inertia: float
    iterations: int


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest centroid, the lower index of equals."""
    step = max(1, 4_000_000 // max(1, len(centroids)))  # bounds the matrix of distances
    c = np.concatenate([vector.pairwise(x[i : i + step], centroids, "l2").argmin(axis=1) for i in range(0, max(1, len(x)), step)])
    return c, np.einsum("ij,ij->i", x - centroids[c], x - centroids[c])


def assign(df: DataFrame, centroids: np.ndarray, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """(id, cid, dist)."""
    sent = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                c, d = nearest(matrix(pdf["vector"]), sent.value)
                yield pd.DataFrame({"id": pdf["id"], "cid": c.astype(np.int32), "dist": d})

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector")).mapInPandas(run, "id bigint, cid int, dist double")


def _sums(df: DataFrame, centroids: np.ndarray, vec: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum and count of each cluster, and the inertia, from one partial row for each task and cluster."""
    k, dim = centroids.shape
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count, cost = np.zeros((k, dim)), np.zeros(k), np.zeros(k)
        for pdf in pdfs:
            if len(pdf):
                x = matrix(pdf["vector"])
                c, d = nearest(x, sent.value)
                np.add.at(total, c, x)
                count += np.bincount(c, minlength=k)
                cost += np.bincount(c, d, minlength=k)
        own = np.flatnonzero(count)
        if len(own):  # an empty list of lists has no Arrow type
            yield pd.DataFrame({"cid": own.astype(np.int32), "s": list(total[own]), "n": count[own], "cost": cost[own]})

    parts = df.select(F.col(vec).alias("vector")).mapInPandas(run, "cid int, s array<double>, n double, cost double")
    each = parts.select("cid", "n", "cost", F.posexplode("s").alias("pos", "v"))
    rows = each.groupBy("cid", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).toPandas()  # clusters x dimensions
    total, count = np.zeros((k, dim)), np.zeros(k)
    total[rows["cid"], rows["pos"]] = rows["v"]
    first = rows[rows["pos"] == 0]
    count[first["cid"]] = first["n"]
    return total, count, float(first["cost"].sum())


def update(df: DataFrame, centroids: np.ndarray, vec: str = "vector") -> np.ndarray:
    """Means of the nearest rows; a cluster without rows keeps its centroid."""
    total, count, _ = _sums(df, centroids, vec)
    return np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)


def mean_by_group(df: DataFrame, group: str, vec: str = "vector") -> DataFrame:
    """(group, pos, mean), positions from 0."""
    return df.select(group, F.posexplode(vec).alias("pos", "v")).groupBy(group, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def lloyd(df: DataFrame, init: np.ndarray, iterations: int = 25, epsilon: float = 1e-4, vec: str = "vector") -> Clustering:
    """From given centroids until the inertia changes by less than a share epsilon, or the iterations are over."""
    c, before, inertia, n = np.asarray(init, float), math.inf, math.inf, 0
    for n in range(1, iterations + 1):
        total, count, inertia = _sums(df, c, vec)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        if before < math.inf and abs(before - inertia) <= epsilon * max(before, 1e-300):
            break
        before = inertia
    return Clustering(c, inertia, n)


def seed_plus_plus(df: DataFrame, k: int, seed: int = 42, vec: str = "vector", id_col: str = "id", rounds: int = 5) -> np.ndarray:
    """k centroids by oversampled D² sampling: a few rounds of 2k expected draws each, then a weighted D² choice of k of the drawn.

    One draw at a time would be k passes over the data.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector"))
    if k < 1:
        raise EngineError("invalid_argument", "k is at least 1", "kmeans")
    first = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).toPandas()
    if not len(first) or rows.count() < k:
        raise EngineError("invalid_argument", "there are fewer rows than clusters", "kmeans")
    c = matrix(first["vector"])
    for r in range(rounds):
        d = assign(rows, c).withColumn("u", (F.pmod(F.xxhash64("id", F.lit(seed + r + 1)), F.lit(1 << 30)) + 0.5) / float(1 << 30))
        phi = d.agg(F.sum("dist")).first()[0]
        if not phi:
            break
        drawn = d.where(F.col("u") < F.col("dist") * (2.0 * k / phi)).select("id")
        got = rows.join(drawn, "id").orderBy("id").toPandas()  # about 2k rows
        if len(got):
            c = np.unique(np.vstack([c, matrix(got["vector"])]), axis=0)
    if len(c) < k:
        more = rows.orderBy(F.xxhash64("id", F.lit(seed - 1)), "id").limit(2 * k).toPandas()
        c = np.unique(np.vstack([c, matrix(more["vector"])]), axis=0)
    _, weight, _ = _sums(rows, c, "vector")
    rng = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    d = vector.pairwise(c, c[chosen], "l2")[:, 0]
    while len(chosen) < min(k, len(c)):
        p = d * np.maximum(weight, 1e-9)
        p[chosen] = 0
        if p.sum() <= 0:
            p = np.ones(len(c))
            p[chosen] = 0
        chosen.append(int(rng.choice(len(c), p=p / p.sum())))
        d = np.minimum(d, vector.pairwise(c, c[chosen[-1:]], "l2")[:, 0])
    return c[chosen]


def cluster(df: DataFrame, k: int = 256, iterations: int = 25, epsilon: float = 1e-4, seed: int = 42, redo: int = 1, vec: str = "vector", id_col: str = "id") -> Clustering:
    """The best by inertia of redo runs, each seeded on its own."""
    runs = [lloyd(df, seed_plus_plus(df, k, seed + r, vec, id_col), iterations, epsilon, vec) for r in range(redo)]
    return min(runs, key=lambda r: r.inertia)


def mini_batch(df: DataFrame, init: np.ndarray, share: float = 0.1, iterations: int = 20, seed: int = 42, vec: str = "vector") -> np.ndarray:
    """Means that follow a fresh seeded sample each round, the more slowly the more rows a cluster has seen."""
    c = np.asarray(init, float)
    seen = np.zeros(len(c))
    for i in range(iterations):
        total, count, _ = _sums(df.sample(share, seed + i), c, vec)
        seen += count
        rate = np.where(seen > 0, count / np.maximum(seen, 1), 0)[:, None]
        c = c + rate * (np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c) - c)
    return c


def hierarchical(df: DataFrame, k: int, branching: int = 8, seed: int = 42, iterations: int = 10, vec: str = "vector", id_col: str = "id") -> np.ndarray:
    """k leaf centroids of a tree: the heaviest leaf is split branching ways until there are k."""
    leaves = [cluster(df, min(branching, k), iterations, seed=seed, vec=vec, id_col=id_col).centroids]
    c = leaves[0]
    while len(c) < k:
        _, count, _ = _sums(df, c, vec)
        heavy = int(count.argmax())
        own = assign(df, c, id_col, vec).where(F.col("cid") == heavy).select("id")
        part = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector")).join(own, "id", "left_semi")
        ways = min(branching, k - len(c) + 1, max(2, int(count[heavy])))
        c = np.vstack([np.delete(c, heavy, axis=0), cluster(part, ways, iterations, seed=seed).centroids])
    return c


def quality(df: DataFrame, centroids: np.ndarray, id_col: str = "id", vec: str = "vector") -> DataFrame:
    """One row: silhouette by centroids (a: root mean square distance to the own one, b: to the nearest other), Davies-Bouldin and Calinski-Harabasz."""
    k = len(centroids)
    d = vector.pairwise(centroids, centroids, "l2")
    sent = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                all_ = vector.pairwise(matrix(pdf["vector"]), sent.value, "l2")
                c = all_.argmin(axis=1)
                own = all_[np.arange(len(c)), c]
                all_[np.arange(len(c)), c] = np.inf
                yield pd.DataFrame({"cid": c.astype(np.int32), "own": own, "other": all_.min(axis=1)})

    rows = df.select(F.col(vec).alias("vector")).mapInPandas(run, "cid int, own double, other double")
    per = rows.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("sq"), F.avg(F.sqrt("own")).alias("spread"), F.avg(F.sqrt("other")).alias("other")).toPandas()  # one row for each cluster
    n = per["n"].sum()
    a, b = np.sqrt(per["sq"] / per["n"]), per["other"]
    silhouette = float((((b - a) / np.maximum(np.maximum(a, b), 1e-300)) * per["n"]).sum() / n) if k > 1 else 0.0
    spread = per.set_index("cid")["spread"]
    ids = list(spread.index)
    worst = [max(((spread[i] + spread[j]) / math.sqrt(d[i, j]) for j in ids if j != i and d[i, j] > 0), default=0.0) for i in ids]
    counts = per.set_index("cid")["n"]
    mean = (np.asarray(centroids)[ids] * counts.to_numpy()[:, None]).sum(axis=0) / n
    between = float((((np.asarray(centroids)[ids] - mean) ** 2).sum(axis=1) * counts.to_numpy()).sum())
    within = float(per["sq"].sum())
    ch = between / (k - 1) / (within / (n - k)) if k > 1 and n > k and within > 0 else 0.0
    return df.sparkSession.createDataFrame([(round(float(silhouette), 6), round(float(np.mean(worst)), 6), round(float(ch), 6))], "silhouette double, davies_bouldin double, calinski_harabasz double")
