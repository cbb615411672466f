"""Cascade over clusters: prune groups of clusters by signatures, order the rest by a learned probability, scan, refine."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vector
from quarry.operators import kmeans, scan
from quarry.operators.knn import matrix, rank
from quarry.operators.quantize import _fit_codes, sample_matrix, train_scalar


@dataclass
class Cascade:
    """Clusters, their groups, the groups' signatures (projection extremes, radius), weights of the probe model, rows by cluster."""

    centroids: np.ndarray
    groups: np.ndarray  #: group of each cluster
    group_centres: np.ndarray
    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    weights: np.ndarray
    rows: DataFrame  #: (cid, id, vector)

    def surviving_groups(self, q: np.ndarray) -> np.ndarray:
        """Queries x groups: within 1.5 median radii or within the projections' bounds; the closest group always."""
        d = np.sqrt(vector.pairwise(q, self.group_centres, "l2"))
        p = q @ self.axes.T
        inside = ((p[:, None] >= self.low[None]) & (p[:, None] <= self.high[None])).mean(axis=2) >= 0.5
        keep = (d <= 1.5 * np.median(self.radius) + self.radius[None]) & inside
        keep[np.arange(len(q)), d.argmin(axis=1)] = True
        return keep

    def probabilities(self, q: np.ndarray) -> np.ndarray:
        """Queries x clusters: softmax of a linear model on scaled distances; pruned clusters have none."""
        d = np.sqrt(vector.pairwise(q, self.centroids, "l2"))
        z = np.stack([d / np.maximum(d.mean(axis=1, keepdims=True), 1e-12), d - d.min(axis=1, keepdims=True)], axis=2) @ self.weights
        z = np.where(self.surviving_groups(q)[:, self.groups], z, -np.inf)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probes(self, queries: DataFrame, confidence: float = 0.95) -> DataFrame:
        """(qid, cid, p) of clusters until their probabilities add up to confidence."""
        me = self

        def run(pdfs):
            for pdf in pdfs:
                if len(pdf):
                    p = me_light.probabilities(matrix(pdf["vector"]))
                    r, c = np.nonzero(p > 0)
                    yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[r], "cid": c.astype(np.int32), "p": p[r, c]})

        me_light = Cascade(me.centroids, me.groups, me.group_centres, me.axes, me.low, me.high, me.radius, me.weights, None)
        found = queries.select(F.col("qid").cast("bigint").alias("qid"), "vector").mapInPandas(run, "qid bigint, cid int, p double")
        w = Window.partitionBy("qid").orderBy(F.col("p").desc(), "cid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return found.withColumn("upto", F.sum("p").over(w)).where(F.col("upto") - F.col("p") < confidence).select("qid", "cid", "p")

    def search(self, queries: DataFrame, k: int = 10, confidence: float = 0.95) -> DataFrame:
        """(qid, id, score, rank): scan of the probed clusters by byte codes, 10 k of them refined by their vectors."""
        scalar = train_scalar(self.rows, margin=0.01)
        lo, step, light = scalar.lo, scalar.step, replace(self, rows=None)
        coded = self.rows.withColumn("codes", scalar.encode(F.col("vector")))
        asked = queries.select(F.col("qid").cast("bigint").alias("qid"), "vector")
        view = lambda block, asks: {"key": block["vector"] if asks else block["codes"] * step + lo, "cell": block.get("cid"), "raw": block["vector"]}
        cells = lambda x: light.probed(np.asarray(x, float), confidence)
        return rank(scan.top(asked, coded.select("id", "cid", "vector", "codes"), scan.Vectors("l2"), 10 * k, view=view, cells=cells, stages=((scan.Vectors("l2"), scan.same, "raw", k),)), k)

    def probed(self, q: np.ndarray, confidence: float) -> np.ndarray:
        """Queries x clusters: whether :meth:`probes` names the cluster."""
        out = np.zeros((len(q), len(self.centroids)), bool)
        for i in range(0, len(q), 1024):
            p = self.probabilities(q[i : i + 1024])
            order = np.argsort(-p, axis=1, kind="stable")
            own = np.take_along_axis(p, order, axis=1)
            np.put_along_axis(out[i : i + 1024], order, (np.cumsum(own, axis=1) - own < confidence) & (own > 0), axis=1)
        return out


def build(df: DataFrame, clusters: int = 64, groups: int = 8, projections: int = 8, seed: int = 42, train_rows: int = 2000, id_col: str = "id", vec: str = "vector") -> Cascade:
    x = sample_matrix(df, 50_000, vec, id_col, seed)
    c = _fit_codes(x, min(clusters, len(x)), seed)
    g = _fit_codes(c, min(groups, len(c)), seed)
    of = kmeans.nearest(c, g)[0]
    axes = vector.random_axes(projections, x.shape[1], seed)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector"))
    assigned = rows.join(kmeans.assign(rows, c).select("id", "cid"), "id")
    super_of = F.get(F.array(*[F.lit(int(s)) for s in of]), F.col("cid"))
    centre = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in g]), F.col("grp"))
    p = vector.project(F.col("vector"), axes)
    sig = assigned.withColumn("grp", super_of).withColumn("p", p).withColumn("r", F.sqrt(vector.l2_sq(F.col("vector"), centre)))
    agg = sig.groupBy("grp").agg(F.max("r").alias("r"), *[f(F.get("p", F.lit(j))).alias(f"{n}{j}") for j in range(projections) for n, f in (("lo", F.min), ("hi", F.max))]).toPandas().set_index("grp")  # one row for each group
    low, high, radius = np.zeros((len(g), projections)), np.zeros((len(g), projections)), np.zeros(len(g))
    for s, row in agg.iterrows():
        radius[s] = row["r"] * 1.1
        low[s], high[s] = [row[f"lo{j}"] for j in range(projections)], [row[f"hi{j}"] for j in range(projections)]
    return Cascade(c, of, g, axes, low, high, radius, fit_probe_weights(x[:train_rows], x, c), assigned.select("cid", "id", "vector"))


def fit_probe_weights(q: np.ndarray, x: np.ndarray, c: np.ndarray, steps: int = 60, rate: float = 0.5) -> np.ndarray:
    """Weights of two scaled distances, by gradient steps on the cross entropy of the cluster of each query's nearest other row."""
    d = np.sqrt(vector.pairwise(q, c, "l2"))
    f = np.stack([d / np.maximum(d.mean(axis=1, keepdims=True), 1e-12), d - d.min(axis=1, keepdims=True)], axis=2)
    closest = np.empty(len(q), np.int64)
    for i in range(0, len(q), 64):  # bounds the matrix of distances
        near = vector.pairwise(q[i : i + 64], x, "l2")
        near[np.arange(len(near)), np.arange(i, i + len(near))] = np.inf
        closest[i : i + 64] = near.argmin(axis=1)
    target = kmeans.nearest(x[closest], c)[0]
    w = np.array([-1.0, -1.0])
    for _ in range(steps):
        z = f @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(q)), target] -= 1
        w = w - rate * np.einsum("qc,qcj->j", p, f) / len(q)
    return w
