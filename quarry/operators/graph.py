"""Proximity graphs: one for each partition of the vectors, searched by beam; answers of the probed partitions are merged.

Spark tasks share no memory, so a graph never spans partitions: vectors are grouped by coarse cell and each group builds
its own, in one task. The graph is a table (cell, id, vector, neighbours, entry).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vector
from quarry.operators import kmeans
from quarry.operators.knn import SCALE, matrix, rank
from quarry.operators.quantize import _fit_codes, sample_matrix

SCHEMA = "cell int, id bigint, vector array<float>, neighbours array<int>, entry boolean"


def robust_prune(node: int, candidates: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Neighbours of a node: the nearest candidate is kept and drops those it is alpha times nearer to than the node is."""
    c = np.unique(candidates[candidates != node])
    d = ((x[c] - x[node]) ** 2).sum(axis=1)
    order = np.lexsort((c, d))
    c, d = c[order], d[order]
    own = x[c]
    sq = np.einsum("ij,ij->i", own, own)
    between = (alpha * alpha) * np.maximum(sq[:, None] + sq[None] - 2 * (own @ own.T), 0) > d[None]  # row: a kept one, column: stays
    kept: list[int] = []
    alive, i = np.ones(len(c), bool), 0
    while True:
        i += int(alive[i:].argmax()) if i < len(c) else 0
        if i >= len(c) or not alive[i]:
            break
        kept.append(int(c[i]))
        if len(kept) == degree:
            break
        alive &= between[i]
        i += 1
    return kept


def greedy(q: np.ndarray, x: np.ndarray, links: list[list[int]], entries: list[int], beam: int) -> tuple[list[tuple[float, int]], set[int]]:
    """(beam nearest found as (distance, node), nodes visited) from the entries."""
    seen = set(entries)
    d = ((x[entries] - q) ** 2).sum(axis=1)
    todo = [(float(a), e) for a, e in zip(d, entries)]
    heapq.heapify(todo)
    best = [(-a, -e) for a, e in todo]
    heapq.heapify(best)
    while len(best) > beam:
        heapq.heappop(best)
    visited = set()
    while todo:
        a, n = heapq.heappop(todo)
        if len(best) >= beam and a > -best[0][0]:
            break
        visited.add(n)
        new = [m for m in links[n] if m not in seen]
        if not new:
            continue
        seen.update(new)
        for b, m in zip(((x[new] - q) ** 2).sum(axis=1).tolist(), new):
            if len(best) < beam or b < -best[0][0]:
                heapq.heappush(todo, (b, m))
                heapq.heappush(best, (-b, -m))
                if len(best) > beam:
                    heapq.heappop(best)
    return sorted((-a, -m) for a, m in best), visited


def padded(links: list) -> np.ndarray:
    """Links as a matrix, places without a link being len(links)."""
    width = max((len(v) for v in links), default=0)
    out = np.full((len(links), max(1, width)), len(links), np.int64)
    for i, v in enumerate(links):
        out[i, : len(v)] = v
    return out


def greedy_all(q: np.ndarray, x: np.ndarray, links: np.ndarray, entries: list[int], beam: int, at_once: int = 4, walked: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distances, nodes) of the beam nearest found for each query, sorted, inf and len(x) where there are fewer: as :func:`greedy`,
    for all queries in step, each walking on from its at_once nearest nodes until none of its beam is left to walk from. walked: gets the (queries, nodes) walked from."""
    n, m = len(x), len(q)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    start = np.asarray(entries)
    seen[:, start] = True
    d = vector.pairwise(q, x[start], "l2")
    order = np.argsort(d, axis=1, kind="stable")[:, :beam]
    best = np.full((m, beam), np.inf)
    node = np.full((m, beam), n)
    best[:, : order.shape[1]], node[:, : order.shape[1]] = np.take_along_axis(d, order, axis=1), start[order]
    todo = node < n
    active = np.arange(m)
    while len(active):
        mine = todo[active]
        turn = mine & (np.cumsum(mine, axis=1) <= at_once)
        r, c = np.nonzero(turn)
        todo[active[r], c] = False
        if walked is not None:
            walked.append((active[r], node[active[r], c]))
        rows, to = np.repeat(active[r], links.shape[1]), links[node[active[r], c]].ravel()
        new = ~seen[rows, to]
        pair = np.unique(rows[new] * (n + 1) + to[new])
        rows, to = np.divmod(pair, n + 1)
        seen[rows, to] = True
        diff = x[to] - q[rows]
        dist = np.einsum("ij,ij->i", diff, diff)
        near = dist < best[rows, -1]
        rows, to, dist = rows[near], to[near], dist[near]
        who, first, many = np.unique(rows, return_index=True, return_counts=True)
        if len(who):
            place = np.arange(len(rows)) - np.repeat(first, many)
            wide = beam + int(many.max())
            b, v, t = np.full((len(who), wide), np.inf), np.full((len(who), wide), n), np.zeros((len(who), wide), bool)
            b[:, :beam], v[:, :beam], t[:, :beam] = best[who], node[who], todo[who]
            k = np.repeat(np.arange(len(who)), many)
            b[k, beam + place], v[k, beam + place], t[k, beam + place] = dist, to, True
            order = np.argsort(b, axis=1, kind="stable")[:, :beam]
            best[who], node[who], todo[who] = (np.take_along_axis(y, order, axis=1) for y in (b, v, t))
        active = active[todo[active].any(axis=1)]
    return best, node


def build_graph(x: np.ndarray, degree: int = 64, alpha: float = 1.2, beam: int = 128, rounds: int = 2, seed: int = 1337) -> tuple[list[list[int]], list[int]]:
    """(links, entries): a random regular graph, then rounds that search each node and prune what was visited, the last with alpha.

    Nodes are searched some at a time, in the graph as it was before them.
    """
    n = len(x)
    together = max(1, min(128, n // 20))
    rng = np.random.default_rng(seed)
    if n <= degree + 1:
        return [[j for j in range(n) if j != i] for i in range(n)], [0] if n else []
    links = [[int(j) for j in rng.choice(n, degree, replace=False) if j != i] for i in range(n)]
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    for r in range(rounds):
        a = alpha if r == rounds - 1 else 1.0
        order = rng.permutation(n)
        for first in range(0, n, together):
            own = order[first : first + together]
            walked: list = []
            greedy_all(x[own], x, padded(links), [start], beam, walked=walked)
            rows, nodes = (np.concatenate(v) for v in zip(*walked))
            by = np.argsort(rows, kind="stable")
            for i, visited in zip(own.tolist(), np.split(nodes[by], np.cumsum(np.bincount(rows, minlength=len(own)))[:-1])):
                links[i] = robust_prune(i, np.concatenate([visited, np.array(links[i], dtype=np.int64)]), x, degree, a)
                for j in links[i]:
                    if i not in links[j]:
                        links[j].append(i)
                        if len(links[j]) > degree + degree // 2:  # not at each link that is too many
                            links[j] = robust_prune(j, np.array(links[j]), x, degree, a)
        for j in range(n):
            if len(links[j]) > degree:
                links[j] = robust_prune(j, np.array(links[j]), x, degree, a)
    degrees = np.zeros(n, np.int64)
    for own in links:
        degrees[own] += 1
    top = np.lexsort((np.arange(n), -degrees))[: max(1, min(50, n // 100))].tolist()
    return links, sorted({start, *top})


def hnsw_levels(n: int, m: int = 16, seed: int = 42) -> np.ndarray:
    """floor(-ln(u) / ln(m)) for each node."""
    u = np.random.default_rng(seed).random(n)
    return np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(int)


def build_hnsw(x: np.ndarray, m: int = 16, ef: int = 200, seed: int = 42) -> tuple[list[list[int]], list[int]]:
    """The base layer of a layered graph: nodes go in by falling level, are linked to the ef nearest of those that are in, pruned for
    diversity; the nodes of level 1 and up are the entries."""
    n = len(x)
    levels = hnsw_levels(n, m, seed)
    links: list[list[int]] = [[] for _ in range(n)]
    order = np.lexsort((np.arange(n), -levels))
    entry = [int(order[0])] if n else []
    for i, found in _earlier(x, order, ef):
        links[i] = robust_prune(i, found, x, m, 1.0)
        for j in links[i]:
            links[j].append(i)
            if len(links[j]) > 2 * m:
                links[j] = robust_prune(j, np.array(links[j]), x, 2 * m, 1.0)
    upper = np.flatnonzero(levels > 0)
    return links, sorted({*entry, *upper[:64].tolist()})


def _earlier(x: np.ndarray, order: np.ndarray, ef: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, the ef nearest nodes before it in order), in that order, by products of matrices."""
    own = x[order].astype(np.float32)
    sq = np.einsum("ij,ij->i", own, own)
    for i in range(0, len(own), 256):
        end = min(i + 256, len(own))
        d = sq[None, :end] - 2 * (own[i:end] @ own[:end].T)
        d[np.arange(end)[None] >= np.arange(i, end)[:, None]] = np.inf
        near = np.argpartition(d, ef - 1, axis=1)[:, :ef] if end > ef else np.tile(np.arange(end), (end - i, 1))
        for r in range(end - i):
            if i + r:
                yield int(order[i + r]), order[near[r][near[r] < i + r]]


@dataclass
class GraphIndex:
    """centroids route queries to partitions; nodes is the table of SCHEMA."""

    centroids: np.ndarray
    nodes: DataFrame

    def search(self, queries: DataFrame, k: int = 10, beam: int = 100, nprobe: int = 4, allowed: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """(qid, id, score, rank) of queries (qid, vector): beam search in the nprobe nearest partitions. Rows not allowed or
        deleted (id) are walked through but never returned."""
        c, n = self.centroids, min(nprobe, len(self.centroids))

        def probe(pdfs):
            for pdf in pdfs:
                if len(pdf):
                    d = vector.pairwise(matrix(pdf["vector"]), c, "l2")
                    at = np.argsort(d, axis=1, kind="stable")[:, :n]
                    yield pd.DataFrame({"qid": np.repeat(pdf["qid"].to_numpy(), n), "cell": at.ravel().astype(np.int32), "vector": [v for v in pdf["vector"] for _ in range(n)]})

        nodes = self.nodes.withColumn("ok", F.lit(True))
        if allowed is not None:
            nodes = nodes.drop("ok").join(allowed.select("id", F.lit(True).alias("ok")), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        if deleted is not None:
            nodes = nodes.join(deleted.select("id", F.lit(True).alias("gone")), "id", "left").withColumn("ok", F.col("ok") & F.col("gone").isNull()).drop("gone")

        def scan(q: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(own):
                own = own.sort_values("place").reset_index(drop=True)
                x, ids, ok = matrix(own["vector"]), own["id"].to_numpy(), own["ok"].to_numpy(bool)
                links = [list(v) for v in own["neighbours"]]
                entries = np.flatnonzero(own["entry"].to_numpy(bool)).tolist()
                if not ok.all():
                    for qid, v in zip(q["qid"], q["vector"]):
                        found, _ = greedy(np.asarray(v, float), x, links, entries, len(x))
                        hits = sorted((round(d, SCALE), int(ids[j])) for d, j in found if ok[j])[:k]
                        out += [(qid, i, d) for d, i in hits]
                    return pd.DataFrame(out, columns=["qid", "id", "score"]).astype({"qid": "int64", "id": "int64", "score": "float64"})
                wide, qids, vectors = padded(links), q["qid"].to_numpy(), q["vector"].to_numpy()
                step = max(1, min(512, 32_000_000 // (len(x) + 1)))
                for i in range(0, len(q), step):
                    d, at = greedy_all(np.stack(vectors[i : i + step]).astype(float), x, wide, entries, max(beam, k))
                    d, id_ = np.round(d, SCALE), np.append(ids, np.iinfo(np.int64).max)[at]
                    r = np.repeat(np.arange(len(d)), d.shape[1])
                    order = np.lexsort((id_.ravel(), d.ravel(), r)).reshape(d.shape)[:, :k].ravel()
                    order = order[np.isfinite(d.ravel()[order])]
                    out.append(pd.DataFrame({"qid": qids[i + r[order]], "id": id_.ravel()[order], "score": d.ravel()[order]}))
            return pd.concat(out) if out else pd.DataFrame({"qid": [], "id": [], "score": []}).astype({"qid": "int64", "id": "int64", "score": "float64"})

        asked = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).mapInPandas(probe, "qid bigint, cell int, vector array<double>")
        hits = asked.groupBy("cell").cogroup(nodes.groupBy("cell")).applyInPandas(scan, "qid bigint, id bigint, score double")
        return rank(hits, k)

    def neighbours(self) -> DataFrame:
        """(id, neighbour) edges; the reverse ones by exchanging the columns."""
        edge = self.nodes.select("cell", "id", F.explode("neighbours").alias("place"))
        return edge.join(self.nodes.select("cell", "place", F.col("id").alias("neighbour")), ["cell", "place"]).select("id", "neighbour")

    def degree_stats(self) -> DataFrame:
        d = F.size("neighbours")
        return self.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.sum(d).cast("bigint").alias("edges"), F.min(d).cast("bigint").alias("least"), F.max(d).cast("bigint").alias("most"), F.round(F.avg(d), SCALE).alias("mean"))

    def reachable(self) -> DataFrame:
        """(cell, nodes, reached) from the entries of each partition."""

        def walk(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("place")
            links, todo = [list(v) for v in own["neighbours"]], np.flatnonzero(own["entry"].to_numpy(bool)).tolist()
            seen = set(todo)
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            return pd.DataFrame({"cell": [own["cell"].iloc[0]], "nodes": [len(own)], "reached": [len(seen)]})

        return self.nodes.groupBy("cell").applyInPandas(walk, "cell int, nodes bigint, reached bigint")

    def repair(self, deleted: DataFrame, degree: int = 64, alpha: float = 1.2) -> GraphIndex:
        """Without the deleted rows: a node that lost a neighbour gets the lost one's neighbours as candidates and is pruned again."""
        nodes = self.nodes.join(deleted.select("id", F.lit(True).alias("gone")), "id", "left").withColumn("gone", F.col("gone").isNotNull())

        def mend(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("place").reset_index(drop=True)
            x, gone, links = matrix(own["vector"]), own["gone"].to_numpy(bool), [list(v) for v in own["neighbours"]]
            live = np.flatnonzero(~gone)
            at = np.full(len(own), -1)
            at[live] = np.arange(len(live))
            out = []
            for i in live.tolist():
                lost = [j for j in links[i] if gone[j]]
                kept = [j for j in links[i] if not gone[j]]
                if lost:
                    kept = robust_prune(i, np.array(sorted({*kept, *(m for j in lost for m in links[j] if not gone[m])} - {i}), dtype=np.int64), x, degree, alpha)
                out.append([int(at[j]) for j in kept])
            rest = own.iloc[live]
            entry = rest["entry"].to_numpy(bool).copy()
            if len(entry) and not entry.any():
                entry[0] = True
            return pd.DataFrame({"cell": rest["cell"], "place": np.arange(len(live)), "id": rest["id"], "vector": rest["vector"], "neighbours": out, "entry": entry})

        return replace(self, nodes=nodes.groupBy("cell").applyInPandas(mend, "place int, " + SCHEMA).select(*self.nodes.columns))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/nodes")
        self.nodes.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> GraphIndex:
    c = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()
    return GraphIndex(matrix(c["centroid"]), spark.read.parquet(f"{path}/nodes"))


def build(df: DataFrame, kind: str = "vamana", rows_per_partition: int = 20_000, seed: int = 42, id_col: str = "id", vec: str = "vector", **params) -> GraphIndex:
    """Partitions of about rows_per_partition rows by coarse cell, a graph in each; kind: vamana or hnsw. An id's latest row should be the only one."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vector"))
    n = rows.count()
    cells = max(1, -(-n // rows_per_partition))
    c = _fit_codes(sample_matrix(rows, 50_000), cells, seed)
    placed = rows.join(kmeans.assign(rows, c).select("id", "cid"), "id")
    make = build_hnsw if kind == "hnsw" else build_graph

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        links, entries = make(matrix(pdf["vector"]), **params)
        return pd.DataFrame({"place": np.arange(len(pdf)), "cell": pdf["cid"], "id": pdf["id"], "vector": pdf["vector"], "neighbours": links, "entry": np.isin(np.arange(len(pdf)), entries)})

    return GraphIndex(c, placed.groupBy("cid").applyInPandas(grow, "place int, " + SCHEMA))
