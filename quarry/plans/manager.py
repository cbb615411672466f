"""Index choice, query planning, hybrid search, and a facade over all index kinds."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.operators import bm25, filters, fusion, graph, ivf
from quarry.operators.knn import knn, rank


def choose_index(n: int, dim: int, budget_mb: int = 1024) -> str:
    """hnsw below 100,000 rows that fit, ivf_pq below 10 million that fit, vamana beyond."""
    budget = budget_mb << 20
    if n < 100_000 and n * (4 * dim + 64) <= budget:
        return "hnsw"
    return "ivf_pq" if n < 10_000_000 and 32 * n <= budget else "vamana"


def hybrid_indexes(n: int, budget_mb: int = 1024) -> list[str]:
    """All kinds that suit n rows."""
    return [k for k, ok in (("hnsw", n <= 1_000_000), ("ivf_pq", 10_000 <= n <= 10_000_000), ("vamana", n >= 100_000 and budget_mb >= 512)) if ok]


@dataclass
class Plan:
    kind: str
    cost: float
    recall: float
    why: str


def plan_query(n: int, matching: float, available: list[str], k: int = 10, target_recall: float = 0.95) -> Plan:
    """The cheapest way with the recall asked for; few matching rows are scanned whatever there is.

    Cost counts distances: all matching rows for a scan, the share of probed cells for lists, beam times degree for graphs.
    """
    rows = n * matching
    ways = [Plan("flat", rows, 1.0, "scan of the matching rows")]
    if "ivf_pq" in available:
        ways.append(Plan("ivf_pq", rows * 0.1 + 2000, 0.9, "code scan of the probed cells, then re-rank"))
    for kind in ("hnsw", "vamana"):
        if kind in available:
            ways.append(Plan(kind, 64 * 100 / max(matching, 1e-6), 0.97, "beam search; the filter thins the beam"))
    good = [w for w in ways if w.recall >= target_recall] or ways
    best = min(good, key=lambda w: (w.cost, w.kind))
    return Plan("flat", rows, 1.0, "few rows match") if rows <= max(10_000, 10 * k) else best


def demote_for_budget(usage: dict[str, tuple[int, float]], budget: int) -> list[tuple[str, str]]:
    """(index, new kind) until the bytes fit: the least used first, from hnsw to ivf_pq to vamana. usage: kind: (bytes, uses)."""
    total, out = sum(b for b, _ in usage.values()), []
    smaller = {"hnsw": ("ivf_pq", 0.1), "ivf_pq": ("vamana", 0.2)}
    for kind, (size, _) in sorted(usage.items(), key=lambda x: (x[1][1], x[0])):
        if total <= budget:
            break
        if kind in smaller:
            to, share = smaller[kind]
            out.append((kind, to))
            total -= int(size * (1 - share))
    return out


def repair_action(deleted: float) -> str:
    """By share of deleted rows: nothing, relink, compact lists, robust prune, rebuild."""
    for at, what in ((0.3, "rebuild"), (0.2, "robust_prune"), (0.15, "compact"), (0.1, "recentre"), (0.05, "relink")):
        if deleted >= at:
            return what
    return "none"


@dataclass
class HybridConfig:
    k: int = 10
    strategy: str = "auto"  #: auto, parallel, dense_first, sparse_first
    method: str = "rrf"
    rrf_k: float = 60.0
    weights: tuple[float, float] = (0.5, 0.5)
    depth: int = 10  #: candidates of each side for each hit


def route(has_text: bool, has_vector: bool, strategy: str = "auto") -> str:
    if not has_text and not has_vector:
        raise EngineError("invalid_argument", "neither text nor vector", "hybrid")
    if has_text and has_vector:
        return "parallel" if strategy == "auto" else strategy
    return "sparse_only" if has_text else "dense_only"


def hybrid_search(queries: DataFrame, index: bm25.Bm25Index, base: DataFrame, config: HybridConfig = HybridConfig(), allowed: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) for queries (qid, text, vector), either null; base (id, vector). allowed (id) filters both sides first.

    dense_first and sparse_first let only the first side's candidates into the second.
    """
    has = queries.agg(F.max(F.coalesce(F.length("text") > 0, F.lit(False))).alias("t"), F.max(F.coalesce(F.size("vector") > 0, F.lit(False))).alias("v")).first()
    way = route(bool(has["t"]), bool(has["v"]), config.strategy)
    n = config.k * config.depth
    asked = queries.where("vector is not null")
    rows = base if allowed is None else base.join(allowed.select("id"), "id", "left_semi")
    docs = None if allowed is None else allowed.select(F.col("id").alias("doc_id"))
    dense = (lambda rows=rows: knn(asked, rows, n).withColumn("score", -F.col("score"))) if way != "sparse_only" else None
    sparse = (lambda docs=docs: bm25.search(index, queries.where("text is not null"), n, allowed=docs)) if way != "dense_only" else None
    if way == "sparse_only":
        return rank(sparse().select("qid", "id", "score"), config.k, descending=True)
    if way == "dense_only":
        return rank(dense().select("qid", "id", "score"), config.k, descending=True)
    d, s = dense(), sparse()
    if way == "dense_first":
        s = rank(s.join(d.select("qid", "id"), ["qid", "id"], "left_semi").drop("rank"), None, descending=True)
    elif way == "sparse_first":
        d = rank(d.join(s.select("qid", "id"), ["qid", "id"], "left_semi").drop("rank"), None, descending=True)
    return fusion.fuse(d, s, config.method, config.k, config.rrf_k, config.weights)


@dataclass
class IndexManager:
    """Vectors (id, vector), their metadata, tombstones and the indexes over them."""

    base: DataFrame
    dim: int
    budget_mb: int = 1024
    indexes: dict[str, object] = field(default_factory=dict)
    metadata: DataFrame | None = None
    deleted: DataFrame | None = None

    def build(self, kinds: list[str] | None = None, **params) -> IndexManager:
        n = self.base.count()
        for kind in kinds or [choose_index(n, self.dim, self.budget_mb)]:
            if kind == "ivf_pq":
                p = ivf.train_defaults(n, self.dim) | params
                bits = 8 if n >= 2048 else 4
                self.indexes[kind] = ivf.train(self.base, p["nlist"], p["m"], bits, sample=p["sample"]).add(self.base)
            elif kind in ("hnsw", "vamana"):
                self.indexes[kind] = graph.build(self.base, kind, **params)
            elif kind != "flat":
                raise EngineError("unsupported", f"no index {kind}", "manager")
        return self

    def add(self, rows: DataFrame) -> None:
        """Add or replace; lists take the rows at once, graphs are built anew."""
        self.base = self.base.join(rows.select("id"), "id", "left_anti").select("id", "vector").unionByName(rows.select("id", "vector"))
        if self.deleted is not None:
            self.deleted = self.deleted.join(rows.select("id"), "id", "left_anti")
        for kind, index in list(self.indexes.items()):
            self.indexes[kind] = index.add(rows) if kind == "ivf_pq" else graph.build(self.base, kind)

    update = add

    def remove(self, ids: DataFrame) -> None:
        own = ids.select("id").distinct()
        self.deleted = own if self.deleted is None else self.deleted.union(own).distinct()

    def search(self, queries: DataFrame, k: int = 10, expr: filters.Filter | None = None, kind: str | None = None, nprobe: int = 8, beam: int = 100) -> DataFrame:
        """(qid, id, score, rank): deleted and filtered rows are out before the ranking, so k hits are found if there are k."""
        allowed = None
        if expr is not None:
            if self.metadata is None:
                raise EngineError("precondition_failed", "no metadata", "manager")
            allowed = self.metadata.where(filters.compile_filter(expr, self.metadata)).select("id")
        kind = kind or plan_query(self.base.count(), 1.0, list(self.indexes), k).kind
        if kind == "flat" or kind not in self.indexes:
            rows = self.base if allowed is None else self.base.join(allowed, "id", "left_semi")
            return knn(queries, rows, k, exclude=self.deleted)
        index = self.indexes[kind]
        if kind == "ivf_pq":
            return index.search(queries, k, nprobe, self.base, ivf.rerank_pool(k, nprobe), allowed, self.deleted)
        return index.search(queries, k, beam, nprobe, allowed, self.deleted)

    def optimize(self) -> None:
        """Drop deleted rows from the vectors and mend or compact the indexes."""
        if self.deleted is None:
            return
        self.base = self.base.join(self.deleted, "id", "left_anti")
        for kind, index in list(self.indexes.items()):
            self.indexes[kind] = index.compact(self.deleted) if kind == "ivf_pq" else index.repair(self.deleted)
        self.deleted = None

    def save(self, path: str) -> None:
        spark = self.base.sparkSession
        self.base.write.mode("overwrite").parquet(f"{path}/vectors")
        for kind, index in self.indexes.items():
            index.save(f"{path}/{kind}")
        for name, df in (("metadata", self.metadata), ("tombstones", self.deleted)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest = {"dim": self.dim, "budget_mb": self.budget_mb, "indexes": sorted(self.indexes), "metadata": self.metadata is not None, "tombstones": self.deleted is not None}
        spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load_manager(spark: SparkSession, path: str) -> IndexManager:
    m = json.loads(spark.read.parquet(f"{path}/manifest").first()[0])
    out = IndexManager(spark.read.parquet(f"{path}/vectors"), m["dim"], m["budget_mb"])
    for kind in m["indexes"]:
        out.indexes[kind] = ivf.load(spark, f"{path}/{kind}") if kind == "ivf_pq" else graph.load(spark, f"{path}/{kind}")
    if m["metadata"]:
        out.metadata = spark.read.parquet(f"{path}/metadata")
    if m["tombstones"]:
        out.deleted = spark.read.parquet(f"{path}/tombstones")
    return out
