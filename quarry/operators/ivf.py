"""Inverted-file index with product codes: rows stored by coarse cell, searched in the cells nearest to a query.

The model (coarse centroids, codebooks, rotation) is small and on the driver; the index is a table (cell, id, codes), partitioned by cell
when saved, so that probing reads only the probed cells.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.functions import vector
from quarry.functions.text import valid_json
from quarry.operators import kmeans, scan
from quarry.operators.knn import SCALE, matrix, rank, top_rows
from quarry.operators.quantize import ProductQuantizer, pq_from, sample_matrix, train_opq


def train_defaults(n: int, dim: int) -> dict[str, int]:
    """Cells, subspaces and training rows for n rows: 512, 2048 or 4096 cells, never more than rows allow; the most of 16, 8, 4 subspaces that divide the dimension."""
    cells = 512 if n < 100_000 else 2048 if n < 1_000_000 else 4096
    m = next((m for m in (16, 8, 4) if dim % m == 0), 1)
    return {"nlist": max(1, min(cells, n // 8)), "m": m, "sample": min(n, 200_000)}


@dataclass
class IvfPq:
    centroids: np.ndarray
    pq: ProductQuantizer
    lists: DataFrame | None = None  #: (cell, id, codes)
    metadata: str = "{}"
    stats: dict = field(default_factory=dict)

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def set_metadata(self, text: str, validator: Callable[[dict], bool] | None = None) -> None:
        if not valid_json(text):
            raise EngineError("invalid_argument", "metadata is JSON of at most 64 KiB", "ivf_pq")
        if validator is not None and not validator(json.loads(text)):
            raise EngineError("precondition_failed", "the validator refused the metadata", "ivf_pq")
        self.metadata = text

    def encode(self, df: DataFrame, id_col: str = "id", vec: str = "vector") -> DataFrame:
        """(cell, id, codes): codes are of the residual to the cell's centroid."""
        c, pq = self.centroids, self.pq

        def run(pdfs):
            for pdf in pdfs:
                if len(pdf):
                    x = matrix(pdf["vector"])
                    cell, _ = kmeans.nearest(x, c)
                    yield pd.DataFrame({"cell": cell.astype(np.int32), "id": pdf["id"], "codes": list(pq.codes(x - c[cell]))})

        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector")).mapInPandas(run, "cell int, id bigint, codes array<smallint>")

    def add(self, df: DataFrame, id_col: str = "id", vec: str = "vector") -> IvfPq:
        """An index that also holds df's rows; an id added again replaces its old entry."""
        new = self.encode(df, id_col, vec)
        old = self.lists
        lists = new if old is None else old.join(new.select("id"), "id", "left_anti").select("cell", "id", "codes").unionByName(new)
        return replace(self, lists=lists)

    def probe(self, queries: DataFrame, nprobe: int = 8) -> DataFrame:
        """(qid, cell, dist, rank): the nearest cells of each query (qid, vector)."""
        c, n = self.centroids, min(nprobe, len(self.centroids))

        def run(pdfs):
            for pdf in pdfs:
                if len(pdf):
                    d = vector.pairwise(matrix(pdf["vector"]), c, "l2")
                    r, at = top_rows(d, np.arange(len(c)), n)
                    yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[r], "cell": at.astype(np.int32), "dist": d[r, at], "rank": np.tile(np.arange(1, n + 1), len(pdf))})

        return queries.select(F.col("qid").cast("bigint").alias("qid"), "vector").mapInPandas(run, "qid bigint, cell int, dist double, rank bigint")

    def search(self, queries: DataFrame, k: int = 10, nprobe: int = 8, raw: DataFrame | None = None, pool: int = 0, allowed: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """(qid, id, score, rank) by code distances in the probed cells; with raw (id, vector) the pool first are ranked by their true distance.

        allowed and deleted (id) apply before the ranking, so k hits are found if there are k.
        """
        lists = self.lists
        if lists is None:
            raise EngineError("precondition_failed", "nothing was added", "ivf_pq")
        if allowed is not None:
            lists = lists.join(allowed.select("id"), "id", "left_semi")
        if deleted is not None:
            lists = lists.join(deleted.select("id"), "id", "left_anti")
        depth = max(k, pool) if raw is not None else k
        c, pq, n = self.centroids, self.pq, min(nprobe, len(self.centroids))
        asked, by_cell = queries.select(F.col("qid").cast("bigint").alias("qid"), "vector"), ["cell", "id", "codes"]
        view = lambda block, asks: {"key": block["vector"] if asks else c[block["cell"]] + pq.reconstruct(block["codes"]), "cell": block.get("cell"), "raw": block.get("vector")}
        cells = lambda x: near_cells(np.asarray(x, float), c, n)
        if raw is None:
            return rank(scan.top(asked, lists.select(by_cell).sortWithinPartitions("cell"), scan.Vectors("l2"), k, view=view, cells=cells), k)
        rows = lists.select(by_cell).join(raw.select(F.col("id").cast("bigint").alias("id"), "vector"), "id", "left").sortWithinPartitions("cell")
        return rank(scan.top(asked, rows, scan.Vectors("l2"), depth, view=view, cells=cells, stages=((scan.Vectors("l2"), scan.same, "raw", k),)), k)

    def reconstruct(self) -> DataFrame:
        """(id, cell, vector) of every entry, from centroid and codes."""
        c, pq = self.centroids, self.pq

        def run(pdfs):
            for pdf in pdfs:
                if len(pdf):
                    v = c[pdf["cell"].to_numpy()] + pq.reconstruct(np.stack(pdf["codes"].to_numpy()))
                    yield pd.DataFrame({"id": pdf["id"], "cell": pdf["cell"], "vector": list(v)})

        return self.lists.select("id", "cell", "codes").mapInPandas(run, "id bigint, cell int, vector array<double>")

    def update_centroid(self, cell: int, centroid: np.ndarray, raw: DataFrame) -> IvfPq:
        """The cell's centroid moved, its rows encoded anew from raw (id, vector)."""
        c = self.centroids.copy()
        c[cell] = centroid
        new = replace(self, centroids=c)
        rows = raw.join(self.lists.where(F.col("cell") == cell).select("id"), "id", "left_semi")
        return replace(new, lists=self.lists.where(F.col("cell") != cell).unionByName(new._encode_in(rows, cell)))

    def _encode_in(self, rows: DataFrame, cell: int) -> DataFrame:
        c, pq = self.centroids, self.pq

        def run(pdfs):
            for pdf in pdfs:
                if len(pdf):
                    yield pd.DataFrame({"cell": np.int32(cell), "id": pdf["id"], "codes": list(pq.codes(matrix(pdf["vector"]) - c[cell]))})

        return rows.select("id", "vector").mapInPandas(run, "cell int, id bigint, codes array<smallint>")

    def reassign(self, ids: DataFrame, cell: int, raw: DataFrame) -> IvfPq:
        rows = raw.join(ids.select("id"), "id", "left_semi")
        return replace(self, lists=self.lists.join(ids.select("id"), "id", "left_anti").select("cell", "id", "codes").unionByName(self._encode_in(rows, cell)))

    def compact(self, deleted: DataFrame) -> IvfPq:
        return replace(self, lists=self.lists.join(deleted.select("id"), "id", "left_anti").select("cell", "id", "codes"))

    def list_sizes(self) -> DataFrame:
        """(cell, n) of the cells that have rows."""
        return self.lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))

    def explain_rank(self, queries: DataFrame, target: DataFrame) -> DataFrame:
        """(qid, id, score, rank) of target (qid, id) in the order of code distances over all cells."""
        hits = self.search(queries, self.lists.count(), len(self.centroids))
        return hits.join(target.select("qid", "id"), ["qid", "id"], "left_semi")

    def save(self, path: str) -> None:
        spark = self.lists.sparkSession
        self.lists.write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{path}/lists")
        model = {"centroids": self.centroids.tolist(), "codebooks": self.pq.codebooks.tolist(), "rotation": None if self.pq.rotation is None else self.pq.rotation.tolist(), "metadata": self.metadata}
        spark.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> IvfPq:
    model = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
    rotation = None if model["rotation"] is None else np.array(model["rotation"])
    return IvfPq(np.array(model["centroids"]), ProductQuantizer(np.array(model["codebooks"]), rotation), spark.read.parquet(f"{path}/lists").select("cell", "id", "codes"), model["metadata"])


def train(df: DataFrame, nlist: int = 256, m: int = 8, bits: int = 8, opq: bool = False, seed: int = 42, sample: int = 200_000, iterations: int = 20, id_col: str = "id", vec: str = "vector") -> IvfPq:
    """Coarse cells, then codes of the residuals, both from at most sample rows on the driver."""
    x = sample_matrix(df, sample, vec, id_col, seed)
    if len(x) < nlist or len(x) < 1 << bits or x.shape[1] % m:
        raise EngineError("invalid_argument", "too few rows for the cells or codes, or a dimension that m doesn't divide", "ivf_pq")
    from quarry.operators.quantize import _fit_codes

    c = _fit_codes(x, nlist, seed, iterations)
    cell, _ = kmeans.nearest(x, c)
    residual = x - c[cell]
    if opq:
        frame = df.sparkSession.createDataFrame([(i, r.tolist()) for i, r in enumerate(residual)], "id bigint, vector array<double>")
        return IvfPq(c, train_opq(frame, m, bits, seed=seed, sample=len(x)))
    return IvfPq(c, pq_from(residual, m, bits, seed))


def near_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Rows x cells: whether the cell is one of the n nearest."""
    r, at = top_rows(vector.pairwise(x, centroids, "l2"), np.arange(len(centroids)), n)
    out = np.zeros((len(x), len(centroids)), bool)
    out[r, at] = True
    return out


def flat_search(queries: DataFrame, base: DataFrame, centroids: np.ndarray, k: int = 10, nprobe: int = 8) -> DataFrame:
    """(qid, id, score, rank) by true distances (queries: qid, vector; base: id, vector) in the cells nearest to each query."""
    c, n = centroids, min(nprobe, len(centroids))
    view = lambda block, asks: {"key": block["vector"], "cell": None if asks else kmeans.nearest(np.asarray(block["vector"], float), c)[0]}
    rows = base.select(F.col("id").cast("bigint").alias("id"), "vector").where("vector is not null")
    return rank(scan.top(queries.select(F.col("qid").cast("bigint").alias("qid"), "vector"), rows, scan.Vectors("l2"), k, view=view, cells=lambda x: near_cells(np.asarray(x, float), c, n)), k)


def rerank(hits: DataFrame, queries: DataFrame, raw: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(qid, id, score, rank): hits ordered by the true distance of their vectors (raw: id, vector)."""
    q = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("vector").alias("qvec"))
    rows = hits.select("qid", "id").join(raw.select(F.col("id").cast("bigint").alias("id"), "vector"), "id").join(q, "qid")
    return rank(rows.select("qid", "id", F.round(vector.score(metric, F.col("qvec"), F.col("vector")), SCALE).alias("score")), k)


def rerank_pool(k: int, nprobe: int, alpha: float = 2.0, ceiling: int = 2000) -> int:
    """How many code hits are worth a true distance."""
    return int(min(ceiling, np.ceil(max(k, alpha * k * np.log2(1 + nprobe)))))
