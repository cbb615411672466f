"""Exact nearest neighbours, for all queries at once.

Scores are rounded to SCALE digits before they are ranked, ties go to the lower id. Queries are sent to every task if
their size, checked, allows; else each task holds a block of queries and reads the base block by block (:mod:`scan`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vector
from quarry.operators import scan

SCALE = 6
BROADCAST_BYTES = 32 << 20


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k lowest rounded scores, ties by id; nan is no score."""
    n = scores.shape[1]
    rounded = np.round(scores, SCALE)
    rounded = np.where(np.isnan(rounded), np.inf, rounded)
    if n > k:
        limit = np.partition(rounded, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero((rounded <= limit) & np.isfinite(rounded))
    else:
        r, c = np.nonzero(np.isfinite(rounded))
    order = np.lexsort((ids[c], rounded[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r, side="left")
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def rank(scored: DataFrame, k: int | None, by: str = "score", descending: bool = False, id_col: str = "id", name: str = "rank") -> DataFrame:
    """Rows with their rank from 1 within qid, the k first of them; ties by id. Spark keeps k rows of each task before the shuffle."""
    order = [F.col(by).desc() if descending else F.col(by).asc(), F.col(id_col).asc()]
    out = scored.withColumn(name, F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("bigint"))
    return out.where(F.col(name) <= k) if k is not None else out


def knn(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "l2", qid: str = "qid", qvec: str = "vector", id_col: str = "id", vec: str = "vector", where: Column | None = None, exclude: DataFrame | None = None, impl: str = "arrow", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(qid, id, score, rank): each query's k nearest rows of base, of those where holds and that exclude (column id) doesn't name.

    impl: "arrow" scores blocks with numpy, "sql" pairs with expressions; they agree to the rounding.
    """
    rows = base.where(where) if where is not None else base
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector"))
    if exclude is not None:
        rows = rows.join(exclude.select(F.col("id").cast("bigint").alias("id")), "id", "left_anti")
    asked = queries.select(F.col(qid).cast("bigint").alias("qid"), F.col(qvec).alias("qvec"))
    if impl == "sql":
        pairs = rows.crossJoin(asked).select("qid", "id", F.round(vector.score(metric, F.col("qvec"), F.col("vector")), SCALE).alias("score"))
        return rank(pairs.where("score is not null"), k)
    head = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("qvec")), F.lit(0)).alias("d")).first()
    bytes_ = head["n"] * head["d"] * 8
    if bytes_ <= limit:
        return rank(_near_all(asked, rows, k, metric), k)
    return rank(scan.top(asked.select("qid", F.col("qvec").alias("vector")), rows, scan.Vectors(metric), k, count=head["n"]), k)


def _near_all(asked: DataFrame, rows: DataFrame, k: int, metric: str) -> DataFrame:
    own = asked.toPandas()
    sent = rows.sparkSession.sparkContext.broadcast((own["qid"].to_numpy(np.int64), matrix(own["qvec"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        if len(qid):
            scorer = scan.Vectors(metric)
            near = scan.Nearest(scorer, scorer.lift(q, True), k)
            for batch in batches:
                if batch.num_rows:
                    near.feed(batch.column("id").to_numpy(zero_copy_only=False), scorer.lift(scan.to_numpy(batch.column("vector")), False))
            r, ids, score, _ = near.found()
            yield pa.record_batch({"qid": qid[r], "id": ids, "score": score})

    return rows.where("vector is not null").mapInArrow(run, scan.HITS)


def range_search(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", qid: str = "qid", qvec: str = "vector", id_col: str = "id", vec: str = "vector") -> DataFrame:
    """(qid, id, score) of all rows with a score of at most radius."""
    asked = queries.select(F.col(qid).cast("bigint").alias("qid"), F.col(qvec).alias("vector"))
    rows = base.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector"))
    return scan.within(asked, rows, scan.Vectors(metric), radius)


def distance_matrix(a: DataFrame, b: DataFrame, op: str = "l2", id_col: str = "id", vec: str = "vector", impl: str = "arrow") -> DataFrame:
    """(a_id, b_id, d) of all pairs; op also takes "cosine_similarity". impl as in :func:`knn`."""
    if impl == "arrow":
        return _matrix(a, b, op, id_col, vec, False)
    f = vector.cosine_similarity if op == "cosine_similarity" else (vector.inner_product if op == "ip" else lambda x, y: vector.score(op, x, y))
    left = a.select(F.col(id_col).cast("bigint").alias("a_id"), F.col(vec).alias("a"))
    right = b.select(F.col(id_col).cast("bigint").alias("b_id"), F.col(vec).alias("b"))
    return left.crossJoin(right).select("a_id", "b_id", F.round(f(F.col("a"), F.col("b")), SCALE).alias("d"))


def _matrix(a: DataFrame, b: DataFrame, op: str, id_col: str, vec: str, upper: bool) -> DataFrame:
    f = {"cosine_similarity": lambda x, y: 1 - vector.pairwise(x, y, "cosine"), "ip": lambda x, y: x @ y.T}.get(op, lambda x, y: vector.pairwise(x, y, op))
    left = a.select(F.col(id_col).cast("bigint").alias("a_id"), F.col(vec).alias("vector"))
    return scan.every(left, b.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vector")), f, upper)


def symmetric_distances(df: DataFrame, op: str = "l2", id_col: str = "id", vec: str = "vector") -> DataFrame:
    """Each unordered pair once, a_id < b_id."""
    return _matrix(df, df, op, id_col, vec, True)


def merge_lists(lists: list[DataFrame], k: int | None = None) -> DataFrame:
    """(qid, id, score, rank): lists of (qid, id, score, higher better) as one, each id with its best score."""
    every = lists[0].select("qid", "id", "score")
    for other in lists[1:]:
        every = every.unionByName(other.select("qid", "id", "score"))
    return rank(every.groupBy("qid", "id").agg(F.max("score").alias("score")), k, descending=True)
