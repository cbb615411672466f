"""Readers and writers of vector files: records of a 32-bit length and that many floats, ints or bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import EngineError

KINDS = {"fvecs": ("<f4", 4, "array<float>"), "ivecs": ("<i4", 4, "array<int>"), "bvecs": ("u1", 1, "array<smallint>")}


def decode(data: bytes, kind: str) -> np.ndarray:
    """Rows of a file; all have the first one's length."""
    dtype, width, _ = KINDS[kind]
    if not data:
        return np.zeros((0, 0))
    dim = int.from_bytes(data[:4], "little", signed=True)
    size = 4 + dim * width
    if dim <= 0 or len(data) % size:
        raise EngineError("data_integrity", f"not a whole number of records of {dim} elements", "vectors")
    raw = np.frombuffer(data, np.uint8).reshape(-1, size)
    if (raw[:, :4].copy().view("<i4")[:, 0] != dim).any():
        raise EngineError("data_integrity", "records differ in length", "vectors")
    return raw[:, 4:].copy().view(dtype)


def encode(rows: np.ndarray, kind: str) -> bytes:
    dtype, _, _ = KINDS[kind]
    rows = np.ascontiguousarray(rows, dtype)
    head = np.full((len(rows), 1), rows.shape[1], "<i4").view(np.uint8)
    return np.hstack([head, rows.view(np.uint8).reshape(len(rows), -1)]).tobytes()


def detect(path: str) -> str:
    kind = path.rsplit(".", 1)[-1]
    if kind not in (*KINDS, "parquet"):
        raise EngineError("unsupported", f"no reader for .{kind}", "vectors")
    return kind


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, vector): id is the row's place in its file. A path ending in .parquet is read as such."""
    kind = detect(path)
    if kind == "parquet":
        return spark.read.parquet(path)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, content in zip(pdf["path"], pdf["content"]):
                x = decode(bytes(content), kind)
                for i in range(0, len(x), 50_000):
                    part = x[i : i + 50_000]
                    yield pd.DataFrame({"file": name, "id": np.arange(i, i + len(part)), "vector": list(part.astype(np.int16) if kind == "bvecs" else part)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"file string, id bigint, vector {KINDS[kind][2]}")


def read_bundle(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """base (id, vector), query (qid, vector), truth (qid, rank, id) and distance (qid, rank, dist) of files base_base.fvecs and so on."""
    out = {"base": read(spark, f"{base}_base.fvecs").select("id", "vector"), "query": read(spark, f"{base}_query.fvecs").select(F.col("id").alias("qid"), "vector")}
    long = lambda name, kind, value: read(spark, f"{base}_{name}.{kind}").select(F.col("id").alias("qid"), F.posexplode("vector").alias("p", "v")).select("qid", (F.col("p") + 1).cast("bigint").alias("rank"), F.col("v").alias(value))
    out["truth"] = long("groundtruth", "ivecs", "id").withColumn("id", F.col("id").cast("bigint"))
    out["distance"] = long("distances", "fvecs", "dist")
    return out
