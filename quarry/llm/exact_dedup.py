"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each scan task sorts the 64-bit fingerprints of its documents, splits them by owner (a range of the fingerprint space)
and sends each owner one Golomb-Rice coded block. The owner decodes all blocks, finds fingerprints that occur more than
once and answers each block with a bitmap. A task's own block and the bitmap give its suspects. Only documents whose
fingerprint is suspect are shuffled with their text, and only equal bytes make a duplicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import col, cols, fresh, join_checked, quoted, tasks, written

OWNED = 4_000_000  #: fingerprints of an owner, about, so that its arrays fit in a worker


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code of a sorted uint64 array: the gaps, each as a unary quotient and k low bits. Returns k and the bytes."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = max(1.0, float(values[-1]) / len(values))
    k = max(0, int(np.log2(mean * 0.6931)) if mean > 1 else 0)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1)  # the place after each unary part
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
    return k, len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def rice_decode(n: int, k: int, data: bytes) -> np.ndarray:
    """The n sorted values that :func:`rice_encode` coded."""
    if not n:
        return np.zeros(0, np.uint64)
    bits = int.from_bytes(data[:8], "little")
    size = -(-bits // 8)
    unary = np.unpackbits(np.frombuffer(data, np.uint8, size, 8), count=bits)
    q = np.diff(np.flatnonzero(unary), prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps = q << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 + size), count=n * k).reshape(n, k)
        for i in range(k):
            gaps |= low[:, i].astype(np.uint64) << np.uint64(k - 1 - i)
    return np.cumsum(gaps, dtype=np.uint64)


def _blocks(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        fp = np.sort(np.concatenate(parts).astype(np.int64).view(np.uint64)) if parts else np.zeros(0, np.uint64)
        step = -(-(1 << 64) // owners)
        edges = np.searchsorted(fp, np.array([step * i for i in range(1, owners)], dtype=np.uint64))
        rows = []
        for owner, own in enumerate(np.split(fp, edges)):
            if len(own):
                k, data = rice_encode(own - np.uint64(step * owner))
                rows.append((TaskContext.get().partitionId(), owner, len(own), k, data))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["part", "owner", "n", "k", "block"])

    return run


def _bitmaps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one owner: for each block with duplicates, a bit for each of its fingerprints in order."""
    lists = [rice_decode(n, k, b) for n, k, b in zip(pdf["n"], pdf["k"], pdf["block"])]
    every = np.sort(np.concatenate(lists))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for part, owner, own in zip(pdf["part"], pdf["owner"], lists):
        at = np.searchsorted(twice, own)
        hit = (at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == own) if len(twice) else np.zeros(len(own), bool)
        if hit.any():
            out.append((part, owner, np.packbits(hit).tobytes()))
    return pd.DataFrame(out, columns=["part", "owner", "bitmap"])


def _suspects(owners: int):
    step = -(-(1 << 64) // owners)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for owner, n, k, block, bitmap in zip(pdf["owner"], pdf["n"], pdf["k"], pdf["block"], pdf["bitmap"]):
                own = rice_decode(n, k, block) + np.uint64(step * owner)
                hit = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
                yield pd.DataFrame({"fp": np.unique(own[hit]).view(np.int64)})

    return run


def suspect_fingerprints(docs: DataFrame, text: str = "text", owners: int | None = None) -> DataFrame:
    """The fingerprints, column fp, that more than one non-null text has, as a written table. Without a number of owners each has about OWNED fingerprints."""
    spark = docs.sparkSession
    owners = owners or max(tasks(spark), -(-docs.count() // OWNED))
    home = written(docs.where(col(text).isNotNull()).select(F.xxhash64(col(text)).alias("fp")).mapInArrow(_blocks(owners), "part int, owner int, n int, k int, block binary"), "home")
    bitmaps = home.groupBy("owner").applyInPandas(_bitmaps, "part int, owner int, bitmap binary")
    return written(home.join(bitmaps, ["part", "owner"]).mapInPandas(_suspects(owners), "fp bigint").distinct(), "suspects")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, dup_of, copies) for each document to drop: dup_of is the lowest id of the same text, copies how many rows have it.

    Null texts are never duplicates; an empty text is a text like any other, and texts of any length are compared whole. Among equal texts
    null ids count as the highest. Rows repeated with their id give one row for each repetition. An empty table gives an empty result.
    Extra columns are not read, whatever their names.
    """
    suspects = suspect_fingerprints(docs, text)
    own = docs.where(col(text).isNotNull()).select(col(id_col).alias("doc_id"), col(text).alias("text"), F.xxhash64(col(text)).alias("fp"))
    # a number for each row, fixed by writing it, tells rows apart that repeat an id
    rows = written(join_checked(own, suspects, ["fp"], "left_semi", 40).withColumn("row", F.monotonically_increasing_id()), "suspect_rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))
    heads = written(rows.groupBy("fp", "text").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")), "heads")
    # one text has a fingerprint nearly always, and its rows need no text to find their head
    mixed = written(heads.groupBy("fp").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("fp"), "mixed")
    alone = join_checked(heads.where("copies > 1").select("fp", "first", "copies"), mixed, ["fp"], "left_anti", 40)
    shared = join_checked(heads.where("copies > 1"), mixed, ["fp"], "left_semi", 40)
    joined = join_checked(rows.select("fp", "doc_id", "row"), alone, ["fp"], "inner", 80).select("doc_id", "row", "first", "copies")
    clashing = join_checked(rows, mixed, ["fp"], "left_semi", 40).join(shared, ["fp", "text"]).select("doc_id", "row", "first", "copies")
    return joined.union(clashing).where(F.col("row") != F.col("first.row")).select("doc_id", F.col("first.doc_id").alias("dup_of"), "copies")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without exact duplicates: of the rows with one text the one with the lowest id stays, whole.

    Nulls, empty and long texts and ties as in :func:`exact_duplicates`; of rows that repeat an id with its text, one stays. All
    columns are kept, whatever their names.
    """
    fp, row, order = fresh(docs, "fp"), fresh(docs, "row"), fresh(docs, "order")
    suspects = suspect_fingerprints(docs, text).withColumnRenamed("fp", fp)
    tagged = docs.withColumn(fp, F.when(col(text).isNotNull(), F.xxhash64(col(text))))
    once = join_checked(tagged, suspects, [fp], "left_anti", 40).select(*cols(docs))
    rest = join_checked(tagged, suspects, [fp], "left_semi", 40)
    first = rest.groupBy(fp, col(text).alias(order)).agg(F.min_by(F.struct(*cols(docs)), F.struct(col(id_col).isNull().alias("no"), col(id_col).alias("id"))).alias(row))
    return once.unionByName(first.select(*[F.col(f"{row}.{quoted(c)}").alias(c) for c in docs.columns]))
