"""Collections: vectors with tags and numbers, changed by a log of upserts and deletes, searched exactly or by an index.

A collection is a folder of Parquet: changes (an append-only log of rows with lsn and op), versions (compacted states) and a
pointer to the current one. Its view is the latest change of each id. Metadata stores and tombstones are tables alike.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.operators import filters
from quarry.operators.knn import knn
from quarry.streaming.log import DELETE, UPSERT, latest_state, write_pointer

SCHEMA = "lsn bigint, op string, id bigint, vector array<float>, tags map<string,string>, nums map<string,double>"


class Collection:
    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def log(self) -> DataFrame:
        """All changes after the current version, and the version's rows as upserts."""
        parts = []
        upto = -1
        if self._exists("CURRENT"):
            name, upto = self.spark.read.text(f"{self.path}/CURRENT").first()[0].split()
            parts.append(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/versions/{name}"))
        if self._exists("changes"):
            parts.append(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/changes").where(F.col("lsn") > int(upto)))
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def last_lsn(self) -> int:
        return self.log().agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/changes")

    def upsert(self, rows: DataFrame, id_col: str = "id", vec: str = "vector") -> None:
        """Add or replace rows (id, vector and, if there, tags and nums); all share one lsn step, an id twice is refused."""
        if rows.groupBy(id_col).count().where("count > 1").limit(1).count():
            raise EngineError("invalid_argument", "an id occurs twice in one batch", "collection")
        if self.dim is not None and rows.where((F.size(vec) != self.dim) | F.col(vec).isNull()).limit(1).count():
            raise EngineError("invalid_argument", f"vectors have {self.dim} elements", "collection")
        col = lambda n, t: F.col(n) if n in rows.columns else F.lit(None).cast(t)
        self._append(rows.select(F.lit(self.last_lsn() + 1).cast("bigint").alias("lsn"), F.lit(UPSERT).alias("op"), F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vector"), col("tags", "map<string,string>").alias("tags"), col("nums", "map<string,double>").alias("nums")))

    def delete(self, ids: DataFrame, id_col: str = "id") -> None:
        """Ids that aren't there are no error."""
        z = lambda t: F.lit(None).cast(t)
        self._append(ids.select(id_col).distinct().select(F.lit(self.last_lsn() + 1).cast("bigint").alias("lsn"), F.lit(DELETE).alias("op"), F.col(id_col).cast("bigint").alias("id"), z("array<float>").alias("vector"), z("map<string,string>").alias("tags"), z("map<string,double>").alias("nums")))

    def view(self, upto: int | None = None) -> DataFrame:
        return latest_state(self.log(), upto=upto).select("id", "vector", "tags", "nums")

    def search(self, queries: DataFrame, k: int = 10, metric: str = "l2", expr: filters.Filter | None = None) -> DataFrame:
        """(qid, id, score, rank) for queries (qid, vector), the filter applied first."""
        rows = self.view()
        return knn(queries, rows.where(filters.compile_filter(expr, rows.select("tags", "nums"), "tags", "nums")), k, metric)

    def compact(self) -> None:
        """Write the current view as a version and point to it; changes up to it are then no longer read."""
        lsn, name = self.last_lsn(), uuid.uuid4().hex
        self.view().select(F.lit(lsn).cast("bigint").alias("lsn"), F.lit(UPSERT).alias("op"), "id", "vector", "tags", "nums").write.parquet(f"{self.path}/versions/{name}")
        write_pointer(self.spark, f"{self.path}/CURRENT", f"{name} {lsn}")

    seal = snapshot = compact

    def segments(self) -> DataFrame:
        """(state, documents): rows of the sealed version, and changes since."""
        lsn = int(self.spark.read.text(f"{self.path}/CURRENT").first()[0].split()[1]) if self._exists("CURRENT") else -1
        state = F.when((F.col("lsn") <= lsn) & (F.col("op") == UPSERT), "sealed").otherwise("mutable")
        return self.log().groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))


class Tombstones:
    """Deleted ids (id, deleted_at)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def mark(self, ids: DataFrame, at, strict: bool = False) -> Tombstones:
        if strict and ids.join(self.rows, "id", "left_semi").limit(1).count():
            raise EngineError("precondition_failed", "already deleted", "tombstones")
        new = ids.select("id").distinct().join(self.rows, "id", "left_anti").select("id", F.lit(at).cast("timestamp").alias("deleted_at"))
        return Tombstones(self.rows.unionByName(new))

    def restore(self, ids: DataFrame) -> Tombstones:
        if ids.join(self.rows, "id", "left_anti").limit(1).count():
            raise EngineError("not_found", "not deleted", "tombstones")
        return Tombstones(self.rows.join(ids.select("id"), "id", "left_anti"))

    def live(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        return df.join(self.rows.select(F.col("id").alias(id_col)), id_col, "left_anti")

    def expire(self, now, ttl_seconds: int) -> Tombstones:
        """Without those older than the time to live: their rows show again."""
        return Tombstones(self.rows.where(F.col("deleted_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds))))

    def ids(self) -> DataFrame:
        return self.rows.select("id").orderBy("id")


def needs_compaction(deleted: int, total: int, threshold: int = 10_000, ratio: float = 0.2) -> bool:
    return deleted >= threshold or total > 0 and deleted / total >= ratio


def oversampling(deleted: int, base: int = 100_000) -> float:
    """How many more candidates to ask of an index whose hits are filtered afterwards."""
    return 1 + 1.25 * deleted / base


class MetadataStore:
    """Attributes of ids as a table (id, and a column for each field)."""

    def __init__(self, rows: DataFrame, id_col: str = "id"):
        self.rows, self.id_col = rows, id_col

    def add(self, new: DataFrame) -> MetadataStore:
        """Add or replace; a batch with a null id is refused as a whole."""
        if new.where(F.col(self.id_col).isNull()).limit(1).count():
            raise EngineError("invalid_argument", "null id", "metadata")
        return MetadataStore(self.rows.join(new.select(self.id_col), self.id_col, "left_anti").unionByName(new, allowMissingColumns=True), self.id_col)

    def update(self, new: DataFrame) -> MetadataStore:
        self._must_exist(new)
        return self.add(new)

    def remove(self, ids: DataFrame) -> MetadataStore:
        self._must_exist(ids)
        return MetadataStore(self.rows.join(ids.select(self.id_col), self.id_col, "left_anti"), self.id_col)

    def _must_exist(self, ids: DataFrame) -> None:
        if ids.join(self.rows, self.id_col, "left_anti").limit(1).count():
            raise EngineError("not_found", "no such id", "metadata")

    def get(self, ids: DataFrame) -> DataFrame:
        return self.rows.join(ids.select(self.id_col), self.id_col, "left_semi")

    def search(self, expr: filters.Filter | None, limit: int = 0) -> DataFrame:
        return filters.search(self.rows, expr, self.id_col, limit)

    def stats(self, fields: list[str]) -> DataFrame:
        return filters.store_stats(self.rows, fields, self.id_col)

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(path)


def load_metadata(spark: SparkSession, path: str, id_col: str = "id") -> MetadataStore:
    return MetadataStore(spark.read.parquet(path), id_col)


def storage_bytes(n: int, dim: int, kind: str) -> int:
    """Estimated size of an index of n vectors."""
    return n * {"hnsw": 4 * dim + 64, "ivf_pq": 32, "flat": 4 * dim}.get(kind, max(16, math.ceil(dim / 8)))
