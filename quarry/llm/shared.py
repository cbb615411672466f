"""What the operators share: the folder all executors see, written tables, and joins that check a size before broadcasting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this size in memory; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

#: Texts are handed to Python code in slices of about so many bytes, whatever the number of rows in an Arrow batch.
SLICE_BYTES = 1 << 20

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may do without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with right broadcast if its rows, counted, fit in limit bytes; else by shuffled hash or sort, as AQE finds."""
    return left.join(F.broadcast(right) if right.count() * row_bytes <= limit else right, on, how)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    """A column's name where an expression is parsed: dots in it are part of it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def cols(df: DataFrame) -> list[Column]:
    """All columns of df by name."""
    return [col(c) for c in df.columns]


def type_of(df: DataFrame, name: str) -> str:
    """The type of a column as DDL; ids keep theirs."""
    return df.select(col(name)).schema[0].dataType.simpleString()


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch cut, in order, so that the texts in a slice have at most limit bytes or are a single one."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, i = np.cumsum(size + 64), 0
    while i < len(size):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def find_in_texts(docs: DataFrame, id_col: str, text: str, find: Callable[[], Callable[[str], Iterable[tuple]]], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """(doc_id, fields): a row for each tuple that find()(text) gives of each text that is neither null nor empty. find is called once in each task."""
    names = ["doc_id", *(n for n, _, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = find()
        for b in batches:
            for part in slices(b, 1):
                at, hits = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    for hit in one(t):
                        at.append(i)
                        hits.append(hit)
                if at:
                    columns = [pa.array([h[n] for h in hits], t) for n, (_, t, _) in enumerate(fields)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    schema = ", ".join([f"doc_id {type_of(docs, id_col)}", *(f"{quoted(n)} {t}" for n, _, t in fields)])
    return docs.select(col(id_col).alias("doc_id"), col(text).alias("text")).where("text <> ''").mapInArrow(run, schema)


def apart(spans: Iterable[tuple], start: int = 0, end: int = 1) -> list[tuple]:
    """Of spans in order of preference those that overlap none preferred to them, in order of place: a sorted list is searched, not all that were kept."""
    kept: list[tuple[int, int]] = []
    out = []
    for f in spans:
        a, b = f[start], f[end]
        n = bisect_left(kept, (a, b))
        if (n and kept[n - 1][1] > a) or (n < len(kept) and kept[n][0] < b):
            continue
        insort(kept, (a, b))
        out.append(f)
    return sorted(out, key=lambda f: (f[start], f[end]))
