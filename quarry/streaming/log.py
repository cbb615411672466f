"""The change log: frames, files, manifests, replay, checkpoints, snapshots and retention, in batch and as a stream.

A log is a folder of files wal-00000001.log, ..., each a sequence of frames. As a table it has lsn, type, payload, file, seq.
Order is by lsn. Replay into state is latest-by-lsn, so it can be repeated and can overlap.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.functions.vector import crc32c

MAGIC = 0x51575246
HEAD = struct.Struct("<IIHHQ")
DATA, COMMIT, PADDING = 1, 2, 3
LARGEST = 32 << 20


def encode_frame(lsn: int, type_: int, payload: bytes) -> bytes:
    """magic, length of the whole, type, zero, lsn, payload, CRC-32C of all before it."""
    body = HEAD.pack(MAGIC, HEAD.size + len(payload) + 4, type_, 0, lsn) + payload
    return body + struct.pack("<I", crc32c(body))


def decode_frames(data: bytes) -> tuple[list[tuple[int, int, bytes]], bool]:
    """(frames, whole): frames up to the first that is torn or corrupt, and whether the data ended with a frame."""
    out, at = [], 0
    while at < len(data):
        if at + HEAD.size > len(data):
            return out, False
        magic, size, type_, zero, lsn = HEAD.unpack_from(data, at)
        if magic != MAGIC or zero or not HEAD.size + 4 <= size <= LARGEST or at + size > len(data):
            return out, False
        if crc32c(data[at : at + size - 4]) != struct.unpack_from("<I", data, at + size - 4)[0]:
            return out, False
        out.append((lsn, type_, data[at + HEAD.size : at + size - 4]))
        at += size
    return out, True


def file_name(seq: int) -> str:
    return f"wal-{seq:08d}.log"


class LogWriter:
    """Appends frames to rotated files of a folder (a local or mounted path); strict refuses lsns that don't grow."""

    def __init__(self, folder: str, max_bytes: int = 16 << 20, strict: bool = False, flush_each: bool = False):
        from pathlib import Path

        self.folder, self.max_bytes, self.strict, self.flush_each = Path(folder), max_bytes, strict, flush_each
        self.folder.mkdir(parents=True, exist_ok=True)
        self.seq = max((int(p.stem.split("-")[1]) for p in self.folder.glob("wal-*.log")), default=0)
        self.file, self.size, self.last, self.frames, self.bytes, self.syncs = None, 0, -1, 0, 0, 0

    def append(self, lsn: int, payload: bytes, type_: int = DATA) -> None:
        if self.strict and lsn <= self.last:
            raise EngineError("invalid_argument", f"lsn {lsn} after {self.last}", "log")
        frame = encode_frame(lsn, type_, payload)
        if self.file is None or self.size and self.size + len(frame) > self.max_bytes:
            self.close()
            self.seq += 1
            self.file, self.size = (self.folder / file_name(self.seq)).open("wb"), 0
        self.file.write(frame)
        self.size += len(frame)
        self.last, self.frames, self.bytes = max(self.last, lsn), self.frames + 1, self.bytes + len(frame)
        if self.flush_each:
            self.flush()

    def flush(self) -> None:
        if self.file:
            self.file.flush()
            self.syncs += 1

    def close(self) -> None:
        if self.file:
            self.flush()
            self.file.close()
            self.file = None

    def publish_snapshot(self, last_lsn: int) -> None:
        save_snapshot(str(self.folder), last_lsn)


# reading

FRAMES = "file string, seq bigint, place bigint, lsn bigint, type int, payload binary, whole boolean"


def _parse(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for path, content in zip(pdf["path"], pdf["content"]):
            name = PurePosixPath(path).name
            frames, whole = decode_frames(bytes(content))
            rows = [(name, int(name[4:12]), i, *f, whole) for i, f in enumerate(frames)] or [(name, int(name[4:12]), -1, None, None, None, whole)]
            out = pd.DataFrame(rows, columns=["file", "seq", "place", "lsn", "type", "payload", "whole"])
            yield out.astype({"lsn": "Int64", "type": "Int32"})


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All frames of all files, each file up to its first bad frame; a file without any has one row of nulls."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "wal-*.log").load(folder).select("path", "content").mapInPandas(_parse, FRAMES)


def stream_log(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """The same as a stream of files as they are completed."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "wal-*.log").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select("path", "content").mapInPandas(_parse, FRAMES).where("lsn is not null")


def check_torn(frames: DataFrame) -> DataFrame:
    """frames, after making sure that no file but the last is torn."""
    files = frames.groupBy("seq").agg(F.min("whole").alias("whole"))
    last = files.agg(F.max("seq").alias("last"))
    bad = files.crossJoin(F.broadcast(last)).where("not whole and seq < last").select("seq").first()
    if bad:
        raise EngineError("data_integrity", f"{file_name(bad['seq'])} is torn and not the last", "log")
    return frames.where("lsn is not null")


def deliver(frames: DataFrame, cutoff: int = 0, mask: int = -1, max_frames: int | None = None, max_bytes: int | None = None, order: tuple[str, ...] = ("lsn",)) -> DataFrame:
    """Frames after the cutoff whose type's bit is in the mask, in order, up to the limits on their number and payload bytes.

    Limits are a running count and sum: first totals of lsn ranges, then within the ranges, so no task sorts the whole log.
    """
    if mask == 0:
        raise EngineError("invalid_argument", "the mask lets nothing through", "log")
    out = frames.where(F.col("lsn") > cutoff)
    if mask != -1:
        out = out.where(F.shiftleft(F.lit(1), 1).isNotNull() & (F.expr(f"(shiftleft(1, type) & {mask})") != 0))
    if max_frames is None and max_bytes is None:
        return out
    size = F.octet_length("payload") if "payload" in frames.columns else F.col("bytes")
    sized = out.withColumn("_size", F.coalesce(size, F.lit(0)).cast("bigint")).withColumn("_range", F.floor(F.col(order[0]) / 10_000))
    totals = sized.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 10,000 lsns
    starts = totals.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b0"))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sized.join(starts, "_range").withColumn("_n", F.col("_n0") + F.count(F.lit(1)).over(own)).withColumn("_b", F.col("_b0") + F.sum("_size").over(own))
    ok: Column = F.lit(True)
    if max_frames is not None:
        ok = ok & (F.col("_n") <= max_frames)
    if max_bytes is not None:
        ok = ok & (F.col("_b") <= max_bytes)
    return run.where(ok).select(*frames.columns)


def deliver_until(frames: DataFrame, stop: Column, skip: Column | None = None) -> DataFrame:
    """Frames in order up to and with the first at which stop holds, without those at which skip does."""
    first = frames.where(stop).agg(F.min("lsn").alias("_stop"))
    out = frames.crossJoin(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col("lsn") <= F.col("_stop")))
    return (out if skip is None else out.where(~skip)).select(*frames.columns)


def violations(frames: DataFrame, order: str = "place") -> DataFrame:
    """One row, violations: frames whose lsn isn't larger than that of the frame before in the same file."""
    prev = F.lag("lsn").over(Window.partitionBy("file").orderBy(order))
    return frames.withColumn("_prev", prev).agg(F.count(F.when(F.col("lsn") <= F.col("_prev"), 1)).alias("violations"))


def recovery_stats(frames: DataFrame) -> DataFrame:
    """One row: frames, bytes, last_lsn, shortest and longest frame."""
    size = F.octet_length("payload") + HEAD.size + 4
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.sum(size).alias("bytes"), F.max("lsn").alias("last_lsn"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


def type_histogram(frames: DataFrame) -> DataFrame:
    return frames.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# state

UPSERT, DELETE = "upsert", "delete"


def change_payload(op: str, id_: int, vec: list[float] | None = None, tags: dict[str, str] | None = None) -> bytes:
    return json.dumps({"op": op, "id": id_, "vector": vec, "tags": tags or {}}).encode()


def changes(frames: DataFrame) -> DataFrame:
    """(lsn, op, id, vector, tags) of data frames."""
    parsed = F.from_json(F.decode("payload", "UTF-8"), "op string, id bigint, vector array<float>, tags map<string,string>")
    return frames.where(F.col("type") == DATA).select("lsn", parsed.alias("c")).select("lsn", "c.*")


def latest_state(log: DataFrame, id_col: str = "id", lsn: str = "lsn", op: str = "op", upto: int | None = None) -> DataFrame:
    """The row with the highest lsn of each id, without ids whose row deletes them; as of an lsn if upto is given."""
    own = log if upto is None else log.where(F.col(lsn) <= upto)
    rows = own.groupBy(id_col).agg(F.max_by(F.struct(*[c for c in log.columns if c != id_col]), F.col(lsn)).alias("_row"))
    return rows.select(id_col, "_row.*").where(F.col(op) != DELETE)


def replay(frames: DataFrame, apply: Callable[[DataFrame], None], spark_checkpoint: str, trigger: dict | None = None):
    """Start a streaming replay that hands each batch of new frames to apply; progress is in the checkpoint folder."""
    return frames.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", spark_checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class StateTable:
    """State of a replayed stream: a Parquet folder for each version and a pointer file; a batch merges by lsn."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, p: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        at, fs = self._fs(f"{self.path}/CURRENT")
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0] if fs.exists(at) else None

    def load(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/{v}")

    def merge(self, log: DataFrame) -> None:
        """Apply changes (lsn, op, id, ...); deletes are kept so that late changes before them stay void."""
        old = self.load()
        every = log if old is None else old.unionByName(log)
        rows = every.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]), "lsn").alias("_row")).select("id", "_row.*").select(*log.columns)
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        write_pointer(self.spark, f"{self.path}/CURRENT", name)

    def live(self) -> DataFrame | None:
        rows = self.load()
        return None if rows is None else rows.where(F.col("op") != DELETE)


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside path, then rename it over path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, at = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    fs.rename(new, at)


# checkpoints of named consumers, snapshots: a small JSON file each, replaced by a rename


def _save(path, value: dict) -> None:
    import os

    tmp = f"{path}.new"
    with open(tmp, "w") as f:
        json.dump(value, f)
    os.replace(tmp, path)


def _load(path) -> dict | None:
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def load_checkpoint(folder: str, consumer: str) -> int:
    """The consumer's last lsn; 0 without one."""
    return (_load(f"{folder}/{consumer}.checkpoint") or {"lsn": 0})["lsn"]


def save_checkpoint(folder: str, consumer: str, lsn: int) -> None:
    _save(f"{folder}/{consumer}.checkpoint", {"lsn": lsn})


def replay_from_checkpoint(spark: SparkSession, folder: str, consumer: str, apply: Callable[[DataFrame], None]) -> int:
    """Hand apply all frames after the consumer's checkpoint, then move it to the last of them."""
    new = deliver(check_torn(read_log(spark, folder)), load_checkpoint(folder, consumer))
    last = new.agg(F.max("lsn")).first()[0]
    if last is None:
        return load_checkpoint(folder, consumer)
    apply(new)
    save_checkpoint(folder, consumer, last)
    return last


def load_snapshot(folder: str) -> int:
    return (_load(f"{folder}/snapshot.json") or {"last_lsn": 0})["last_lsn"]


def save_snapshot(folder: str, last_lsn: int) -> None:
    _save(f"{folder}/snapshot.json", {"last_lsn": last_lsn})


# manifests: (file, seq, start_lsn, first_lsn, end_lsn, frames, bytes)


def build_manifest(frames: DataFrame) -> DataFrame:
    """From frames; start_lsn is the first frame's, first_lsn the lowest, end_lsn the highest."""
    size = F.octet_length("payload") + HEAD.size + 4
    return frames.where("lsn is not null").groupBy("file", "seq").agg(F.min_by("lsn", "place").alias("start_lsn"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("end_lsn"), F.count(F.lit(1)).alias("frames"), F.sum(size).alias("bytes"))


def manifest_issues(manifest: DataFrame, on_disk: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """(file, issue) of a manifest in the given order, and of files (file) missing from disk or from it."""
    w = Window.orderBy(order, "file")  # one row for each file of the log
    m = manifest.withColumns({"_seq": F.lag("seq").over(w), "_end": F.lag("end_lsn").over(w), "_first": F.lag("first_lsn").over(w)})
    m = m.withColumns({"_files": F.count(F.lit(1)).over(Window.partitionBy("file")), "_seqs": F.count(F.lit(1)).over(Window.partitionBy("seq"))})
    tests = [
        ("OutOfOrderSeq", F.col("seq") < F.col("_seq")),
        ("DuplicateFile", F.col("_files") > 1),
        ("DuplicateSeq", F.col("_seqs") > 1),
        ("SeqGap", F.col("seq") > F.col("_seq") + 1),
        ("LsnInvalid", (F.col("frames") > 0) & (F.col("first_lsn") > F.col("end_lsn"))),
        ("LsnOverlap", F.col("first_lsn") <= F.col("_end")),
        ("LsnOrder", F.col("first_lsn") < F.col("_first")),
        ("LsnGap", F.col("first_lsn") > F.col("_end") + 1),
    ]
    found = m.select("file", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))).alias("issue"))
    if on_disk is not None:
        found = found.unionByName(manifest.select("file").join(on_disk, "file", "left_anti").select("file", F.lit("MissingFile").alias("issue")))
        found = found.unionByName(on_disk.select("file").join(manifest, "file", "left_anti").select("file", F.lit("ExtraFile").alias("issue")))
    return found


@dataclass(frozen=True)
class Retention:
    """What may be purged of a manifest; the newest files by (end_lsn, file) come first."""

    manifest: DataFrame

    def _placed(self) -> DataFrame:
        return self.manifest.withColumn("place", F.row_number().over(Window.orderBy(F.col("end_lsn").desc(), F.col("file").desc())).cast("bigint"))

    def up_to(self, lsn: int) -> DataFrame:
        return self.manifest.where(F.col("end_lsn") <= lsn).select("file")

    def beyond_last(self, n: int) -> DataFrame:
        return self._placed().where(F.col("place") > n).select("file")

    def older_than(self, lsn: int) -> DataFrame:
        """Files that end before lsn but for the newest."""
        return self._placed().where((F.col("end_lsn") < lsn) & (F.col("place") > 1)).select("file")

    def over_bytes(self, limit: int) -> DataFrame:
        w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return self._placed().withColumn("upto", F.sum("bytes").over(w)).where((F.col("upto") > limit) & (F.col("place") > 1)).select("file")


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): tumbling windows over event time; as a stream, rows later than late are dropped."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
