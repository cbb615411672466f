import random

import pytest
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.streaming import log


def write(folder, frames, max_bytes=400):
    w = log.LogWriter(str(folder), max_bytes)
    for lsn, type_, payload in frames:
        w.append(lsn, payload, type_)
    w.close()
    return w


def change_log(n=120, seed=1):
    rng = random.Random(seed)
    out, want = [], {}
    for lsn in range(1, n + 1):
        i = rng.randrange(12)
        if rng.random() < 0.3:
            out.append((lsn, log.DATA, log.change_payload(log.DELETE, i)))
            want.pop(i, None)
        else:
            out.append((lsn, log.DATA, log.change_payload(log.UPSERT, i, [float(lsn), 0.5], {"t": str(lsn)})))
            want[i] = lsn
    return out, want


def test_codec():
    data = log.encode_frame(7, 1, b"abc") + log.encode_frame(8, 2, b"")
    assert log.decode_frames(data) == ([(7, 1, b"abc"), (8, 2, b"")], True) and len(log.encode_frame(1, 1, b"1234")) == 28
    assert log.decode_frames(data[:-1]) == ([(7, 1, b"abc")], False)
    bad = bytearray(data)
    bad[22] ^= 1
    assert log.decode_frames(bytes(bad)) == ([], False) and log.decode_frames(b"") == ([], True)


def test_replay_equals_the_oracle_and_can_be_repeated(spark, tmp_path):
    frames, want = change_log()
    w = write(tmp_path / "log", frames)
    assert w.seq > 3
    read = log.check_torn(log.read_log(spark, str(tmp_path / "log")))
    state = log.latest_state(log.changes(read))
    assert {r["id"]: r["lsn"] for r in state.collect()} == want
    twice = log.latest_state(log.changes(read.unionByName(read)))
    assert sorted(map(str, twice.collect())) == sorted(map(str, state.collect()))
    assert log.recovery_stats(read).first()["frames"] == 120 and log.violations(read).first()[0] == 0


def test_stream_replay_with_checkpoint(spark, tmp_path):
    frames, want = change_log(60, 2)
    table = log.StateTable(spark, f"file://{tmp_path}/state")
    w = log.LogWriter(str(tmp_path / "log"), 500)
    for half in (frames[:30], frames[30:]):
        for lsn, t, p in half:
            w.append(lsn, p, t)
        w.close()
        log.replay(log.stream_log(spark, str(tmp_path / "log")), lambda df: table.merge(log.changes(df)), str(tmp_path / "ck")).awaitTermination()
    assert {r["id"]: r["lsn"] for r in table.live().collect()} == want
    table.merge(log.changes(log.read_log(spark, str(tmp_path / "log")).where("lsn <= 10")))  # late and repeated
    assert {r["id"]: r["lsn"] for r in table.live().collect()} == want


def test_torn_files(spark, tmp_path):
    frames, _ = change_log(40)
    write(tmp_path, frames)
    files = sorted(tmp_path.glob("wal-*.log"))
    files[-1].write_bytes(files[-1].read_bytes()[:-3])
    ok = log.check_torn(log.read_log(spark, str(tmp_path)))
    assert ok.count() == 39
    files[0].write_bytes(files[0].read_bytes()[:-3])
    with pytest.raises(EngineError, match="torn"):
        log.check_torn(log.read_log(spark, str(tmp_path)))


def test_delivery(spark):
    df = spark.createDataFrame([(i, i % 3 + 1, b"x" * 10) for i in range(1, 31)], "lsn bigint, type int, payload binary")
    ids = lambda d: sorted(r["lsn"] for r in d.collect())
    assert ids(log.deliver(df, 25)) == list(range(26, 31))
    assert ids(log.deliver(df, mask=1 << 2)) == [i for i in range(1, 31) if i % 3 == 1]
    assert ids(log.deliver(df, 5, max_frames=4)) == [6, 7, 8, 9] and ids(log.deliver(df, max_bytes=35)) == [1, 2, 3]
    assert ids(log.deliver_until(df, F.col("lsn") == 4, F.col("lsn") == 2)) == [1, 3, 4]
    with pytest.raises(EngineError):
        log.deliver(df, mask=0)
    assert {r["type"]: r["n"] for r in log.type_histogram(df).collect()} == {1: 10, 2: 10, 3: 10}


def test_limits_across_ranges(spark):
    df = spark.range(1, 50_001).select(F.col("id").alias("lsn"), F.lit(1).alias("type"), F.encode(F.lit("ab"), "UTF-8").alias("payload"))
    assert log.deliver(df, max_frames=23_456).agg(F.max("lsn"), F.count("lsn")).first()[:] == (23_456, 23_456)
    assert log.deliver(df, 10, max_bytes=60_001).agg(F.max("lsn"), F.count("lsn")).first()[:] == (30_010, 30_000)


def test_writer_is_strict(tmp_path):
    w = log.LogWriter(str(tmp_path), strict=True)
    w.append(5, b"")
    with pytest.raises(EngineError):
        w.append(5, b"")
    w.publish_snapshot(5)
    assert log.load_snapshot(str(tmp_path)) == 5 and log.load_snapshot(str(tmp_path / "none")) == 0


def test_consumers(spark, tmp_path):
    frames, _ = change_log(20)
    write(tmp_path / "log", frames)
    got = []
    f = str(tmp_path / "log")
    assert log.replay_from_checkpoint(spark, f, "c", lambda df: got.append(df.count())) == 20
    assert log.replay_from_checkpoint(spark, f, "c", lambda df: got.append(df.count())) == 20
    assert got == [20] and log.load_checkpoint(f, "other") == 0


M = "file string, seq bigint, start_lsn bigint, first_lsn bigint, end_lsn bigint, frames bigint, bytes bigint"


def manifest(spark, rows):
    return spark.createDataFrame([(log.file_name(s), s, a, a, b, n, size) for s, a, b, n, size in rows], M)


def test_manifest_issues(spark, tmp_path):
    issues = lambda rows, disk=None: sorted((r["file"][-7:-4], r["issue"]) for r in log.manifest_issues(manifest(spark, rows), disk).collect())
    assert issues([(1, 1, 5, 5, 9), (2, 6, 9, 4, 9), (3, 10, 12, 3, 9)]) == []
    assert issues([(1, 1, 5, 5, 9), (2, 4, 9, 4, 9)]) == [("002", "LsnOverlap")]
    assert issues([(1, 1, 5, 5, 9), (3, 9, 12, 3, 9)]) == [("003", "LsnGap"), ("003", "SeqGap")]
    assert issues([(1, 9, 5, 5, 9)]) == [("001", "LsnInvalid")]
    assert issues([(1, 8, 9, 5, 9), (2, 1, 3, 5, 9)]) == [("002", "LsnOrder"), ("002", "LsnOverlap")]
    assert {i for _, i in issues([(1, 1, 5, 5, 9), (1, 6, 9, 5, 9)])} == {"DuplicateFile", "DuplicateSeq"}
    disk = spark.createDataFrame([(log.file_name(1),), (log.file_name(9),)], "file string")
    assert issues([(1, 1, 5, 5, 9), (2, 6, 9, 4, 9)], disk) == [("002", "MissingFile"), ("009", "ExtraFile")]
    frames, _ = change_log(40)
    write(tmp_path, frames)
    built = log.build_manifest(log.read_log(spark, str(tmp_path)))
    assert built.agg(F.sum("frames")).first()[0] == 40 and log.manifest_issues(built).count() == 0


def test_retention(spark):
    r = log.Retention(manifest(spark, [(i, i * 10, i * 10 + 9, 10, 100) for i in range(1, 6)]))
    seqs = lambda df: sorted(int(x["file"][4:12]) for x in df.collect())
    assert seqs(r.up_to(29)) == [1, 2] and seqs(r.beyond_last(2)) == [1, 2, 3] and seqs(r.older_than(45)) == [1, 2, 3] and seqs(r.over_bytes(250)) == [1, 2, 3] and seqs(r.over_bytes(1)) == [1, 2, 3, 4]


def test_windows_as_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = log.windowed_counts(stream).writeStream.outputMode("update").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == log.windowed_counts(events).count()
