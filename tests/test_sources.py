import datetime

import numpy as np
import pytest

from quarry.errors import EngineError
from quarry.operators.filters import Term
from quarry.sources import vectors
from quarry.sources.collection import Collection, MetadataStore, Tombstones, load_metadata, needs_compaction, oversampling


@pytest.mark.parametrize("kind,dtype", [("fvecs", np.float32), ("ivecs", np.int32), ("bvecs", np.uint8)])
def test_vector_files(spark, tmp_path, kind, dtype):
    x = np.arange(12).reshape(4, 3).astype(dtype)
    (tmp_path / f"a.{kind}").write_bytes(vectors.encode(x, kind))
    rows = vectors.read(spark, f"{tmp_path}/a.{kind}").orderBy("id").collect()
    assert [list(r["vector"]) for r in rows] == x.tolist() and [r["id"] for r in rows] == [0, 1, 2, 3]
    with pytest.raises(EngineError):
        vectors.decode(vectors.encode(x, kind)[:-1], kind)
    with pytest.raises(EngineError):
        vectors.detect("a.h5")


def test_bundle(spark, tmp_path):
    for name, kind, x in (("base", "fvecs", np.eye(3)), ("query", "fvecs", np.eye(3)[:1]), ("groundtruth", "ivecs", np.array([[0, 2]])), ("distances", "fvecs", np.array([[0.0, 2.0]]))):
        (tmp_path / f"s_{name}.{kind}").write_bytes(vectors.encode(x, kind))
    b = vectors.read_bundle(spark, f"{tmp_path}/s")
    assert b["base"].count() == 3 and [tuple(r) for r in b["truth"].orderBy("rank").collect()] == [(0, 1, 0), (0, 2, 2)]
    assert b["distance"].where("rank = 2").first()["dist"] == 2.0


def test_collection(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", 2)
    assert c.view().count() == 0
    rows = lambda *r: spark.createDataFrame([(i, v, {"t": t}) for i, v, t in r], "id bigint, vector array<float>, tags map<string,string>")
    c.upsert(rows((1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [5.0, 5.0], "a")))
    c.upsert(rows((2, [9.0, 9.0], "a")))
    c.delete(spark.createDataFrame([(3,), (77,)], "id bigint"))
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid bigint, vector array<float>")
    want = [(0, 1, 0.0, 1), (0, 2, 162.0, 2)]
    assert [tuple(r) for r in c.search(q).orderBy("rank").collect()] == want
    assert c.view(upto=1).count() == 3
    c.compact()
    assert [tuple(r) for r in c.search(q, expr=Term("t", "a")).orderBy("rank").collect()] == want
    c.upsert(rows((3, [1.0, 1.0], "b")))
    assert [r["id"] for r in c.search(q, expr=Term("t", "b")).collect()] == [3]
    assert {r["state"]: r["documents"] for r in c.segments().collect()} == {"sealed": 2, "mutable": 1}
    for bad in (rows((1, [1.0], "x")), rows((1, [1.0, 1.0], "x"), (1, [2.0, 1.0], "x"))):
        with pytest.raises(EngineError):
            c.upsert(bad)


def test_tombstones(spark):
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "id bigint")
    t0 = datetime.datetime(2024, 1, 1)
    t = Tombstones(spark.createDataFrame([], "id bigint, deleted_at timestamp")).mark(ids(1, 2, 2), t0).mark(ids(2, 3), t0 + datetime.timedelta(hours=1))
    assert [r["id"] for r in t.ids().collect()] == [1, 2, 3] and [r["id"] for r in t.live(ids(1, 4)).collect()] == [4]
    with pytest.raises(EngineError):
        t.mark(ids(1), t0, strict=True)
    with pytest.raises(EngineError):
        t.restore(ids(9))
    assert [r["id"] for r in t.restore(ids(1)).ids().collect()] == [2, 3]
    assert [r["id"] for r in t.expire(t0 + datetime.timedelta(hours=2), 3600).ids().collect()] == [3]
    assert needs_compaction(10_000, 10**9) and needs_compaction(2, 10) and not needs_compaction(1, 10) and oversampling(100_000) == 2.25


def test_metadata(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id bigint, tag string, n int")
    m = MetadataStore(df).add(spark.createDataFrame([(2, "c", 7), (3, "a", 8)], "id bigint, tag string, n int"))
    assert [r["id"] for r in m.search(Term("tag", "a")).collect()] == [1, 3] and [r["id"] for r in m.search(Term("n", "7")).collect()] == [2]
    with pytest.raises(EngineError):
        m.update(spark.createDataFrame([(9, "z", 1)], "id bigint, tag string, n int"))
    with pytest.raises(EngineError):
        m.add(spark.createDataFrame([(None, "z", 1)], "id bigint, tag string, n int"))
    m.save(f"{tmp_path}/m")
    assert load_metadata(spark, f"{tmp_path}/m").remove(df.where("id = 1")).rows.count() == 2
    assert m.get(df).count() == 2
