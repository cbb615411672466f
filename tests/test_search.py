import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.operators import bm25, cascade, fusion, graph, ivf, kmeans, metrics, quantize
from quarry.operators.knn import knn, merge_lists
from quarry.plans import manager

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label").cache()


@pytest.fixture(scope="module")
def asked(base):
    return base.select(F.col("id").alias("qid"), "vector")


def recall(got, base, asked, k=10):
    return metrics.recall_at_k(got, knn(asked, base, k), k).first()["recall"]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_sql_and_arrow_agree_with_ties_nulls_and_zero_norms(spark, metric):
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)] + [(30, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    q = df.select(F.col("id").alias("qid"), "vector")
    got = [sorted(map(tuple, knn(q, df, 4, metric, **how).collect())) for how in ({"impl": "sql"}, {"impl": "arrow"}, {"limit": 0})]
    assert got[0] == got[1] == got[2]
    if metric == "l2":
        assert [r[1] for r in sorted(got[0], key=lambda r: r[3]) if r[0] == 0][:3] == [0, 15, 6]


def test_bm25_golden(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "a quick brown dog runs through the forest", "the lazy cat sleeps under the warm sun", "brown foxes are quick and clever animals", "dogs and cats are popular pets"]
    index = bm25.build(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    want = {"fox": [(0, 1.257669)], "quick brown": [(3, 1.127409), (1, 1.047388), (0, 0.977973)], "brown dog": [(1, 1.374307), (0, 1.283226), (3, 0.563704)], "lazy": [(2, 0.850613), (0, 0.79424)], "unicorn": [], "": [], "the": []}
    q = spark.createDataFrame(list(enumerate(want)), "qid bigint, text string")
    got = {t: [] for t in want}
    for r in bm25.search(index, q).orderBy("qid", "rank").collect():
        got[list(want)[r["qid"]]].append((r["id"], r["score"]))
    assert got == want
    assert index.stats().first()["avg"] == 5.6
    again = bm25.latest(spark.createDataFrame([(0, "old", 1), (0, "new", 2)], "doc_id bigint, text string, v int"), "doc_id", "v")
    assert [r["text"] for r in again.collect()] == ["new"]
    with pytest.raises(EngineError):
        bm25.Bm25Params(k1=0)


def test_bm25_save_and_load(spark, tmp_path):
    index = bm25.build(spark.createDataFrame([(1, "alpha beta"), (2, "")], "doc_id bigint, text string"), params=bm25.Bm25Params(1.5, 0.5))
    bm25.save(index, str(tmp_path))
    back = bm25.load(spark, str(tmp_path))
    assert back.params == index.params and back.stats().first()["n"] == 2


def lists(spark):
    make = lambda pairs: spark.createDataFrame([(0, i, s, r + 1) for r, (i, s) in enumerate(pairs)], "qid bigint, id bigint, score double, rank bigint")
    return make([(1, 0.95), (3, 0.87), (5, 0.82), (7, 0.76), (9, 0.71)]), make([(2, 0.89), (3, 0.85), (4, 0.78), (7, 0.72), (8, 0.68)])


def test_fusion_golden(spark):
    d, s = lists(spark)
    top = lambda df: [(r["id"], r["score"]) for r in df.orderBy("rank").collect()]
    assert top(fusion.rrf(d, s)) == [(3, 0.032258), (7, 0.03125), (1, 0.016393), (2, 0.016393), (4, 0.015873), (5, 0.015873), (8, 0.015385), (9, 0.015385)]
    assert top(fusion.weighted(d, s))[:4] == [(3, 0.738095), (1, 0.5), (2, 0.5), (4, 0.238095)]
    assert top(fusion.weighted(d, s, 0.8, 0.2))[:4] == [(1, 0.8), (3, 0.695238), (5, 0.366667), (7, 0.204762)]
    assert top(fusion.weighted(d, s, 0.2, 0.8))[:4] == [(2, 0.8), (3, 0.780952), (4, 0.380952), (1, 0.2)]
    assert top(merge_lists([d, s], 2)) == [(1, 0.95), (2, 0.89)]
    assert top(fusion.fuse(d, s, "custom", custom=lambda j: F.coalesce("dense_score", F.lit(0.0))))[0] == (1, 0.95)
    with pytest.raises(EngineError):
        fusion.fuse(d, s, "nothing")


def test_adaptive_fusion_prefers_the_good_side(spark):
    d, s = lists(spark)
    rel = spark.createDataFrame([(0, 2), (0, 4)], "qid bigint, id bigint")
    method, weight, _ = fusion.fit_adaptive(d, s, rel, 3)
    assert method == "weighted" and weight <= 0.5


def test_metrics(spark):
    hits = spark.createDataFrame([(0, 5, 1), (0, 6, 2), (1, 7, 1), (1, 8, 2)], "qid bigint, id bigint, rank bigint")
    truth = spark.createDataFrame([(0, 6, 1), (0, 5, 2), (1, 9, 1), (1, 7, 2)], "qid bigint, id bigint, rank bigint")
    assert metrics.recall_at_k(hits, truth, 2).first()[0] == 0.75 and metrics.mean_reciprocal_rank(hits, truth, 2).first()[0] == 0.25
    assert metrics.precision_at_k(hits, truth, 2).first()[0] == 0.75
    assert {r["qid"]: r["ndcg"] for r in metrics.ndcg_at_k(hits, truth, 2).collect()} == {0: 1.0, 1: 0.613147}
    xy = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (2.0, 9.0), (3.0, 16.0)], "a double, b double")
    assert metrics.spearman(xy, "a", "b").first()[0] == 0.948683


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (60, 4)) for c in (0, 5, -5)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    got = kmeans.cluster(df, 3)
    assert sorted(np.round(got.centroids.mean(axis=1)).tolist()) == [-5, 0, 5] and got.inertia < 10
    assert kmeans.quality(df, got.centroids).first()["silhouette"] > 0.9
    worse = kmeans.lloyd(df, x[:3], iterations=1)
    assert kmeans.lloyd(df, x[:3], iterations=5).inertia <= worse.inertia + 1e-9
    assert len(kmeans.hierarchical(df, 5, 2)) == 5 and kmeans.mini_batch(df, got.centroids, 0.5, 3).shape == (3, 4)
    for k in (0, 1000):
        with pytest.raises(EngineError):
            kmeans.cluster(df, k)


def test_quantizers(spark, base, asked):
    pq = quantize.train_pq(base, 8, 5)
    opq = quantize.train_opq(base, 8, 5, 4)
    e, o = pq.error(base).first()[0], opq.error(base).first()[0]
    assert 0 < o < 1 and o <= e * 1.1
    x = quantize.sample_matrix(base, 100)
    assert np.allclose(pq.reconstruct(pq.codes(x)), pq.reconstruct(pq.codes(pq.reconstruct(pq.codes(x)))))
    assert np.allclose(pq.symmetric(pq.codes(x), pq.codes(x)), 0)
    assert quantize.pq_recall(pq, base).first()[0] > 0.3
    scalar = quantize.train_scalar(base, 0.0, 1.0)
    err = base.select(F.max(F.array_max(F.zip_with("vector", scalar.decode(scalar.encode(F.col("vector"))), lambda a, b: F.abs(a - b)))).alias("e")).first()["e"]
    assert err <= scalar.step.max() / 2 + 1e-6
    binary = quantize.train_binary(base, rotate=True)
    assert np.allclose(binary.rotation @ binary.rotation.T, np.eye(64))
    back = base.select(binary.reconstruct(binary.encode(F.col("vector"))).alias("v")).first()["v"]
    assert len(back) == 64
    rot = quantize.train_rotational(x)
    d = rot.distances(x[:5], rot.codes(x))
    assert np.abs(d - ((x[:5, None] - x[None]) ** 2).sum(axis=2)).max() < 0.05


def test_capq(base, asked):
    model = quantize.train_capq(base)
    codes = model.encode(base).cache()
    got = model.search(asked, codes, 10, 500, 100)
    assert recall(got, base, asked) > 0.7
    assert quantize.Capq.coarsen(np.array([-127, 0, 127])).tolist() == [0, 8, 15]
    x = quantize.sample_matrix(base, 50)
    assert quantize.learned_q4_codes(model, x).max() <= 15
    assert np.allclose(quantize.train_capq(base, zca=True).whiten, quantize.train_capq(base, zca=True).whiten.T)
    r = quantize.itq_rotation(x)
    assert np.allclose(r @ r.T, np.eye(64), atol=1e-8)
    w = quantize.ridge_weights(np.eye(4), np.ones(4), 0.0)
    assert np.allclose(w, 1)


def test_capq_search_as_registered(spark, monkeypatch):
    from quarry.plans import catalog

    sf = "/root/testdata/sf0.1"
    asked = catalog.asked(spark, sf).where("qid % 20 = 0")
    monkeypatch.setattr(catalog, "asked", lambda *_: asked)
    pools, ranked = [], quantize.rank
    monkeypatch.setattr(quantize, "rank", lambda df, k, *a, **b: pools.append(k) or ranked(df, k, *a, **b))
    got = catalog.capq_search(spark, sf)
    assert pools[0] >= 8000 and pools[1] >= 200
    assert recall(got, catalog.base(spark, sf), asked) > 0.9


def test_isotonic():
    x, y = np.array([1, 2, 3, 4, 5.0]), np.array([1, 3, 2, 2, 5.0])
    m = quantize.fit_isotonic(x, y)
    assert quantize.map_isotonic(m, x).tolist() == [1, 7 / 3, 7 / 3, 7 / 3, 5] and quantize.map_isotonic(m, np.array([0.0, 9.0])).tolist() == [1, 5]


def test_matryoshka(base, asked):
    r = {x["dim"]: x["recall"] for x in quantize.measured_recall(asked, base, (8, 32, 64)).collect()}
    assert r[8] < r[32] < r[64] == 1.0


def test_ivf(spark, base, asked, tmp_path):
    index = ivf.train(base, 16, 8, 5).add(base)
    got = {p: recall(index.search(asked, 10, p, base, 200), base, asked) for p in (1, 4, 16)}
    assert got[1] <= got[4] <= got[16] and got[16] > 0.9
    twice = index.add(base.where("id < 50"))
    assert twice.lists.count() == 500 and sum(r["n"] for r in index.list_sizes().collect()) == 500
    dead = base.where("id < 100").select("id")
    assert index.search(asked, 10, 16, deleted=dead).where("id < 100").count() == 0 and index.compact(dead).lists.count() == 400
    index.set_metadata('{"a": 1}', lambda m: m["a"] == 1)
    with pytest.raises(EngineError):
        index.set_metadata("{")
    index.save(str(tmp_path / "i"))
    back = ivf.load(spark, str(tmp_path / "i"))
    assert back.metadata == '{"a": 1}' and sorted(map(tuple, back.search(asked, 3, 4).collect())) == sorted(map(tuple, index.search(asked, 3, 4).collect()))
    moved = index.reassign(base.where("id = 7").select("id"), 3, base)
    assert moved.lists.where("id = 7").first()["cell"] == 3 and moved.lists.count() == 500
    assert index.update_centroid(0, index.centroids[0] * 0.9, base).lists.count() == 500
    assert index.reconstruct().count() == 500
    assert index.explain_rank(asked.where("qid = 0"), spark.createDataFrame([(0, 0)], "qid bigint, id bigint")).first()["rank"] <= 50
    with pytest.raises(EngineError):
        ivf.train(base, 1000)
    assert ivf.rerank_pool(10, 8) == 64 and ivf.rerank_pool(10_000, 8) == 2000


@pytest.mark.parametrize("kind,params", [("hnsw", {}), ("vamana", {"degree": 32, "beam": 64})])
def test_graphs(spark, base, asked, tmp_path, kind, params):
    index = graph.build(base, kind, rows_per_partition=250, **params)
    index.nodes = index.nodes.cache()
    assert recall(index.search(asked, 10, 100), base, asked) > 0.9
    assert all(r["reached"] >= 0.95 * r["nodes"] for r in index.reachable().collect())
    s = index.degree_stats().first()
    assert s["nodes"] == 500 and s["most"] <= 64 and index.neighbours().count() == s["edges"]
    dead = base.where("id % 10 = 0").select("id")
    assert index.search(asked, 10, 100, deleted=dead).where("id % 10 = 0").count() == 0
    mended = index.repair(dead)
    live = base.where("id % 10 <> 0")
    assert recall(mended.search(asked, 10, 100), live, asked) > 0.85
    index.save(str(tmp_path / "g"))
    assert graph.load(spark, str(tmp_path / "g")).nodes.count() == 500


def test_cascade(base, asked):
    c = cascade.build(base, 16, 4)
    assert recall(c.search(asked, 10, 0.999), base, asked) > 0.6


def test_planner():
    assert [manager.choose_index(n, 128) for n in (1_000, 1_000_000, 50_000_000)] == ["hnsw", "ivf_pq", "vamana"]
    assert manager.hybrid_indexes(200_000) == ["hnsw", "ivf_pq", "vamana"]
    assert manager.plan_query(10_000_000, 0.0001, ["hnsw"]).kind == "flat" and manager.plan_query(10_000_000, 1.0, ["hnsw", "ivf_pq"]).kind == "hnsw"
    assert manager.demote_for_budget({"hnsw": (100, 1.0), "ivf_pq": (10, 5.0)}, 50) == [("hnsw", "ivf_pq")]
    assert [manager.repair_action(x) for x in (0.01, 0.06, 0.12, 0.17, 0.25, 0.5)] == ["none", "relink", "recentre", "compact", "robust_prune", "rebuild"]
    assert manager.route(True, True) == "parallel" and manager.route(True, False) == "sparse_only"
    with pytest.raises(EngineError):
        manager.route(False, False)


def test_hybrid_filter(spark, base):
    texts = ["machine learning algorithms neural networks", "deep learning transformer models attention", "natural language processing bert gpt", "computer vision image classification cnn", "reinforcement learning policy gradient"]
    index = bm25.build(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    five = base.where("id < 5")
    q = spark.createDataFrame([(0, "learning")], "qid bigint, text string").join(base.select(F.col("id").alias("qid"), "vector"), "qid")
    allowed = spark.createDataFrame([(0,), (1,), (2,)], "id bigint")
    for strategy in ("auto", "dense_first", "sparse_first"):
        got = manager.hybrid_search(q, index, five, manager.HybridConfig(strategy=strategy), allowed).collect()
        assert got and {r["id"] for r in got} <= {0, 1, 2}
    text_only = q.withColumn("vector", F.lit(None).cast("array<float>"))
    assert {r["id"] for r in manager.hybrid_search(text_only, index, five).collect()} == {0, 1, 4}


def test_manager(spark, base, asked, tmp_path):
    m = manager.IndexManager(base.select("id", "vector"), 64).build(["ivf_pq"])
    m.metadata = base.select("id", "label")
    from quarry.operators.filters import Term

    got = m.search(asked, 5, Term("label", "3"), "ivf_pq", nprobe=64)
    assert got.join(base, "id").where("label <> 3").count() == 0 and recall(m.search(asked, 10, kind="ivf_pq", nprobe=64), base, asked) > 0.8
    m.remove(base.where("id < 20").select("id"))
    assert m.search(asked, 5).where("id < 20").count() == 0
    m.add(base.where("id < 10").select("id", "vector"))
    assert m.search(asked, 1).where("id < 10").count() >= 10
    m.save(str(tmp_path / "m"))
    back = manager.load_manager(spark, str(tmp_path / "m"))
    assert back.search(asked, 3, kind="ivf_pq").count() == 1500
    m.optimize()
    assert m.base.count() == 490 and m.deleted is None
