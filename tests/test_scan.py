import numpy as np
import pytest

from quarry.functions import vector
from quarry.operators import scan
from quarry.operators.knn import top_rows
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


def brute(q, x, ids, k, metric):
    r, c = top_rows(vector.pairwise(q.astype(float), x.astype(float), metric), ids, k)
    return list(zip(r.tolist(), ids[c].tolist()))


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e20])
def test_nearest_is_exact_over_blocks_with_copies_and_near_ties(metric, scale):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 8)), 1)
    x = np.vstack([x, x[:300], x[:300], x[:100] + 1e-7, np.zeros((2, 8)), np.full((1, 8), np.nan)]) * scale
    x = x if scale > 1 else x.astype(np.float32)
    ids = rng.permutation(len(x))
    q = x[rng.permutation(1300)[:300]]
    s = scan.Vectors(metric)
    near = scan.Nearest(s, s.lift(q, True), 7)
    for i in range(0, len(x), 211):
        near.feed(ids[i : i + 211], s.lift(x[i : i + 211], False))
    r, found, score, _ = near.found()
    exact = np.round(np.stack([s.exact(s.lift(q, True), np.full(len(x), i), s.lift(x, False), np.arange(len(x))) for i in range(len(q))]), 6)
    want = [(i, ids[c]) for i in range(len(q)) for c in np.lexsort((ids, exact[i]))[:7] if np.isfinite(exact[i, c])]
    assert list(zip(r.tolist(), found.tolist())) == want
    if scale == 1:
        assert sorted(want) == sorted(brute(q, x, ids, 7, metric))


def test_bits_and_cells():
    rng = np.random.default_rng(4)
    code = rng.integers(-(2**62), 2**62, (400, 2))
    code[:, 0] = code[0, 0]
    ids, cell, cells = np.arange(400)[::-1].copy(), rng.integers(0, 3, 400), rng.random((50, 3)) < 0.5
    search = scan.Search({"qid": np.arange(50), "vector": code[:50], "at": cells}, scan.Bits(), 5, lambda b, asks: {"key": b["vector"], "cell": b.get("cell")}, cells=lambda _: cells)
    for i in range(0, 400, 90):
        list(search.feed({"id": ids[i : i + 90], "vector": code[i : i + 90], "cell": cell[i : i + 90]}))
    (got,) = search.finish()
    d = np.bitwise_count((code[:50, None] ^ code[None]).view(np.uint64)).sum(axis=2)
    want = [(i, ids[c], float(d[i, c])) for i in range(50) for c in sorted(np.flatnonzero(cells[i][cell]), key=lambda c: (d[i, c], ids[c]))[:5]]
    assert list(zip(got["qid"], got["id"], got["score"])) == want


QUADRATIC = ["knn_blocks", "distance_matrix_l2", "pairwise_cosine", "range_search_l2", "hamming_topk", "matryoshka_progressive", "pq_adc_topk", "ivf_flat_search", "ivf_rerank", "ivf_pq_search", "cascade_search"]


@pytest.mark.parametrize("name", QUADRATIC)
def test_pairs_are_blocks_not_rows(spark, monkeypatch, name):
    """What meets every query is a block; no join or cogroup is given a row for each pair."""
    crossed, joined, DataFrame = [], [], type(spark.range(1))
    cross, join = DataFrame.crossJoin, DataFrame.join
    monkeypatch.setattr(DataFrame, "crossJoin", lambda a, b: crossed.append(b.columns) or cross(a, b))
    monkeypatch.setattr(DataFrame, "join", lambda a, b, on=None, how=None: joined.append(on) or join(a, b, on, how))
    assert catalog.QUERIES[name](spark, SF).columns
    assert crossed == [["block", "asked"]] and set(map(str, joined)) <= {"id"}
