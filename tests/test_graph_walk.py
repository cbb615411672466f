import numpy as np
import pytest

from quarry.functions import vector
from quarry.operators import graph


@pytest.mark.parametrize("make", [graph.build_hnsw, graph.build_graph])
@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_walks_in_step_find_what_single_walks_find(make, n):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 6))
    links, entries = make(x)
    if not n:
        assert links == []
        return
    q = rng.normal(size=(40, 6))
    d, at = graph.greedy_all(q, x, graph.padded(links), entries, 12)
    assert d.shape == at.shape == (40, 12) and (np.diff(d[:, : min(12, n)], axis=1) >= 0).all() and (at[:, min(12, n) :] == n).all()
    exact = np.sort(vector.pairwise(q, x, "l2"), axis=1)[:, :12]
    single = [[a for a, _ in graph.greedy(v, x, links, entries, 12)[0]] for v in q]
    for own, one, best in zip(d, single, exact):
        assert np.sum(np.isclose(own[: len(best)], best)) >= np.sum(np.isclose(one, best)) - 1


def test_earlier_nodes_are_the_nearest_of_those_that_are_in():
    rng = np.random.default_rng(8)
    x, order = rng.normal(size=(600, 5)), rng.permutation(600)
    found = dict(graph._earlier(x, order, 9))
    assert len(found) == 599
    for place, i in list(enumerate(order))[1:]:
        d = ((x[order[:place]] - x[i]) ** 2).sum(axis=1)
        assert set(found[i]) == set(order[:place][np.argsort(d)[:9]])


def test_prune_equals_its_definition():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 4))
    for alpha, degree in ((1.0, 8), (1.2, 5), (1.2, 80)):
        c = sorted(range(1, 80), key=lambda j: ((x[j] - x[0]) ** 2).sum())
        want = []
        while c and len(want) < degree:
            want.append(c.pop(0))
            c = [j for j in c if alpha**2 * ((x[j] - x[want[-1]]) ** 2).sum() > ((x[j] - x[0]) ** 2).sum()]
        assert graph.robust_prune(0, np.arange(80), x, degree, alpha) == want
