from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, rice_decode, rice_encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, dtype=np.uint64))
    k, data = rice_encode(v)
    assert (rice_decode(len(v), k, data) == v).all()


def test_golomb_is_short():
    v = np.sort(np.random.default_rng(1).integers(0, 2**40, 10_000).astype(np.uint64))
    assert len(rice_encode(v)[1]) < 10_000 * 4.2  # 8 bytes a value uncoded


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        if r["text"] is not None:
            groups[r["text"]].append(r["doc_id"])
    out = []
    for ids in groups.values():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids)) for i in ids[1:]]
    return sorted(out, key=str)


def test_against_brute_force(edges):
    assert sorted(map(tuple, exact_duplicates(edges).collect()), key=str) == brute(edges.collect())


def test_drop_keeps_one_row_of_each_text_and_all_columns(edges):
    out = drop_exact_duplicates(edges)
    assert out.columns == edges.columns
    rows = out.collect()
    texts = [r["text"] for r in rows if r["text"] is not None]
    assert len(texts) == len(set(texts)) == len({r["text"] for r in edges.collect() if r["text"] is not None})
    assert sum(r["text"] is None for r in rows) == 2
    assert {r["doc_id"] for r in rows} >= {1, 3, 4, 10}


def test_many_copies_and_many_tasks(docs):
    df = docs([(i, f"text {i % 50}", "a") for i in range(1000)]).repartition(7)
    rows = exact_duplicates(df).collect()
    assert len(rows) == 950 and all(r["dup_of"] == r["doc_id"] % 50 and r["copies"] == 20 for r in rows)
    assert drop_exact_duplicates(df).count() == 50


def test_empty(empty):
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0
