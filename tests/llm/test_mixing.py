from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import mixing as m


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 60))
def test_knapsack_against_brute_force(counts, budget):
    taken = m.knapsack(counts, budget)
    assert all(0 < n <= counts[k] for k, n in taken.items())
    got = sum(k * n for k, n in taken.items())
    sums = {sum(k * n for k, n in zip(counts, ns)) for ns in product(*[range(c + 1) for c in counts.values()])}
    assert got == max(s for s in sums if s <= budget)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.integers(1, 40), min_size=1, max_size=30), st.integers(0, 40_000))
def test_budget_is_met_or_nearly(counts, budget):
    taken = m.fit_budget(counts, budget)
    got = sum(k * n for k, n in taken.items())
    total = sum(k * n for k, n in counts.items())
    assert got <= max(budget, 0) or got == total
    assert all(n <= counts[k] for k, n in taken.items())
    if budget >= total:
        assert got == total
    elif 1 in counts and counts[1] > 30:
        assert got >= budget - max(counts)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=4), st.integers(0, 90))
def test_budget_against_brute_force(counts, budget):
    sums = {sum(k * n for k, n in zip(counts, ns)) for ns in product(*[range(c + 1) for c in counts.values()])}
    taken = m.fit_budget(counts, budget)
    assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= budget)
    assert all(0 < n <= counts[k] for k, n in taken.items())


def test_large_budgets_are_met_to_the_token():
    counts = {k: 1 + 10**6 // k**2 for k in range(7, 3000, 3)} | {60_000: 2, 99_991: 1}
    total = sum(k * n for k, n in counts.items())
    for budget in (total // 2, total // 3 + 1, total - 1000):
        assert sum(k * n for k, n in m.fit_budget(counts, budget).items()) == budget
    assert m.fit_budget({3: 10, 10: 1}, 10) in ({10: 1}, {3: 0, 10: 1})
    assert m.fit_budget({3: 2, 4: 3}, 6) == {3: 2}


def test_a_common_length_is_cut_in_parts(docs, monkeypatch):
    df = docs([(i, f"a b {i}", "s" if i % 3 else None) for i in range(2000)] + [(5, "a b 5", "s")])
    want = sorted(r["doc_id"] for r in m.mixture(df, total=1500).collect())
    monkeypatch.setattr(m, "HOT", 10)
    assert sorted(r["doc_id"] for r in m.mixture(df, total=1500).collect()) == want and 490 < len(want) <= 500


def rows(n=900):
    return [(i, " ".join(["w"] * (1 + (i * 7) % 40)) + f" {i}", "abc"[(i * i + i) % 5 % 3]) for i in range(n)]


def test_exact_budgets_by_source(docs):
    df = docs(rows())
    tokens = {}
    for r in df.collect():
        tokens[r["source"]] = tokens.get(r["source"], 0) + len(r["text"].split())
    weights = {s: w for s, w in zip(sorted(tokens), (0.5, 0.3, 0.2))}
    out = m.mixture(df, weights=weights, total=2000).collect()
    got = {}
    for r in out:
        got[r["source"]] = got.get(r["source"], 0) + r["n_tokens"]
    assert got == {s: round(2000 * w) for s, w in weights.items()}
    assert len({r["doc_id"] for r in out}) == len(out)
    again = {r["doc_id"] for r in m.mixture(df.repartition(5), weights=weights, total=2000).collect()}
    other = {r["doc_id"] for r in m.mixture(df, weights=weights, total=2000, seed=99).collect()}
    assert again == {r["doc_id"] for r in out} != other


def test_without_total_the_scarcest_source_is_used_whole():
    tokens = {"a": 1000, "b": 10, None: 300}
    w = m.tempered_weights(tokens)
    b = m.budgets(tokens, w)
    assert any(abs(b[s] - tokens[s]) <= 1 for s in tokens) and all(b[s] <= tokens[s] for s in tokens)
    assert w["a"] / w["b"] < 100


def test_a_tiny_source_does_not_shrink_the_others():
    tokens = {"tiny": 3, "a": 10_000_000, "b": 10_000_000, None: 4_000_000}
    b = m.budgets(tokens, m.tempered_weights(tokens))
    assert b["tiny"] == 3 and abs(sum(b.values()) - sum(tokens.values()) // 2) <= 3
    assert b["a"] == b["b"] and abs(b[None] / b["a"] - 0.4**0.75) < 1e-3
    like = {"a": 1000, "b": 800}
    assert m.budgets(like, {"a": 1.0, "b": 1.0}) == {"a": 800, "b": 800}
    assert m.budgets({"a": 100, "b": 1000, "c": 1000}, {"a": 1.0, "b": 1.0, "c": 1.0}, 900) == {"a": 100, "b": 400, "c": 400}


def test_edges(edges):
    out = m.select_mixture(edges)
    assert out.columns == edges.columns
    assert all(r["text"] and r["text"].split() for r in out.collect())
    every = m.select_mixture(edges, weights={"a": 1.0, "b": 1.0, None: 1.0}, total=10**9)
    assert sorted(str(r["doc_id"]) for r in every.collect()) == sorted(["1", "2", "2", "None", "7", "8", "9", "10", "10"])
    assert m.select_mixture(edges, weights={"nobody": 1.0}, total=5).count() == 0


def test_empty(empty):
    assert m.select_mixture(empty).count() == 0 and m.mixture(empty).count() == 0
