import random

import numpy as np

from quarry.llm import simhash_bktree as m


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(60, 300)))) for i in range(n)]
    for i in range(60):
        t = rows[i][1].split()
        for _ in range(max(1, len(t) // 20)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((n + i, " ".join(t)))
    return rows


def brute_pairs(texts, radius):
    s, has = m.signatures(texts)
    u = s.view(np.uint64)
    return {(i, j) for i in range(len(texts)) for j in range(i) if has[i] and has[j] and m.hamming(u[i], u[j]) <= radius}


def test_tree_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (400, 2)).astype(np.uint64)
    near = base[:200].copy()
    for b in range(20):
        near[:, b % 2] ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    sig = np.vstack([base, near, base[:5]])
    for radius in (0, 10, 23, 60):
        q, s = m.BKTree(sig).search(sig, radius)
        d = m.hamming(sig[:, None], sig[None])
        assert set(zip(q.tolist(), s.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= radius))))


def test_groups_are_the_components_of_brute_force_pairs(docs):
    rows = corpus()
    got = {r["doc_id"]: r["group_id"] for r in m.near_duplicate_members(docs([(i, t, "a") for i, t in rows])).collect()}
    pairs = brute_pairs([t for _, t in rows], m.RADIUS)
    assert len(pairs) >= 55
    up = {i: i for pair in pairs for i in pair}
    for _ in range(10):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up
    assert all(got.get(300 + i) == i for i in range(60) if (300 + i, i) in pairs)


def test_recall_with_many_shards(docs, monkeypatch):
    rows = corpus(400, 5)
    monkeypatch.setattr(m, "SHARD", 16)
    got = {r["doc_id"] for r in m.near_duplicates(docs([(i, t, "a") for i, t in rows])).collect()}
    want = {max(p) for p in brute_pairs([t for _, t in rows], m.RADIUS)}
    assert len(got & want) >= 0.9 * len(want) and got <= want


def test_chains_become_one_component(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (200, 200)], "a bigint, b bigint")
    got = {r["v"]: r["root"] for r in m.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {200: 200, 201: 200}


def test_edges(edges):
    got = {r["doc_id"]: r["dup_of"] for r in m.near_duplicates(edges).collect()}
    assert got[2] == 1 and got[9] == 1 and not {3, 4, 5, 6, 7, 8, 10} & set(got)
    out = m.drop_near_duplicates(edges)
    assert out.columns == edges.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(10) == 2 and ids.count(None) == 2 and 2 not in ids and 9 not in ids and {1, 3, 4, 5, 6, 7, 8} <= set(ids)


def test_plan_keeps_the_recall_at_the_radius():
    assert m.plan(1000) == (0, 1)
    for n in (10**5, 10**8, 10**10):
        k, t = m.plan(n)
        met = lambda d: 1 - (1 - (1 - d / m.BITS) ** k) ** t  # noqa: E731, B023
        assert met(m.RADIUS) >= 0.9 and met(16) >= 0.98 and t <= 300


def test_a_shard_of_near_copies_gives_spanning_edges(monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, (6, 2)).astype(np.uint64)
    sig = np.repeat(centre, 600, axis=0)
    for _ in range(14):
        at = rng.integers(0, 128, len(sig))
        sig[np.arange(len(sig)), at // 64] ^= np.uint64(1) << (at % 64).astype(np.uint64)
    sig = np.unique(sig, axis=0)
    d = m.hamming(sig[:, None], sig[None]) <= m.RADIUS
    want = np.arange(len(sig))
    while True:  # the lowest neighbour's label, until nothing changes
        new = np.where(d, want[None], len(sig)).min(axis=1)
        if (new == want).all():
            break
        want = new
    for start in (10**9, 0):
        monkeypatch.setattr(m, "STARS_FROM", start)
        assert (m._linked(sig, m.RADIUS) == want).all()


def test_slices_do_not_change_signatures(monkeypatch):
    texts = [t for _, t in corpus(40)] + [None, "", " ".join(map(str, range(3000)))]
    want = m.signatures(texts)
    monkeypatch.setattr(m, "WORDS", 200)
    got = m.signatures(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_string_ids_and_dotted_names(spark):
    rows = [(f"id-{i:04d}", t, 1, 2) for i, t in corpus(60)]
    df = spark.createDataFrame(rows, "`doc.id` string, `a.text` string, rep int, `g.x` int")
    drop = {r["doc_id"]: r["dup_of"] for r in m.near_duplicates(df, "doc.id", "a.text").collect()}
    assert drop and all(isinstance(k, str) and v < k for k, v in drop.items())
    kept = m.drop_near_duplicates(df, "doc.id", "a.text")
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == {r[0] for r in rows} - set(drop)


def test_empty(empty):
    assert m.near_duplicates(empty).count() == 0 and m.drop_near_duplicates(empty).count() == 0


def far_copies(n=1500, seed=11):
    """Texts and copies of each with 6 to 18 % of the words replaced: many pairs are close to the radius."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    texts = [rng.choices(words, k=rng.randint(60, 120)) for _ in range(n)]
    for t in texts[:n]:
        share = rng.uniform(0.06, 0.18)
        texts.append([rng.choice(words) if rng.random() < share else w for w in t])
    return [" ".join(t) for t in texts]


def brute_groups(texts):
    """Text to the lowest of its group, for texts in groups."""
    s, _ = m.signatures(texts)
    u = s.view(np.uint64)
    unions = m.Unions(len(u))
    for i in range(0, len(u), 500):
        a, b = np.nonzero(m.hamming(u[i : i + 500, None], u[None]) <= m.RADIUS)
        unions.join(a + i, b)
    top = unions.tops(np.arange(len(u)))
    return {i: t for i, t in enumerate(top.tolist()) if np.count_nonzero(top == t) > 1}


def test_no_link_is_lost_whatever_the_plan(docs, monkeypatch):
    texts = far_copies()
    want = brute_groups(texts)
    assert len(want) > 1500
    df = docs([(i, t, "a") for i, t in enumerate(texts)])
    for shard, block in ((m.SHARD, m.SWEEP), (16, 800), (10**9, m.SWEEP)):
        monkeypatch.setattr(m, "SHARD", shard)
        monkeypatch.setattr(m, "SWEEP", block)
        assert {r["doc_id"]: r["group_id"] for r in m.near_duplicate_members(df).collect()} == want, (shard, block)


def test_the_sweep_finds_what_brute_force_finds():
    rng = np.random.default_rng(7)
    for radius in (0, 1, 4, 22, 23, 40):
        a = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
        b = a.copy()
        for i in range(len(b)):  # a little within and a little beyond the radius, spread over all bits
            for bit in rng.choice(128, min(radius + i % 3, 128), replace=False).tolist():
                b[i, bit // 64] ^= np.uint64(1 << bit % 64)
        want = m.Unions(600)
        x, y = np.nonzero(m.hamming(a[:, None], b[None]) <= radius)
        want.join(x, 300 + y)
        got = m.Unions(600)
        for piece in m.pieces(radius):
            m._across(a, np.arange(300), b, np.arange(300, 600), piece, radius, got)
        assert (got.tops(np.arange(600)) == want.tops(np.arange(600))).all(), radius


def test_links_of_the_sweep_with_nested_ids(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD", 16)
    rows = [((i % 7, str(i)), t) for i, t in corpus(60)]
    df = spark.createDataFrame(rows, "doc_id struct<a int, b string>, text string")
    got = {tuple(r["doc_id"]): tuple(r["group_id"]) for r in m.near_duplicate_members(df).collect()}
    ids = [i for i, _ in rows]
    top = brute_groups([t for _, t in rows])
    assert got == {ids[i]: min(ids[j] for j in top if top[j] == t) for i, t in top.items()}
