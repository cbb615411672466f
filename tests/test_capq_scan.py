import numpy as np

from quarry.operators import quantize, scan


def test_capq_pools_are_those_of_sorting_all_pairs():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 64))
    x[450:] = x[:450]
    model = quantize.Capq(np.zeros(64), np.eye(64), np.full(64, 3.0 / 127))
    block = {"id": np.arange(900), "planes": model.planes(x) & 0xFF, "q8": model.q8(x)}
    block["q4"] = model.coarsen(block["q8"])
    asked = {c: v[:70] for c, v in block.items() if c != "id"} | {"qid": np.arange(70)}
    keep1, keep2, k, scale2 = 130, 40, 10, np.full(64, (3.0 / 127) ** 2)
    s = quantize._CapqScan(asked, scale2, keep1, keep2, k)
    for p in (0, 1):
        for i in range(0, 900, 200):
            list(s.feed({c: v[i : i + 200] for c, v in block.items()} | {"pass": p}))
    (got,) = s.finish()
    want = []
    for q in range(70):
        s1 = np.bitwise_count((block["planes"] ^ asked["planes"][q]).view(np.uint64)).sum(axis=1)
        s2 = ((block["q4"].astype(int) - asked["q4"][q]) ** 2).sum(axis=1)
        s3 = np.round((block["q8"].astype(float) - asked["q8"][q]) ** 2 @ scale2, scan.SCALE)
        one = sorted(range(900), key=lambda i: (s1[i], i))[:keep1]
        two = sorted(one, key=lambda i: (s2[i], i))[:keep2]
        want += [(q, i, s1[i], s2[i], s3[i]) for i in sorted(two, key=lambda i: (s3[i], i))[:k]]
    assert list(zip(*(got[c].tolist() for c in ("qid", "id", "s1", "s2", "score")))) == want
