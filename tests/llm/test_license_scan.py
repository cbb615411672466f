import random

from quarry.llm import license_scan as m


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], max(before + 1 if x == y else 0, row[j], row[j + 1])
    return row[-1]


def test_alignment_is_increasing_and_near_the_longest():
    rng = random.Random(4)
    for _ in range(200):
        b = [f"w{i}" for i in rng.sample(range(60), 40)]
        a = [w for w in b if rng.random() > 0.1]
        for _ in range(5):
            a.insert(rng.randrange(len(a) + 1), f"x{rng.randrange(5)}")
        pairs = m.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == lcs(a, b)  # words are unique here


def test_gaps_are_aligned_again():
    a = "x the a the b the c".split()
    assert len(m.patience(a, "x the a the q the c".split())) == 6


def filler(rng, n):
    return " ".join("".join(rng.choice("bcdfgklm") + rng.choice("aeo") for _ in range(3)) for _ in range(n))


def test_finds_planted_templates_and_nothing_else():
    rng, scanner = random.Random(7), m.Scanner()
    for name, text in m.TEMPLATES.items():
        words = text.split()
        if len(words) > 15:
            words[rng.randrange(len(words))] = "changed"
        doc = filler(rng, 300) + "\n" + " ".join(words) + ".\n" + filler(rng, 500)
        hits = scanner.scan(doc)
        assert [h[0] for h in hits] == [name], (name, hits)
        assert hits[0][3] >= 0.8 and "changed" not in doc[: hits[0][1]]
    for _ in range(20):
        assert scanner.scan("this work is a version of the general license public " + filler(rng, 200)) == []


def test_near_relatives_are_told_apart():
    s, gpl, bsd = m.Scanner(), m.TEMPLATES["GPL-header"], m.TEMPLATES["BSD-2"]
    third = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    for text, name in ((gpl, "GPL-header"), (gpl.replace("GNU General", "GNU Lesser General"), "LGPL-header"), (gpl.replace("GNU General", "GNU Affero General"), "AGPL-header"), (bsd, "BSD-2"), (bsd + third, "BSD-3")):
        assert [h[0] for h in s.scan("some words before. " + text + " and after")] == [name]


def test_two_in_one_text_and_repeats():
    s = m.Scanner()
    one, two = m.TEMPLATES["MIT-notice"], m.TEMPLATES["GPL-3.0-notice"]
    hits = s.scan(f"{one}. {'word ' * 80} {two}. {'more ' * 40} {one}.")
    assert [h[0] for h in hits] == ["MIT-notice", "GPL-3.0-notice", "MIT-notice"]
    adjacent = s.scan(f"{one}. {one}.")
    assert [h[0] for h in adjacent] == ["MIT-notice"] * 2


def test_telling_words_cover_what_the_coverage_needs():
    for t in m.Scanner().templates:
        assert sum(w in t.telling for w in t.words) > (1 - m.COVERAGE) * len(t.words)


def test_edges(edges, docs, empty):
    assert m.license_scan(edges).count() == 0 and m.license_scan(empty).count() == 0
    text = "a b c. " + m.TEMPLATES["Apache-2.0-notice"]
    rows = m.license_scan(docs([(1, text, "a"), (1, text, "a"), (None, text, None), (2, "x " * 50_000 + text, "b")])).collect()
    assert [r["license"] for r in rows] == ["Apache-2.0-notice"] * 4 and sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "None"]
    assert all(text.endswith(r["coverage"] and "Version 2.0") for r in rows) and max(r["start"] for r in rows) == 100_007
