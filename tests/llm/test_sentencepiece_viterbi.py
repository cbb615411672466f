import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import sentencepiece_viterbi as m


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=m.MODEL)


@pytest.fixture(scope="module")
def ours():
    return m.Encoder()


def random_text(rng, n):
    return "".join(rng.choice("ab  theing\n\tßéñ中😀▁1.<s>") for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(text):
    e = m.encoder(m.MODEL)
    assert m.decode_ids(e.m, e.encode(text)) == text.replace("▁", " ")


def test_same_ids_as_the_library(library, ours):
    rng = random.Random(1)
    texts = ["", " ", "  ", "▁", "a" * 200, " " * 60 + "x", "x" + " " * 40, "<s> </s> <unk>", "\x00\x01"] + [random_text(rng, rng.randint(1, 120)) for _ in range(2000)]
    assert [ours.encode(t) for t in texts] == [library.encode(t) for t in texts]


def test_streaming_equals_whole_and_the_window_is_bounded(library):
    p = m.pieces(m.MODEL)
    text = "thereinverbeithunmente" * 500
    v = m.StreamingViterbi(p)
    early = 0
    for i, c in enumerate(m.SPACE + text):
        v.push(c)
        if i == 5000:
            early = len(v.out)
    assert early > 100 and v.widest <= 2 * p.longest
    assert v.end() == library.encode(text)


def test_pairs_by_undone_merges_equal_merging():
    p = m.pieces(m.MODEL)
    rng, ids = random.Random(2), [i for i in p.ids.values() if p.text[i] not in p.tied]
    for _ in range(3000):
        a, b = p.text[rng.choice(ids)], p.text[rng.choice(ids)]
        assert p._apart(a, b) == (p.merge(a + b) == [a, b])


def test_edges(edges, library):
    rows = {(r["doc_id"], i): r for i, r in enumerate(m.encode_documents(edges).collect())}
    texts = [r["text"] for r in edges.collect()]
    got = [r["ids"] for r in m.encode_documents(edges).collect()]
    assert got == [None if t is None else library.encode(t) for t in texts]
    assert all(r["n_ids"] == (None if r["ids"] is None else len(r["ids"])) for r in rows.values())
    back = m.decode_documents(m.encode_documents(edges)).collect()
    assert [r["text"] for r in back] == texts


def test_the_query_decodes_every_document(spark, edges):
    from quarry.llm import queries

    rows = queries.op9_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len(rows) == len(texts) and all(r["decoded"] == texts[r["doc_id"]] for r in rows)
    assert all(r["round_trip"] == (None if r["decoded"] is None else True) for r in rows)
    assert [r["decoded"] for r in m.encode_and_decode(edges).collect()] == [r["text"] for r in edges.collect()]


def test_empty(empty):
    assert m.encode_documents(empty).count() == 0 and m.decode_documents(m.encode_documents(empty)).count() == 0
