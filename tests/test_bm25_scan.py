import pytest
from pyspark.sql import functions as F

from quarry.functions.text import TokenCounter, TokenOptions, tokens
from quarry.operators import bm25, fusion

TEXTS = ["The Cat sat; the cat's hat!", "İstanbul ÄÖ straße cat\x0bdog\x1fcat", "", None, "a b cc the THE " + "x" * 50 + " " + "y" * 51 + " É", "cat_dog-dog\tdog\r\ndog\x0ccat", "中文 cat 中"]


@pytest.mark.parametrize("options", [TokenOptions(), TokenOptions(lowercase=False, remove_punctuation=False), TokenOptions(remove_stop_words=False, min_bytes=1, max_bytes=4)])
def test_counter_finds_the_tokens_of_the_expression(spark, options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    want = {r["i"]: sorted(r["t"]) for r in df.select("i", tokens(F.col("text"), options).alias("t")).collect()}
    count = TokenCounter(options)
    assert {i: sorted(w.decode() for w in count(t.encode() if t is not None else None).elements()) for i, t in enumerate(TEXTS)} == want


@pytest.fixture(params=[False, True], ids=["ids once", "an id twice and none"])
def index(spark, request):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + ([(0, "cat cat dog"), (None, "dog hat")] if request.param else [])
    return bm25.build(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scored_where_read_equals_joined(spark, index):
    queries = spark.createDataFrame([(7, "cat cat dog unknown"), (3, "hat 中文"), (5, ""), (9, "the")], "qid bigint, text string")
    allowed = spark.createDataFrame([(0,), (1,), (5,)], "doc_id bigint")
    joined = bm25.Bm25Index(index.postings, index.lengths)
    assert joined.docs is None
    for k in (1, 10):
        assert plain(bm25.search(index, queries, k)) == plain(bm25.search(joined, queries, k)) != []
        assert plain(bm25.search(index, queries, k, allowed=allowed)) == plain(bm25.search(joined, queries, k, allowed=allowed)) != []
    assert plain(bm25.query_dots(index, queries)) == plain(bm25.sparse_dot(bm25.encode(joined, queries), bm25.document_vectors(joined))) != []
    terms = bm25.query_terms(queries)
    assert plain(fusion.late_interaction_of_terms(index, terms, 100.0)) == plain(fusion.late_interaction_of_terms(joined, terms, 100.0)) != []


def test_search_joins_no_postings(spark, monkeypatch):
    index, DataFrame = bm25.build(spark.createDataFrame([(0, "cat dog"), (1, "cat")], "doc_id bigint, text string")), type(spark.range(1))
    monkeypatch.setattr(DataFrame, "join", lambda *_: pytest.fail("a join"))
    assert bm25.search(index, spark.createDataFrame([(0, "dog")], "qid bigint, text string")).first()["id"] == 0


def test_rare_terms_are_shuffled_and_common_ones_sent(spark, monkeypatch):
    texts = [f"common{i % 3} middle{i % 20} rare{i}" for i in range(100)]
    index = bm25.build(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    want = plain(bm25.document_vectors(index))
    monkeypatch.setattr(bm25, "ASKED_TERMS", 10)
    assert plain(bm25.document_vectors(index)) == want and len(want) == 300
