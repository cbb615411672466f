import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, rep int, words int, keep string, group_id int, key string, mix_len int, stat_n_chars int, shard string, `order` int, `a.b` int"


def make(spark, rows):
    """A table of documents (id, text, source) with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", s, len(t) if t is not None else None, "x", 1, 2, "k", 3, "y", 4, 5, "z", 6, 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture
def edges(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, a null id."""
    prose = "the quick brown fox jumps over a lazy dog while seven wizards watch from their tower near the river bank today"
    return make(
        spark,
        [
            (1, prose, "a"), (2, prose, "b"), (2, prose, "b"), (3, None, "a"), (4, "", "a"), (5, "", None), (6, "   \n ", "b"),
            (None, prose, None), (None, None, None), (7, "word " * 60_000, "a"), (8, "é" * 5_000, "b"), (9, prose + " indeed", "a"), (10, "x", "b"), (10, "x", "b"),
        ],
    )


@pytest.fixture
def empty(spark):
    return make(spark, [])
