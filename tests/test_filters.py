import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.errors import EngineError
from quarry.operators import filters as f
from quarry.operators.filters import And, Nor, Or, Range, Term

DOCS = [(1, {"color": "red", "shape": "circle"}, {"price": 9.99}), (2, {"color": "blue"}, {"price": 5.0}), (3, {}, {})]
EXPRS = [Term("color", "red"), Range("price", 6, 10), And((Term("color", "red"), Range("price", 6, 10))), Or((Term("color", "red"), Term("color", "blue"))), Nor((Term("color", "red"), Term("color", "blue"))), And(), Or(), Nor(), Nor((Term("gone", "x"),)), Range("price", 5.0, 5.0)]


@pytest.mark.parametrize("expr", EXPRS, ids=str)
def test_columns_equal_rows(spark, expr):
    df = spark.createDataFrame(DOCS, "id int, tags map<string,string>, nums map<string,double>")
    got = {r["id"] for r in df.where(f.compile_filter(expr, df, "tags", "nums")).collect()}
    assert got == {i for i, t, n in DOCS if f.matches(expr, t, n)}


def test_truth_table():
    one, two = DOCS[0][1:], DOCS[1][1:]
    assert [f.matches(e, *one) for e in EXPRS[:8]] == [True, True, True, True, False, True, False, True]
    assert [f.matches(e, *two) for e in EXPRS[:2]] == [False, False]


exprs = st.recursive(st.builds(Term, st.text(max_size=4), st.text(max_size=4)) | st.builds(Range, st.text(max_size=3), st.floats(-9, 9), st.floats(-9, 9)), lambda c: st.builds(And, st.lists(c, max_size=3).map(tuple)) | st.builds(Or, st.lists(c, max_size=3).map(tuple)) | st.builds(Nor, st.lists(c, max_size=3).map(tuple)), max_leaves=6)


@given(exprs)
def test_json_round_trip(expr):
    assert f.from_json(f.to_json(expr)) == expr


@pytest.mark.parametrize("text", ["", "[]", "{}", '{"xor": []}', '{"term": {}}', '{"range": {"field": "a", "min": "x", "max": 1}}', '{"and": 3}'])
def test_bad_json(text):
    with pytest.raises(EngineError):
        f.from_json(text)


def test_bitmap_counts(spark):
    red, circle = {0, 3, 6, 11}, {1, 4, 7, 9, 12, 15}
    df = spark.createDataFrame([(i, "red" if i in red else None, "circle" if i in circle else None) for i in range(16)], "id int, color string, shape string")
    n = lambda e: f.search(df, e).count()
    r, c = Term("color", "red"), Term("shape", "circle")
    assert [n(And((r, c))), n(r), n(Nor((r,))), n(Nor((r, c))), n(Or((r, c)))] == [0, 4, 12, 6, 10]
    assert [x["id"] for x in f.search(df, Nor((r,)), limit=3).collect()] == [1, 2, 4]
    assert f.filter_candidates(spark.createDataFrame([(0,), (1,)], "id int"), df, r).count() == 1


def test_typed_terms(spark):
    df = spark.createDataFrame([(1, True, 7, 2.5)], "id int, b boolean, n int, d double")
    hit = lambda e: df.where(f.compile_filter(e, df)).count()
    assert [hit(Term("b", "true")), hit(Term("n", "7")), hit(Term("d", "2.5")), hit(Range("n", 7, 7)), hit(Range("d", 2, 3))] == [1, 1, 0, 1, 1]


def test_more_leaves(spark):
    df = spark.createDataFrame([(1, "apple", ["x", "y"]), (2, None, None)], "id int, s string, tags array<string>")
    hit = lambda *a: df.where(f.compile_filter(f.Leaf(*a), df)).count()
    assert [hit("s", "starts_with", "ap"), hit("s", "ne", "x"), hit("s", "in", ["apple"]), hit("tags", "has_tag", "x"), hit("tags", "has_all_tags", ["x", "z"]), hit("tags", "has_any_tag", ["x", "z"]), hit("gone", "eq", 1)] == [1, 1, 1, 1, 0, 1, 0]


def test_selectivity():
    cards = {("c", "r"): 25}
    assert f.selectivity(And((Term("c", "r"), Range("p", 0, 30))), cards, 100) == pytest.approx(0.075)
    assert f.selectivity(Nor((Term("c", "r"),)), cards, 100) == 0.75 and f.selectivity(Range("p", 0, 900), cards, 100) == 0.5
