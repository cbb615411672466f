"""Metadata filters: an expression tree, compiled to a boolean column.

A missing field makes a leaf false, never null, so that none-of a missing field is true. Fields are looked up in a map of
tags and a map of numbers, or in columns of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import EngineError


@dataclass(frozen=True)
class Term:
    """The field's text equals value; booleans count as "true" or "false", whole numbers as their digits."""

    field: str
    value: str


@dataclass(frozen=True)
class Range:
    """lowest <= field <= highest."""

    field: str
    lowest: float
    highest: float


@dataclass(frozen=True)
class And:
    """All children; none at all is true."""

    children: tuple = ()


@dataclass(frozen=True)
class Or:
    """Any child; none at all is false."""

    children: tuple = ()


@dataclass(frozen=True)
class Nor:
    """No child; none at all is true."""

    children: tuple = ()


Filter = Term | Range | And | Or | Nor


@dataclass(frozen=True)
class Leaf:
    """A predicate on one field beyond the two kinds of leaves: op names a column method or list test."""

    field: str
    op: str
    value: object

    def column(self, get: Callable[[str], Column]) -> Column:
        c, v = get(self.field), self.value
        tests = {
            "eq": lambda: c == v, "ne": lambda: c != v, "lt": lambda: c < v, "le": lambda: c <= v, "gt": lambda: c > v, "ge": lambda: c >= v,
            "in": lambda: c.isin(*v), "not_in": lambda: ~c.isin(*v), "starts_with": lambda: c.startswith(v), "contains": lambda: c.contains(v),
            "has_tag": lambda: F.array_contains(c, v), "has_any_tag": lambda: F.arrays_overlap(c, F.array(*map(F.lit, v))), "has_all_tags": lambda: F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0,
        }
        if self.op not in tests:
            raise EngineError("invalid_argument", f"no test {self.op}", "filter")
        return tests[self.op]()


def tag_lookup(columns: dict[str, str], tags: str | None = None) -> Callable[[str], Column | None]:
    """A field's text: a string, boolean or whole-number column of its own, else an entry of the map. Fractional columns have no text."""

    def get(field: str) -> Column | None:
        kind = columns.get(field)
        if kind in ("string", "boolean", "tinyint", "smallint", "int", "bigint"):
            return F.col(field).cast("string")
        return F.get(F.map_values(F.map_filter(tags, lambda k, _: k == field)), F.lit(0)) if tags and kind is None else None

    return get


def number_lookup(columns: dict[str, str], nums: str | None = None) -> Callable[[str], Column | None]:
    def get(field: str) -> Column | None:
        kind = columns.get(field)
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or (kind or "").startswith("decimal"):
            return F.col(field).cast("double")
        return F.get(F.map_values(F.map_filter(nums, lambda k, _: k == field)), F.lit(0)) if nums and kind is None else None

    return get


def compile_filter(expr: Filter | None, df: DataFrame, tags: str | None = None, nums: str | None = None) -> Column:
    """The expression over df's columns, true or false on every row; no expression is true."""
    columns = dict(df.dtypes)
    text, number = tag_lookup(columns, tags), number_lookup(columns, nums)

    def walk(e: Filter) -> Column:
        if isinstance(e, Term):
            c = text(e.field)
            return F.lit(False) if c is None else F.coalesce(c == e.value, F.lit(False))
        if isinstance(e, Range):
            c = number(e.field)
            return F.lit(False) if c is None else F.coalesce(c.between(e.lowest, e.highest), F.lit(False))
        if isinstance(e, Leaf):
            return F.coalesce(e.column(F.col), F.lit(False)) if e.field in columns else F.lit(False)
        parts = [walk(c) for c in e.children]
        if isinstance(e, And):
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        any_ = reduce(lambda a, b: a | b, parts, F.lit(False))
        return ~any_ if isinstance(e, Nor) else any_

    return F.lit(True) if expr is None else walk(expr)


def matches(expr: Filter | None, tags: dict[str, str], nums: dict[str, float]) -> bool:
    """The expression on one document's maps."""
    if expr is None:
        return True
    if isinstance(expr, Term):
        return tags.get(expr.field) == expr.value
    if isinstance(expr, Range):
        return expr.field in nums and expr.lowest <= nums[expr.field] <= expr.highest
    found = [matches(c, tags, nums) for c in expr.children]
    return all(found) if isinstance(expr, And) else any(found) if isinstance(expr, Or) else not any(found)


def search(df: DataFrame, expr: Filter | None, id_col: str = "id", limit: int = 0, **maps) -> DataFrame:
    """Matching ids, ascending; limit 0 is no limit."""
    out = df.where(compile_filter(expr, df, **maps)).select(id_col).orderBy(id_col)
    return out.limit(limit) if limit else out


def filter_candidates(candidates: DataFrame, df: DataFrame, expr: Filter | None, id_col: str = "id", **maps) -> DataFrame:
    return candidates.join(df.where(compile_filter(expr, df, **maps)).select(id_col), id_col, "left_semi")


def terms_of(pairs: dict[str, str]) -> And:
    return And(tuple(Term(k, v) for k, v in pairs.items()))


def to_json(expr: Filter) -> str:
    def walk(e):
        if isinstance(e, Term):
            return {"term": {"field": e.field, "value": e.value}}
        if isinstance(e, Range):
            return {"range": {"field": e.field, "min": e.lowest, "max": e.highest}}
        return {{And: "and", Or: "or", Nor: "not"}[type(e)]: [walk(c) for c in e.children]}

    return json.dumps(walk(expr))


def from_json(text: str) -> Filter:
    def walk(x):
        if not isinstance(x, dict) or len(x) != 1:
            raise EngineError("invalid_argument", "a filter is an object with one key", "filter")
        (kind, v), = x.items()
        try:
            if kind == "term":
                return Term(str(v["field"]), str(v["value"]))
            if kind == "range":
                return Range(str(v["field"]), float(v["min"]), float(v["max"]))
            return {"and": And, "or": Or, "not": Nor}[kind](tuple(walk(c) for c in v))
        except (KeyError, TypeError, ValueError) as e:
            raise EngineError("invalid_argument", f"bad {kind}", "filter") from e

    try:
        return walk(json.loads(text))
    except json.JSONDecodeError as e:
        raise EngineError("invalid_argument", str(e), "filter") from e


def selectivity(expr: Filter, cards: dict[tuple[str, str], int], total: int) -> float:
    """An estimate from value counts: a term its share, a range its width in hundreds up to a half, and the product,
    or a + b - ab, none-of one less its first child."""
    if isinstance(expr, Term):
        return cards.get((expr.field, expr.value), 0) / total if total else 0.0
    if isinstance(expr, Range):
        return min(0.5, (expr.highest - expr.lowest) / 100)
    found = [selectivity(c, cards, total) for c in expr.children]
    if isinstance(expr, And):
        return reduce(lambda a, b: a * b, found, 1.0)
    if isinstance(expr, Or):
        return reduce(lambda a, b: a + b - a * b, found, 0.0)
    return 1 - found[0] if found else 1.0


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) of each non-null value, in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    return long.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def store_stats(df: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(documents, field, distinct_values)."""
    counts = value_counts(df, fields).groupBy("field").agg(F.count(F.lit(1)).alias("distinct_values"))
    return counts.crossJoin(F.broadcast(df.agg(F.count_distinct(id_col).alias("documents"))))
