"""Quality rules: a decision list learned by sequential covering over statistics of texts.

Each round grows a conjunction of thresholds on one part of the labelled rows by the gain in information, prunes it on the
other part, and keeps it if it is precise enough there; what it covers is set aside. The list is emitted as one Spark
conditional expression, rule after rule, over statistics that built-in functions compute in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import col, cols, fresh

#: Labelled rows the list is fitted on at most, picked by a seeded hash of their id.
MAX_TRAIN_ROWS = 20_000
STATS = ("n_chars", "n_words", "word_chars", "symbol_ratio", "upper_ratio", "digit_ratio", "distinct_ratio", "stop_ratio", "line_repeat", "repeat_ratio")


def text_stats(text: Column) -> list[tuple[str, Column]]:
    """The statistics in the order of STATS, in two steps: counts of the text, then ratios. A null text counts as an empty one."""
    t = F.coalesce(text, F.lit(""))
    return [
        ("n_chars", F.length(t)),
        ("_words", F.filter(F.split(t, r"\s+"), lambda w: w != "")),
        ("_lines", F.filter(F.split(t, "\n"), lambda w: w != "")),
        ("_symbols", F.regexp_count(t, F.lit(r"[#$%&*|<>{}=~^\\@_!]"))),
        ("_uppers", F.regexp_count(t, F.lit(r"\p{Lu}{2,}"))),
        ("_repeats", F.regexp_count(t, F.lit(r"(?<!\S)(\S+)\s+\1(?!\S)"))),
        ("_digits", F.regexp_count(t, F.lit(r"[0-9]"))),
    ]


STOP = ("the", "of", "and", "to", "in", "a", "is", "that", "der", "die", "und", "den", "von", "zu", "le", "la", "les", "de", "et", "des", "el", "los", "y", "en", "que", "un", "une", "ein", "eine", "du", "del", "las")


def with_stats(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """docs with the columns prefix + each of STATS."""
    out = docs
    for name, column in text_stats(col(text)):
        out = out.withColumn(prefix + name, column)
    c = lambda n: F.col(prefix + n)
    words, chars = F.greatest(F.size(c("_words")), F.lit(1)), F.greatest(c("n_chars"), F.lit(1))
    out = out.withColumns(
        {
            prefix + "n_words": F.size(c("_words")),
            prefix + "word_chars": chars / words,
            prefix + "symbol_ratio": c("_symbols") / words,
            prefix + "upper_ratio": c("_uppers") / words,
            prefix + "repeat_ratio": c("_repeats") / words,
            prefix + "digit_ratio": c("_digits") / chars,
            prefix + "distinct_ratio": F.size(F.array_distinct(c("_words"))) / words,
            prefix + "stop_ratio": F.size(F.filter(c("_words"), lambda w: w.isin(*STOP))) / words,
            prefix + "line_repeat": 1 - F.size(F.array_distinct(c("_lines"))) / F.greatest(F.size(c("_lines")), F.lit(1)),
        }
    )
    return out.drop(*[prefix + n for n in ("_words", "_lines", "_symbols", "_uppers", "_repeats", "_digits")])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, ">" or "<=", threshold) that rejects; support and precision as pruned."""

    conditions: tuple[tuple[str, str, float], ...]
    support: int
    precision: float

    def covers(self, stats: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(stats), bool)
        for name, op, at in self.conditions:
            v = stats[name].to_numpy(float)
            out &= v > at if op == ">" else v <= at
        return out

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            v = F.col(prefix + name).cast("double")
            out = out & (v > at if op == ">" else v <= at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {at:.6g}" for n, op, at in self.conditions)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    """Conditions added one by one, each with the largest gain in information about y over the rows still covered."""
    keep, rule = np.ones(len(y), bool), []
    while len(rule) < most and y[keep].any() and not y[keep].all():
        p0, n0 = y[keep].sum(), (~y[keep]).sum()
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, v in x.items():
            own = v[keep]
            order = np.argsort(own, kind="stable")
            s, yy = own[order], y[keep][order]
            cut = np.flatnonzero(np.diff(s) > 0)
            if not len(cut):
                continue
            cp, ca = np.cumsum(yy)[cut], cut + 1
            for op, p, a in (("<=", cp, ca), (">", p0 - cp, len(s) - ca)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-12) / a) - base), -1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = gain[i], (name, op, float((s[cut[i]] + s[cut[i] + 1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        name, op, at = best[1]
        keep &= x[name] > at if op == ">" else x[name] <= at
    return rule


def _prune(rule: list, x: pd.DataFrame, y: np.ndarray) -> Rule | None:
    """The beginning of the rule with the largest (p - n) / (p + n) on rows it wasn't grown on; the shortest of equals."""
    best = None
    for n in range(1, len(rule) + 1):
        own = Rule(tuple(rule[:n]), 0, 0.0)
        on = own.covers(x)
        if (a := int(on.sum())) and (best is None or y[on].mean() > best.precision + 1e-12):
            best = Rule(own.conditions, a, float(y[on].mean()))
    return best


def learn_decision_list(stats: pd.DataFrame, reject: np.ndarray, min_precision: float = 0.97, min_support: int = 3, max_rules: int = 12, max_conditions: int = 4, attempts: int = 4, seed: int = 7) -> list[Rule]:
    """Ordered rules that reject; rows that none covers are kept. No rules if nothing is precise enough, or without rows of both labels.

    The rows are split anew for each rule; the list ends when attempts splits in a row give no rule that is precise enough.
    """
    reject = np.asarray(reject, bool)
    rng = np.random.default_rng(seed)
    left, rules, failed = np.arange(len(stats)), [], 0
    while len(rules) < max_rules and failed < attempts and reject[left].any():
        own = rng.permutation(left)
        third = len(own) // 3
        grow, prune = own[third:], own[:third]
        conditions = _grow({n: stats[n].to_numpy(float)[grow] for n in STATS}, reject[grow], max_conditions)
        rule = _prune(conditions, stats.iloc[prune], reject[prune]) if conditions else None
        if rule is None or rule.support < min_support or rule.precision < min_precision:
            failed += 1
            continue
        failed = 0
        rules.append(rule)
        left = left[~rule.covers(stats.iloc[left])]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS, seed: int = 7, **how) -> list[Rule]:
    """Learn from labels (id, label: 0 rejects). Of more than max_train_rows labelled ids, those with the lowest seeded hash are used.

    Null ids and null labels teach nothing; ids with both labels count once each way, and of rows that repeat an id the least text
    teaches. Texts are read whole. Without usable labels, or from an empty table, there are no rules. Extra columns are not read.
    """
    picked = labels.where(col(id_col).isNotNull() & col(label).isNotNull()).select(col(id_col).alias("id"), (col(label) == 0).alias("reject")).distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id", "reject").limit(max_train_rows)
    rows = docs.select(col(id_col).alias("id"), col(text).alias("text")).join(F.broadcast(picked), "id")  # at most max_train_rows ids
    rows = rows.groupBy("id", "reject").agg(F.min("text").alias("text"))
    table = with_stats(rows, "text", "").select("id", "reject", *STATS).toPandas().sort_values(["id", "reject", "n_chars"], kind="stable").reset_index(drop=True)
    return learn_decision_list(table[list(STATS)], table["reject"].to_numpy(bool), seed=seed, **how) if len(table) else []


def decision(rules: list[Rule], prefix: str = "") -> Column:
    """The number, from 1, of the first rule that covers a row; 0, the default, keeps it."""
    out = F.lit(0)
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(prefix), F.lit(i)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs that no rule rejects, with all their columns and no others. A null text counts as an empty one and stands before the rules as any other.

    Texts of any length are read whole, repeated rows are each kept or rejected, an empty table stays empty, columns may have any names.
    """
    if not rules:
        return docs
    prefix = fresh(docs, "stat_")
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix = "_" + prefix
    return with_stats(docs, text, prefix).where(decision(rules, prefix) == 0).select(*cols(docs))


def kept_documents(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, and the statistics) of each row that is kept; repeated rows and null ids are kept or rejected like others.

    A null text counts as an empty one, texts of any length are read whole, an empty table gives an empty result. Extra columns are not read.
    """
    stats = with_stats(docs.select(col(id_col).alias("doc_id"), col(text).alias("text")), "text", "")
    # a filter isn't pushed below a column that is not deterministic: the statistics are computed once, not for the filter and the result
    once = stats.withColumn("_row", F.monotonically_increasing_id())
    return once.where((decision(rules) == 0) & (F.col("_row") >= 0)).select("doc_id", *[F.col(c).cast("double").alias(c) for c in STATS])
