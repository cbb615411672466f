import numpy as np
import pandas as pd

from quarry.llm import quality_rules as m


def table(n=600, seed=0):
    rng = np.random.default_rng(seed)
    stats = pd.DataFrame({c: rng.random(n) for c in m.STATS})
    reject = ((stats["symbol_ratio"] > 0.7) & (stats["n_words"] > 0.3)) | (stats["distinct_ratio"] <= 0.1)
    return stats, reject.to_numpy()


def test_learns_the_planted_rules_on_held_out_rows():
    rules = m.learn_decision_list(*table())
    stats, reject = table(2000, 1)
    got = np.zeros(len(stats), bool)
    for r in rules:
        got |= r.covers(stats)
    assert (got == reject).mean() > 0.97 and all(r.precision >= 0.97 for r in rules)


def test_no_rules_from_noise_or_one_label():
    stats, _ = table()
    assert m.learn_decision_list(stats, np.zeros(len(stats), bool)) == []
    noise = np.random.default_rng(3).random(len(stats)) < 0.1
    assert m.learn_decision_list(stats, noise) == []


def test_spark_statistics(docs):
    text = "The the fox.\nThe the fox.\nAB CD 42 $$"
    row = m.with_stats(docs([(1, text, "a")]), "text", "s_").first()
    assert row["s_n_words"] == 10 and row["s_n_chars"] == len(text) and abs(row["s_distinct_ratio"] - 7 / 10) < 1e-9
    assert abs(row["s_line_repeat"] - 1 / 3) < 1e-9 and abs(row["s_symbol_ratio"] - 0.2) < 1e-9 and abs(row["s_upper_ratio"] - 0.2) < 1e-9
    again = m.with_stats(docs([(1, "a a a a b", "a")]), "text", "s_").first()
    assert abs(again["s_repeat_ratio"] - 2 / 5) < 1e-9


def test_expression_equals_the_rules(edges):
    rules = [m.Rule((("n_words", "<=", 3.0),), 1, 1.0), m.Rule((("distinct_ratio", "<=", 0.1), ("n_chars", ">", 10.0)), 1, 1.0)]
    stats = m.with_stats(edges, "text", "s_").select("s_n_words", "s_distinct_ratio", "s_n_chars", m.decision(rules, "s_").alias("rule")).collect()
    for r in stats:
        want = 1 if r["s_n_words"] <= 3 else 2 if r["s_distinct_ratio"] <= 0.1 and r["s_n_chars"] > 10 else 0
        assert r["rule"] == want
    out = m.apply_rules(edges, rules)
    assert out.columns == edges.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["1", "2", "2", "None", "9"])
    assert m.kept_documents(edges, rules).count() == out.count()


def test_fit_on_tables(spark, docs):
    good = "the fox and the dog walked to a river in the old town of stones while it was raining {}"
    rows = [(i, good.format(i), "a") for i in range(200)] + [(200 + i, "zz$$$ qq%%% ww&&& " * 8 + str(i), "a") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(260)] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    rules = m.fit_rules(docs(rows), labels)
    kept = {r["doc_id"] for r in m.apply_rules(docs(rows), rules).collect()}
    assert kept == set(range(200))


def test_empty(spark, empty, edges):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert m.fit_rules(empty, labels) == [] and m.fit_rules(edges, labels) == []
    assert m.apply_rules(empty, [m.Rule((("n_words", ">", 1.0),), 1, 1.0)]).count() == 0
    assert m.apply_rules(edges, []).count() == edges.count()
