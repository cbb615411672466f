import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quarry.llm import exact_dedup, mixing, quality_rules, sentencepiece_viterbi, simhash_bktree

SF = "/root/testdata/sf0.001"


def test_stages_are_five_and_each_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "SimHash near-dedup", "source mixing", "SentencePiece encoding"]
    for n, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, n


def test_run_against_each_operator_in_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stats = quality_rules.with_stats(docs, "text", "").toPandas()
    rejected = set()
    for r in rules:
        rejected |= set(stats["doc_id"][r.covers(stats)])
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] not in rejected)
    seen, once = set(), []
    for r in rows:
        if r[1] not in seen:
            seen.add(r[1])
            once.append(r)
    sig, has = simhash_bktree.signatures([t for _, t, _ in once])
    u = sig.view("uint64")
    root = list(range(len(once)))
    for _ in range(6):
        for i in range(len(once)):
            for j in range(i):
                if has[i] and has[j] and simhash_bktree.hamming(u[i], u[j]) <= simhash_bktree.RADIUS:
                    root[i] = root[j] = min(root[i], root[j])
    kept = [r for i, r in enumerate(once) if root[i] == i]
    counts = {}
    for _, t, s in kept:
        own = counts.setdefault(s, {})
        own[len(t.split())] = own.get(len(t.split()), 0) + 1
    tokens = {s: sum(k * n for k, n in c.items()) for s, c in counts.items()}
    wanted = mixing.budgets(tokens, mixing.tempered_weights(tokens))
    out = corpus_pipeline.run(spark, SF).collect()
    e, text, source = sentencepiece_viterbi.encoder(sentencepiece_viterbi.MODEL), {d: t for d, t, _ in kept}, {d: s for d, _, s in kept}
    got = {}
    for r in out:
        assert r["ids"] == e.encode(text[r["doc_id"]])
        got[source[r["doc_id"]]] = got.get(source[r["doc_id"]], 0) + len(text[r["doc_id"]].split())
    for s, c in counts.items():
        assert got.get(s, 0) == sum(k * n for k, n in mixing.fit_budget(c, wanted[s]).items()) <= wanted[s]


def test_clean_documents_pass_the_quality_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    good = labels.where("quality = 1").select("doc_id")
    bad = labels.where("quality = 0").select("doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.01 * good.count()
    assert bad.join(kept, "doc_id", "left_anti").count() >= 0.8 * bad.count()


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, ([r[c] for c in names] for r in df.collect()))) == sorted(map(str, map(list, cur.fetchall())))


def test_all_ten_are_registered():
    found = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    assert found >= {f"op{i}" for i in range(1, 11)} and "pipeline" in __spark_entry__.queries()


def test_near_and_exact_stages_remove_all_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, docs, SF), SF)
    assert out.count() == out.select("text").distinct().count()
    assert simhash_bktree.near_duplicates(out).count() == 0 and exact_dedup.exact_duplicates(out).count() == 0
    assert out.where(F.col("doc_id").isNull()).count() == 0


def test_near_stage_leaves_out_no_link_of_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    sig, has = simhash_bktree.signatures([t for _, t in rows])
    u, unions = sig.view("uint64"), simhash_bktree.Unions(len(rows))
    for i in range(0, len(rows), 500):
        near = simhash_bktree.hamming(u[i : i + 500, None], u[None]) <= simhash_bktree.RADIUS
        a, b = np.nonzero(near & has[i : i + 500, None] & has)
        unions.join(a + i, b)
    top = unions.tops(np.arange(len(rows)))
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, docs, sf).select("doc_id").collect()}
    assert kept == {d for i, (d, _) in enumerate(rows) if top[i] == i}


def test_near_stage_leaves_out_no_row_whatever_its_id(spark, docs):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(100)) for w in ("alpha", "beta", "gamma", "delta"))
    rows = [
        (1, a), (None, a + " more"), (None, b), (None, b + " more"),  # null ids: near to a row with an id, and to each other
        (5, c), (5, c + " more"), (5, d), (9, d + " more"),  # an id with two near texts and a far one
        (None, None), (None, "lone text of a null id"), (7, None), (8, ""),
    ]
    out = corpus_pipeline.near(spark, docs([(i, t, "a") for i, t in rows]), SF)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    one = lambda i, texts: [k for k in kept if k[0] == i and k[1] in texts]
    assert (1, a) in kept and len(one(None, (b, b + " more"))) == 1 and len(one(5, (c, c + " more"))) == 1 and (5, d) in kept
    assert set(rows[8:]) <= set(kept) and len(kept) == 8
