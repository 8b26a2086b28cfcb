"""Fusion, dense and lexical search, and ranking metrics on hand cases."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from groundwell.operators import dense as dn
from groundwell.operators import fusion as fu
from groundwell.operators import ir_metrics as ir
from groundwell.operators import lexical as lx

RANK = "query_id string, list_idx int, rank int, doc_id string"


def lists(spark, *rankings):
    return spark.createDataFrame([("q", i, r + 1, d) for i, docs in enumerate(rankings) for r, d in enumerate(docs)], RANK)


def test_rrf_top_and_cut(spark):
    top = fu.rrf(lists(spark, "ABC", "BAD")).orderBy("rank").collect()
    assert {top[0]["doc_id"], top[1]["doc_id"]} == {"A", "B"} and top[0]["doc_id"] == "A"
    assert fu.rrf(lists(spark, [f"d{i}" for i in range(100)]), top_k=10).count() == 10


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_rrf_is_independent_of_partitions(spark, partitions):
    r = lists(spark, ["TIE", "x", "y"], ["TIE", "y", "x"], ["z", "TIE"]).repartition(partitions)
    assert [x["doc_id"] for x in fu.rrf(r).orderBy("rank").collect()] == ["TIE", "x", "y", "z"]


def test_dense_order_and_batched_twin(spark):
    docs = spark.createDataFrame([("far", [0.0, 1.0]), ("near", [1.0, 0.0]), ("mid", [0.7071, 0.7071]), ("none", None)], "doc_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = dn.dense_top_k(docs, q, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["near", "mid", "far"] and got[0]["score"] == pytest.approx(1.0)
    plain = lx.top_k(dn.dense_scores(docs, q), 3).orderBy("rank").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in got]
    assert dn.dense_top_k(docs.limit(0), q, 3).count() == 0


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {d: t.lower().split() for d, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for w in toks.values() for t in set(w))
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else eps * mean for t, v in idf.items()}
    out = {}
    for d, w in toks.items():
        tf = Counter(w)
        s = sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / avg)) for t in query.lower().split() if tf[t])
        if any(tf[t] for t in query.lower().split()):
            out[d] = round(s, 6)
    return out


def test_bm25_matches_plain_python(spark):
    docs = {1: "a b c a", 2: "b b d", 3: "e f", 4: "a e e e g h", 5: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    q = spark.createDataFrame([("q1", "a e a"), ("q2", "zzz")], "query_id string, text string")
    got = {r["doc_id"]: r["score"] for r in lx.bm25_top_k(df, q, 10).collect()}
    assert got == pytest.approx(okapi({k: v for k, v in docs.items()}, "a e a"), abs=1e-6)


def test_bm25_pool_pads_with_zero_scores(spark):
    df = spark.createDataFrame([(i, "x" if i == 7 else "y") for i in range(1, 9)], "doc_id int, text string")
    q = spark.createDataFrame([("q", "x")], "query_id string, text string")
    assert [r["doc_id"] for r in lx.bm25_pool_with_zero_scores(df, lx.build_index(df), q, 4).orderBy("rank").collect()] == [7, 1, 2, 3]


def test_websearch_match(spark):
    df = spark.createDataFrame([(1, "lung cancer with carboplatin"), (2, "cancer of the lung"), (3, "breast tumours")], "doc_id int, text string")
    v = df.select("doc_id", lx.fts_vector(df["text"]).alias("v"))
    ids = lambda q: sorted(r["doc_id"] for r in lx.fts_search(v, spark.createDataFrame([("q", q)], "query_id string, text string")).collect())
    assert ids("lung cancers") == [1, 2]
    assert ids('"lung cancer"') == [1]
    assert ids("lung -carboplatin or tumour") == [2, 3]


def test_rerank_prefers_cached_on_ties(spark):
    c = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("ABCD")], "query_id string, doc_id string, rank int")
    s = lambda rows: spark.createDataFrame([("q", d, x) for d, x in rows], "query_id string, doc_id string, score double")
    got = fu.rerank(c, s([("C", 0.9)]), s([("A", 0.3), ("B", 0.9), ("D", 0.1)]), 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["C", "B", "A"]


def test_metrics_hand_cases(spark):
    p = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate("ABCDEXY")], "query_id string, rank int, doc_id string")
    l = spark.createDataFrame([("q", d, "eligible") for d in "ACE"] + [("r", "Z", "excluded")], "query_id string, doc_id string, label string")
    got = {r["k"]: r["recall"] for r in ir.recall_at(p, l, [1, 2, 3, 5, 7]).collect()}
    assert got == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 2 / 3, 5: 1.0, 7: 1.0})
    assert [tuple(r) for r in ir.reciprocal_rank(p, l).collect()] == [("q", 1.0)]
    assert {r["query_id"]: r["ndcg"] for r in ir.ndcg_at(p, l, 2).collect()}["q"] < 1.0
    cov = ir.gold_coverage(l, spark.createDataFrame([("A",), ("C",)], "doc_id string")).first()
    assert (cov["total"], cov["present"], cov["missing_first"]) == (3, 2, ["E"])


def test_ivf_with_all_lists_is_exact(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, embedding array<float>")
    q = spark.createDataFrame(rows[:3], "query_id int, embedding array<float>")
    c = dn.ivf_centroids(docs, 4)
    exact = sorted(map(tuple, dn.dense_top_k(docs, q, 5).collect()))
    assert sorted(map(tuple, dn.ivf_top_k(dn.ivf_index(docs, c), q, c, 4, 5).collect())) == exact


@pytest.mark.parametrize("probes", [1, 2, 5])
def test_ivf_brute_force(spark, tmp_path, probes):
    import numpy as np

    rng = np.random.default_rng(probes)
    x, asked = rng.normal(size=(120, 6)), rng.normal(size=(9, 6))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "doc_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    c = dn.ivf_centroids(docs, 5)
    assert len(c) == 5 and dn.ivf_centroids(docs.limit(0), 5) == []
    dn.ivf_index(docs, c).write.partitionBy("list").parquet(str(tmp_path / "ivf"))
    index = spark.read.parquet(str(tmp_path / "ivf")).select("doc_id", "embedding", "list")
    assert index.count() == 120
    m = np.asarray(c)
    own = (x @ m.T).argmax(axis=1)
    want = []
    for i, v in enumerate(asked):
        lists = np.argsort(-(m @ v), kind="stable")[:probes]
        some = sorted((-round(float(v @ x[d]), 6), d) for d in range(120) if own[d] in lists)[:7]
        want += [(i, d, -s, r + 1) for r, (s, d) in enumerate(some)]
    got = sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in dn.ivf_top_k(index, q, c, probes, 7, block_queries=4).collect())
    assert [(a, b, r) for a, b, _, r in got] == sorted((a, b, r) for a, b, _, r in want)
    one = dn.ivf_top_k(index, q.limit(1), c, 1, 7)
    assert "PartitionFilters: [" in (plan := one._jdf.queryExecution().toString()) and "list#" in plan.split("PartitionFilters: [")[1][:60]


def test_a_source_is_pruned(spark, tmp_path):
    from groundwell.operators.search_index import IndexStore

    v = spark.createDataFrame([(i, [float(i), 1.0], "ab"[i % 2]) for i in range(20)], "doc_id long, embedding array<double>, source string")
    kept = IndexStore(spark, str(tmp_path / "store")).vectors(v, "all", "t", by=("source",))
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    got = dn.dense_top_k(kept.where("source = 'a'"), q, 50)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 20, 2))
    assert "PartitionFilters: [isnotnull(source" in got._jdf.queryExecution().toString()
