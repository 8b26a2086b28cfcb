from __future__ import annotations

import numpy as np

from groundwell.operators import dense, lexical


def test_batched_queries_beyond_one_block(spark):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(12, 3)))], "doc_id long, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(10_050, 3)))], "query_id long, embedding array<double>")
    got = dense.dense_top_k(docs, asked, 2)
    assert got.select("query_id").distinct().count() == 10_050 and got.count() == 2 * 10_050
    few = asked.where("query_id < 25")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "rank").collect())
    assert rows(dense.dense_top_k(docs, few, 3, block_queries=10)) == rows(dense.dense_top_k(docs, few, 3)) == rows(lexical.top_k(dense.dense_scores(docs, few), 3))
    assert dense.dense_top_k(docs, few.limit(0), 3).count() == 0
