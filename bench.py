"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

``python bench.py vectors`` instead compares the ways to search vectors: exact
against inverted lists (as many as the root of the vectors) at several probes,
100 self-queries in one job, with recall of the top 50.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from groundwell.operators import dense, ir_metrics
from groundwell.operators.lineage import cut
from groundwell.plans import catalog, common

HEADLINE = (
    "hybrid_search dense_topk dense_topk_batched bm25_topk multi_keyword_hybrid rrf_fusion recall_at_k_sweep ndcg_at_10 "
    "normalize_hash ground_assessments arm_metrics_by_kind coverage_curve bounded_retry stress_test "
    "ledger_by_model budget_breaker upsert_latest_wins refresh_apply rate_limiter revenue_by_nation"
).split()


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("groundwell-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    every, took = catalog.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        began = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


def vectors() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    v = cut(common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"))
    n = v.count()
    asked = cut(v.orderBy(F.xxhash64("doc_id", F.lit(0))).limit(100).select(F.col("doc_id").alias("query_id"), "embedding"))
    exact, arms = None, []
    for name in ("warm", "exact", "build", 1, 5, 10, 25, int(n**0.5)):
        began, recall = time.perf_counter(), 1.0
        if name == "build":
            centroids = dense.ivf_centroids(v, int(n**0.5))
            index = cut(dense.ivf_index(v, centroids))
        elif isinstance(name, str):
            exact = cut(dense.dense_top_k(v, asked, 50))
        else:
            found = cut(dense.ivf_top_k(index, asked, centroids, name, 50))
        took = time.perf_counter() - began
        if isinstance(name, int):
            recall = ir_metrics.overlap_at_k(found, exact, 50).agg(F.avg("recall")).first()[0]
        arms.append({"arm": name if isinstance(name, str) else f"ivf probes={name}", "sec": round(took, 3), "recall": round(recall, 4)})
    print(json.dumps({"metric": "vector_arms", "vectors": n, "queries": 100, "arms": arms[1:]}))
    spark.stop()


if __name__ == "__main__":
    vectors() if sys.argv[1:] == ["vectors"] else main()
