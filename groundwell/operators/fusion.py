"""Reciprocal-rank fusion and reranking over long-form rankings (query_id, list_idx, rank, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(rankings: DataFrame, k: int = RRF_K, top_k: int = 20, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, score, rank): the sum of 1 / (k + rank) over lists.

    Ties go to the document seen first over lists in order. Terms are added in
    list order, whatever order the shuffle brings, and rounded before ranking.
    """
    term = F.struct("list_idx", "rank", (F.lit(1.0) / (F.col("rank") + k)).alias("t"))
    fused = rankings.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(term)).alias("terms"))
    fused = fused.select(
        "query_id", "doc_id", F.round(F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["t"]), digits).alias("score"), F.col("terms")[0]["list_idx"].alias("i"), F.col("terms")[0]["rank"].alias("r")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "i", "r", "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "doc_id", "score", "rank")


def hydrate(hits: DataFrame, rows: DataFrame, id_col: str = "doc_id", digits: int = 4) -> DataFrame:
    """Hits with their rows, in hit order; hits whose row is missing go."""
    return hits.join(rows, id_col).withColumn("score", F.round("score", digits))


def rerank(candidates: DataFrame, cached: DataFrame, fresh: DataFrame, top_k: int) -> DataFrame:
    """Candidates (query_id, doc_id, rank) ordered by score: the cache's where it has one, else the model's.

    On equal scores cached candidates precede fresh ones, each in candidate order.
    """
    hit = candidates.join(cached.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]).withColumn("fresh", F.lit(0))
    missing = candidates.join(cached, ["query_id", "doc_id"], "left_anti").join(fresh.select("query_id", "doc_id", "score"), ["query_id", "doc_id"]).withColumn("fresh", F.lit(1))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fresh", F.asc("rank"))
    out = hit.unionByName(missing).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_k)
    return out.select("query_id", "doc_id", "score", F.col("new_rank").alias("rank"))
