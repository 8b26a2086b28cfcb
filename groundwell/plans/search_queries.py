"""Dense, lexical and hybrid search, fusion, reranking and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.text import tokenize
from groundwell.operators import dense as dn
from groundwell.operators import fusion as fu
from groundwell.operators import ir_metrics as ir
from groundwell.operators import lexical as lx
from groundwell.operators import retrieve as rt
from groundwell.operators.lexical import LexicalIndex
from groundwell.operators.lineage import cut
from groundwell.plans.common import Registry, index_store, table, toks_sql

reg = Registry()
DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"

# Searches ask every vector whose id divides by 20, and every benchmark item, of the whole corpus.
_DENSE = f"""
dq AS (SELECT vec_id AS query_id, embedding AS qv, label AS qlabel FROM embeddings WHERE vec_id % 20 = 0
), ds AS (SELECT query_id, vec_id AS doc_id, round({DOT.format(a="qv", b="embedding")}, 6) AS score, label, qlabel FROM dq, embeddings
), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ds)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@reg.add(f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM dr WHERE rank <= 50")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dn.dense_top_k(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 50)


@reg.add(f"WITH {_DENSE} SELECT query_id, doc_id, score, rank FROM dr WHERE rank <= 50")
def dense_topk_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by several blocks of queries, each a matrix of its own."""
    return dn.dense_top_k(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 50, block_queries=64)


@reg.add(
    f"""WITH {_DENSE}, s AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM ds WHERE label = 3) SELECT * FROM s WHERE rank <= 10"""
)
def dense_topk_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search within one source: the vectors are kept in a folder a source, and only that one is read."""
    store, tag = index_store(spark, sf_dir, "embeddings")
    return dn.dense_top_k(store.vectors(_vectors(spark, sf_dir), "embeddings", tag, by=("label",), normalised=True).where("label = 3"), _vector_queries(spark, sf_dir), 10)


_NEAR = "(SELECT list(c.l ORDER BY list_dot_product(c.v, {v}::DOUBLE[]) DESC, c.l) FROM ct c)"


@reg.add(
    f"""WITH {_DENSE}, ct AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS l, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 16
    ), own AS (SELECT vec_id AS doc_id, {_NEAR.format(v="embedding")}[1] AS l FROM embeddings
    ), pq AS (SELECT query_id, {_NEAR.format(v="qv")} AS ls FROM dq
    ), s AS (SELECT p, ds.query_id, ds.doc_id, row_number() OVER (PARTITION BY p, ds.query_id ORDER BY score DESC, ds.doc_id) AS r
      FROM ds JOIN own USING (doc_id) JOIN pq USING (query_id), (VALUES (1), (4), (8), (16)) AS v(p) WHERE list_contains(pq.ls[1:p], own.l)
    ), h AS (SELECT p, query_id, count(*) AS n FROM s JOIN dr USING (query_id, doc_id) WHERE s.r <= 50 AND dr.rank <= 50 GROUP BY ALL)
    SELECT p::INTEGER AS probes, round(sum(n) / 50.0 / (SELECT count(*) FROM dq), 6)::DOUBLE AS recall FROM h GROUP BY p"""
)
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of inverted lists around the first sixteen vectors against the exact top 50, by lists probed; all lists give 1."""
    docs, q = _vectors(spark, sf_dir), _vector_queries(spark, sf_dir)
    centroids = [r[0] for r in docs.where("doc_id < 16").orderBy("doc_id").select("embedding").collect()]
    exact = cut(dn.dense_top_k(docs, q, 50))
    store, tag = index_store(spark, sf_dir, "embeddings")
    index = store.lists(docs, "embeddings", tag, centroids)
    out = [ir.overlap_at_k(dn.ivf_top_k(index, q, centroids, p, 50), exact, 50).agg(F.round(F.avg("recall"), 6).alias("recall")).withColumn("probes", F.lit(p)) for p in (1, 4, 8, 16)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@reg.add(
    f"""WITH {_DENSE}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, doc_id) AS r FROM ds)
    SELECT query_id, round(count(*) FILTER (doc_id IN (SELECT x.doc_id FROM dr x WHERE x.query_id = a.query_id AND x.rank <= 10)) / 10.0, 6) AS recall FROM a WHERE r <= 10 GROUP BY query_id"""
)
def recall_vs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 by scores coarsened to one decimal, against the exact top 10."""
    docs, q = _vectors(spark, sf_dir), _vector_queries(spark, sf_dir)
    s = dn.dense_scores(docs, q).withColumn("score", F.round(F.round("score", 6), 1))
    coarse = rt.rank_within(s, ["query_id"], F.desc("score"), F.asc("doc_id"))
    return ir.overlap_at_k(coarse, dn.dense_top_k(docs, q, 10), 10).select("query_id", F.round("recall", 6).alias("recall"))


_BM25 = f"""
tk AS (SELECT doc_id, {toks_sql("text")} AS w FROM documents
), dl AS (SELECT doc_id, len(w) AS dl FROM tk
), po AS (SELECT doc_id, t.term AS term, count(*) AS tf FROM tk, unnest(w) AS t(term) GROUP BY ALL
), nn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl
), fr AS (SELECT term, count(*) AS df FROM po GROUP BY term
), ri AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM fr, nn
), av AS (SELECT avg(idf) AS avg_idf, count(*) AS n_terms FROM ri
), id AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * avg_idf ELSE idf END AS idf FROM ri, av
), qt AS (SELECT item_id AS query_id, t.term AS term, count(*) AS qtf FROM benchmark, unnest({toks_sql("text")}) AS t(term) GROUP BY ALL
), bs AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN po USING (term) JOIN id USING (term) JOIN dl USING (doc_id), nn GROUP BY query_id, doc_id
), br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM bs)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _index(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The documents' kept postings; the first search over a table makes them."""
    store, tag = index_store(spark, sf_dir, "documents")
    return store.lexical(_docs(spark, sf_dir), "documents", tag)


def _fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, tag = index_store(spark, sf_dir, "documents")
    return store.fts(_docs(spark, sf_dir), "documents", tag, carry=("source",))


@reg.add(f"WITH {_BM25} SELECT n::BIGINT AS n_docs, n_terms::BIGINT AS n_terms, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM nn, av")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats.select("n_docs", "n_terms", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


@reg.add(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM br WHERE rank <= 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.bm25_search(_index(spark, sf_dir), _items(spark, sf_dir), 50)


#: Rare-word queries: the longest word of each item, so that some pools need padding.
_RARE = f"(SELECT item_id, list_reduce({toks_sql('text')}, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) AS text FROM benchmark WHERE len({toks_sql('text')}) > 0)"


@reg.add(
    f"""WITH {_BM25.replace("FROM benchmark, unnest", f"FROM {_RARE}, unnest")}, z AS (
    SELECT q.query_id, d.doc_id, coalesce(bs.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM qt) q CROSS JOIN dl d LEFT JOIN bs ON bs.query_id = q.query_id AND bs.doc_id = d.doc_id
    ), zr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM z) SELECT query_id, doc_id, score, rank FROM zr WHERE rank <= 50"""
)
def bm25_pool_with_zero_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tokenize(F.col("text"))
    rare = _items(spark, sf_dir).where(F.size(w) > 0).select("query_id", F.reduce(w, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)).alias("text"))
    return lx.bm25_pool_with_zero_scores(_docs(spark, sf_dir), _index(spark, sf_dir), rare, 50)


@reg.add(
    f"""WITH q AS (SELECT item_id AS query_id, list_distinct({toks_sql("text")}) AS w FROM benchmark), p AS (SELECT doc_id, list_distinct({toks_sql("text")}) AS w FROM documents)
    SELECT query_id, doc_id FROM q, p WHERE len(q.w) > 0 AND list_has_all(p.w, q.w)"""
)
def boolean_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.boolean_and_match(_docs(spark, sf_dir), _items(spark, sf_dir))


@reg.add()
def cover_density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search with stemming, a phrase, an alternative and a negation, by cover density."""
    asked = spark.createDataFrame([(0, 'the and or "with the" or die -trash'), (1, "der die"), (2, '"de la" or schen'), (3, "-die -la"), (4, "que -la or und -der")], "query_id long, text string")
    return lx.fts_search(_fts(spark, sf_dir), asked, 50)


@reg.add()
def fts_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a full-text query: the documents that hold all its words, by cover density."""
    return lx.fts_search(_fts(spark, sf_dir), _items(spark, sf_dir), 50)


_HYBRID = f"""
{_BM25}, hq AS (SELECT item_id AS query_id, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id
), hs AS (SELECT query_id, vec_id AS doc_id, round({DOT.format(a="qv", b="embedding")}, 6) AS score FROM hq, embeddings
), hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs
), ls AS (SELECT query_id, 0 AS li, rank, doc_id FROM hr WHERE rank <= 50 UNION ALL SELECT query_id, 1, rank, doc_id FROM br WHERE rank <= 50
), fs AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(li * 1000 + rank) AS first FROM ls GROUP BY ALL
), fr2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id)::INTEGER AS rank FROM fs)
"""


def _hybrid_inputs(spark: SparkSession, sf_dir: str) -> tuple[LexicalIndex, DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    q = _items(spark, sf_dir).join(v.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id", "left")
    return _index(spark, sf_dir), v, q


@reg.add(f"WITH {_HYBRID} SELECT query_id, doc_id, score, rank FROM fr2 WHERE rank <= 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.hybrid_search(*_hybrid_inputs(spark, sf_dir), 10)


@reg.add(f"WITH {_HYBRID} SELECT query_id, doc_id, round(score, 4) AS score, rank, source, md5(text) AS text_md5 FROM fr2 JOIN documents USING (doc_id) WHERE rank <= 10")
def hydrate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fu.hydrate(rt.hybrid_search(*_hybrid_inputs(spark, sf_dir), 10), _docs(spark, sf_dir))
    return hits.select("query_id", "doc_id", "score", "rank", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@reg.add(
    f"""WITH {_DENSE}, l AS (SELECT query_id, 0 AS li, rank, doc_id FROM dr WHERE rank <= 30
    UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY doc_id), doc_id FROM dr WHERE rank <= 30
    UNION ALL SELECT query_id, 2, 31 - rank, doc_id FROM dr WHERE rank <= 30
    ), f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(li * 1000 + rank) AS first FROM l GROUP BY ALL
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id)::INTEGER AS rank FROM f) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 20"""
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dn.dense_top_k(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 30)
    by_id = rt.rank_within(d.drop("rank"), ["query_id"], F.asc("doc_id"))
    lists = [x.select("query_id", F.lit(i).alias("list_idx"), "rank", "doc_id") for i, x in enumerate((d, by_id, d.withColumn("rank", 31 - F.col("rank"))))]
    return fu.rrf(lists[0].unionByName(lists[1]).unionByName(lists[2]), top_k=20)


#: A note's keywords: its words in consecutive runs of eight.
_KW = f"""kq AS (SELECT item_id, (kw - 1) AS kw, item_id * 1000 + kw - 1 AS key, array_to_string(w[8 * kw - 7:8 * kw], ' ') AS text FROM (SELECT item_id, {toks_sql("text")} AS w FROM benchmark), unnest(generate_series(1, ceil(len(w) / 8.0)::BIGINT)) AS t(kw))"""


@reg.add(
    f"""WITH {_KW}, {_BM25.replace("SELECT item_id AS query_id, t.term AS term, count(*) AS qtf FROM benchmark, unnest", "SELECT key AS query_id, t.term AS term, count(*) AS qtf FROM kq, unnest")}
    , dd AS (SELECT key, vec_id AS doc_id, row_number() OVER (PARTITION BY key ORDER BY round({DOT.format(a="qv", b="embedding")}, 6) DESC, vec_id) AS rank
      FROM (SELECT key, e.embedding AS qv FROM kq JOIN embeddings e ON e.vec_id = (kq.item_id + 7 * kq.kw) % (SELECT max(vec_id) + 1 FROM embeddings)), embeddings)
    , ls AS (SELECT key // 1000 AS query_id, (key % 1000) * 2 AS li, rank, doc_id FROM dd WHERE rank <= 50 UNION ALL SELECT query_id // 1000, (query_id % 1000) * 2 + 1, rank, doc_id FROM br WHERE rank <= 50
    ), fs AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(li * 1000 + rank) AS first FROM ls GROUP BY ALL
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id)::INTEGER AS rank FROM fs) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10"""
)
def multi_keyword_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tokenize(F.col("text"))
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 8).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * 8 + 1, 8), " "))
    items = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).where(F.size("w") > 0)
    kw = items.select(F.col("item_id").alias("query_id"), F.posexplode(runs).alias("kw", "text"))
    v = _vectors(spark, sf_dir)
    ids = v.agg((F.max("doc_id") + 1).alias("ids"))
    kw = kw.crossJoin(F.broadcast(ids)).join(v.select(F.col("doc_id").alias("vid"), "embedding"), (F.col("query_id") + 7 * F.col("kw")) % F.col("ids") == F.col("vid"), "left")
    notes = kw.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("kw", "text", "embedding"))).alias("k"))
    notes = notes.select("query_id", F.transform("k", lambda x: F.struct(x["text"].alias("text"), x["embedding"].alias("embedding"))).alias("keywords"))
    return rt.multi_keyword_search(_index(spark, sf_dir), v, notes, 10)


@reg.add(
    f"""WITH {_DENSE}, c AS (SELECT query_id, doc_id, rank, (doc_id * 7 + query_id) % 11 / 10.0 AS s, doc_id % 3 <> 0 AS cached FROM dr WHERE rank <= 40
    ), r AS (SELECT query_id, doc_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, (NOT cached), rank)::INTEGER AS rank FROM c) SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM r WHERE rank <= 10"""
)
def rerank_merge_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dn.dense_top_k(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 40).drop("score")
    s = c.withColumn("score", (F.col("doc_id") * 7 + F.col("query_id")) % 11 / 10)
    out = fu.rerank(c, s.where("doc_id % 3 <> 0"), s.where("doc_id % 3 = 0"), 10)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@reg.add(
    f"""WITH {_KW}, n AS (SELECT item_id AS query_id, array_agg(text ORDER BY kw) AS k, any_value(text) AS t FROM kq GROUP BY 1), b AS (SELECT item_id AS query_id, text FROM benchmark)
    SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'disk' WHEN 1 THEN 'store' WHEN 2 THEN 'fresh' ELSE 'note' END AS origin,
    md5(array_to_string(CASE WHEN query_id % 4 < 3 THEN k[1:12] ELSE [b.text] END, '|')) AS keywords_md5 FROM b JOIN n USING (query_id)"""
)
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fourth of the notes has its keywords on disk, in the store, from the model, or nowhere; empty stored lists are misses."""
    w = tokenize(F.col("text"))
    notes = _items(spark, sf_dir).withColumn("w", w).where(F.size("w") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 8).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * 8 + 1, 8), " "))
    k = notes.select("query_id", F.slice(runs, 1, 12).alias("keywords"))
    none = F.array().cast("array<string>")
    store = k.where("query_id % 4 in (1, 2)").withColumn("keywords", F.when(F.col("query_id") % 4 == 1, F.col("keywords")).otherwise(none))
    out = rt.generate_keywords(notes, k.where("query_id % 4 = 0"), store, k.where("query_id % 4 = 2"))
    return out.select("query_id", "origin", F.md5(F.array_join("keywords", "|").cast("binary")).alias("keywords_md5"))


# --- metrics: vectors of one label are gold, of the next label excluded, self left out -----------

_IR = f"""{_DENSE}, pr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds WHERE doc_id <> query_id
), lb AS (SELECT query_id, doc_id, CASE WHEN label = qlabel THEN 2 WHEN abs(label - qlabel) = 1 THEN 1 ELSE 0 END AS rel FROM ds WHERE doc_id <> query_id
), gn AS (SELECT query_id, count(*) AS n_gold FROM lb WHERE rel = 2 GROUP BY 1)"""


def _ir_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, q = _vectors(spark, sf_dir), _vector_queries(spark, sf_dir)
    p = dn.dense_top_k(v, q, 201).where("doc_id <> query_id")
    p = rt.rank_within(p.drop("rank"), ["query_id"], F.desc("score"), F.asc("doc_id")).where("rank <= 200")
    ql = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql"))
    kind = F.when(F.col("label") == F.col("ql"), "eligible").when(F.abs(F.col("label") - F.col("ql")) == 1, "excluded").otherwise("irrelevant")
    return p, v.crossJoin(ql).where("doc_id <> query_id").select("query_id", "doc_id", kind.alias("label"))


@reg.add(
    f"""WITH {_IR} SELECT gn.query_id, k::INTEGER AS k, round(count(*) FILTER (pr.rank <= k AND lb.rel = 2) / max(n_gold)::DOUBLE, 6) AS recall
    FROM gn JOIN pr USING (query_id) JOIN lb ON lb.query_id = pr.query_id AND lb.doc_id = pr.doc_id, (VALUES (10), (20), (50), (100), (200)) AS v(k) GROUP BY 1, 2"""
)
def recall_at_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, l = _ir_inputs(spark, sf_dir)
    return ir.recall_at(p, l, [10, 20, 50, 100, 200]).select("query_id", "k", F.round("recall", 6).alias("recall"))


@reg.add(f"WITH {_IR} SELECT gn.query_id, round(coalesce(1.0 / min(pr.rank) FILTER (lb.rel = 2 AND pr.rank <= 200), 0), 6)::DOUBLE AS rr FROM gn JOIN pr USING (query_id) JOIN lb ON lb.query_id = pr.query_id AND lb.doc_id = pr.doc_id GROUP BY 1")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, l = _ir_inputs(spark, sf_dir)
    return ir.reciprocal_rank(p, l).select("query_id", F.round("rr", 6).alias("rr"))


@reg.add(
    f"""WITH {_IR}, il AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM lb
    ), i AS (SELECT query_id, sum(rel / log2(r + 1)) AS ideal FROM il WHERE r <= 10 GROUP BY 1
    ), g AS (SELECT pr.query_id, sum(rel / log2(rank + 1)) AS dcg FROM pr JOIN lb ON lb.query_id = pr.query_id AND lb.doc_id = pr.doc_id WHERE rank <= 10 GROUP BY 1)
    SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg FROM i LEFT JOIN g USING (query_id)"""
)
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, l = _ir_inputs(spark, sf_dir)
    return ir.ndcg_at(p, l, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@reg.add(
    f"""WITH {_IR}, r AS (SELECT gn.query_id, k, count(*) FILTER (pr.rank <= k AND lb.rel = 2) / max(n_gold)::DOUBLE AS recall FROM gn JOIN pr USING (query_id) JOIN lb ON lb.query_id = pr.query_id AND lb.doc_id = pr.doc_id, (VALUES (10), (50)) AS v(k) GROUP BY 1, 2
    ), m AS (SELECT 'recall@' || k AS metric, round(avg(recall), 4) AS value FROM r GROUP BY k)
    SELECT metric, value FROM m UNION ALL SELECT metric || '_adj', round(value / 0.8, 4) FROM m"""
)
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, l = _ir_inputs(spark, sf_dir)
    return ir.cohort_summary(p, l, 0.8, [10, 50]).where("metric like 'recall%'")


@reg.add(
    """WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0), f AS (SELECT g.doc_id, d.doc_id IS NOT NULL AS there FROM g LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang <> 'fr') d USING (doc_id))
    SELECT count(*)::BIGINT AS total, count(*) FILTER (there)::BIGINT AS present, count(*) FILTER (NOT there)::BIGINT AS missing, round(count(*) FILTER (there) / count(*)::DOUBLE, 6) AS coverage,
    array_to_string((array_agg(doc_id ORDER BY doc_id) FILTER (NOT there))[1:10], ',') AS missing_first FROM f"""
)
def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "eligible").when(F.col("quality") == 1, "excluded").otherwise("irrelevant")
    out = ir.gold_coverage(l.select("doc_id", label.alias("label")), table(spark, sf_dir, "documents").where("lang <> 'fr'"))
    return out.select("total", "present", "missing", F.round("coverage", 6).alias("coverage"), F.array_join(F.col("missing_first").cast("array<string>"), ",").alias("missing_first"))


@reg.add("SELECT event_type, x[(len(x) // 2) + 1] AS p50, x[floor(len(x) * 0.95)::BIGINT + 1] AS p95, len(x)::BIGINT AS n FROM (SELECT event_type, list_sort(list(value)) AS x FROM events GROUP BY 1)")
def latency_percentiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.latency_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value")


@reg.add("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))
