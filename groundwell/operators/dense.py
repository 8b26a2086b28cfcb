"""Dense search: exact cosine top-k by matrix products, and an inverted-list index that probes a few lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.vector import dot, l2_normalize
from groundwell.operators.sizing import broadcast_blocks

#: Queries whose vectors are sent to every executor at once: 61 MB at 768 dimensions.
BLOCK_QUERIES = 10_000
#: Scores held at once by a task: 32 MB.
BLOCK_SCORES = 1 << 22


def dense_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", vector: str = "embedding", normalised: bool = True) -> DataFrame:
    """(query_id, doc_id, score): the stated queries, in blocks that are broadcast, against every vector."""
    d = docs.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("doc_id"), (F.col(vector) if normalised else l2_normalize(F.col(vector))).alias("dv"))
    q = queries.where(F.col(vector).isNotNull()).select("query_id", (F.col(vector) if normalised else l2_normalize(F.col(vector))).alias("qv"))
    parts = [d.crossJoin(block).select("query_id", "doc_id", dot(F.col("qv"), F.col("dv")).alias("score")) for block in broadcast_blocks(q, BLOCK_QUERIES)]
    return reduce(DataFrame.unionByName, parts)


def best_of(scores, ids, k: int):
    """Rows and places of the ``k`` best scores of each row, the smallest ids first among equals."""
    import numpy as np

    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        rows, at = np.nonzero(scores >= least[:, None])
    else:
        rows, at = np.nonzero(np.ones_like(scores, bool))
    order = np.lexsort((ids[at], -scores[rows, at], rows))
    rows, at = rows[order], at[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], at[nth < k]


def _ragged(widths, vector: str):
    if len(widths) and (widths != widths[0]).any():
        raise ValueError(f"{vector} has vectors of {int(widths.min())} to {int(widths.max())} dimensions")


def dense_top_k(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", vector: str = "embedding", digits: int = 6, normalised: bool = True, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, doc_id, score, rank) by score, ties by id; null vectors are left out, ragged ones are an error.

    The query vectors are one broadcast matrix, ``block_queries`` at a time;
    each Arrow batch of vectors is multiplied with it and sends on only its own
    best k a query, so the shuffle before the last ranking is small.
    """
    import numpy as np

    unit = (lambda c: c) if normalised else l2_normalize
    d = docs.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("doc_id"), unit(F.col(vector)).alias("v"))
    q = queries.where(F.col(vector).isNotNull()).select("query_id", unit(F.col(vector)).alias("v"))
    kinds = dict(d.dtypes)["doc_id"], dict(q.dtypes)["query_id"]
    sc = docs.sparkSession.sparkContext

    def scorer(block: list):
        import pyarrow as pa

        _ragged(np.asarray([len(r[1]) for r in block]), vector)
        sent = sc.broadcast(np.asarray([r[1] for r in block], np.float64))

        def run(batches: Iterator) -> Iterator:
            m = sent.value
            for batch in batches:
                lists = batch.column(1)
                if not batch.num_rows or not len(m):
                    continue
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(flat) != batch.num_rows * m.shape[1]:
                    raise ValueError(f"{vector} has vectors of other than {m.shape[1]} dimensions")
                flat, ids = flat.reshape(batch.num_rows, -1), np.asarray(batch.column(0))
                step = max(1, BLOCK_SCORES // batch.num_rows)
                for low in range(0, len(m), step):
                    s = np.round(m[low : low + step] @ flat.T, digits) + 0.0
                    rows, at = best_of(s, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(rows + low, pa.int64()), batch.column(0).take(pa.array(at)), pa.array(s[rows, at])], ["n", "doc_id", "score"])

        return run

    rows, near = q.collect() if q.limit(block_queries + 1).count() <= block_queries else None, None
    rows = iter(rows) if rows is not None else q.toLocalIterator()
    spark = docs.sparkSession
    while (block := list(islice(rows, block_queries))) or near is None:
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"n long, query_id {kinds[1]}")
        part = d.mapInArrow(scorer(block), f"n long, doc_id {kinds[0]}, score double").join(F.broadcast(names), "n").select("query_id", "doc_id", "score")
        near = part if near is None else near.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ivf_centroids(docs: DataFrame, lists: int, vector: str = "embedding", rounds: int = 8, sample_rows: int = 20_000, seed: int = 0) -> list[list[float]]:
    """Spherical k-means on a bounded sample; every vector is indexed afterwards. No vectors give no centroids."""
    import numpy as np

    sample = docs.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(F.col(vector), F.lit(seed))).limit(sample_rows).collect()
    if not sample:
        return []
    x = np.asarray([r[0] for r in sample], np.float64)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / (np.linalg.norm(m) or 1.0)
    return c.tolist()


def _nearest(m, centroids, n: int):
    """The ``n`` lists nearest to each row, the first of equals first."""
    import numpy as np

    return np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :n]


def ivf_index(docs: DataFrame, centroids: list[list[float]], id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(doc_id, embedding, list): every vector with its nearest list; written by list, a search reads only what it probes."""
    import numpy as np

    d = docs.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(vector).alias("embedding"))
    kinds = dict(d.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_nearest(m, sent.value, 1)[:, 0].astype(np.int32))], ["doc_id", "embedding", "list"])

    return d.mapInArrow(run, f"doc_id {kinds['doc_id']}, embedding {kinds['embedding']}, list int")


def ivf_top_k(index: DataFrame, queries: DataFrame, centroids: list[list[float]], probes: int, k: int = 50, digits: int = 6, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, doc_id, score, rank) among the vectors of each query's ``probes`` nearest lists; all lists give the exact answer.

    ``index`` is :func:`ivf_index`'s; lists that no query of a block probes are not read.
    """
    import numpy as np

    spark, near = queries.sparkSession, None
    kinds = dict(index.dtypes)["doc_id"], dict(queries.dtypes)["query_id"]
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    rows = iter(q.collect()) if q.limit(block_queries + 1).count() <= block_queries else q.toLocalIterator()

    def scorer(m, asked: dict):
        sent = spark.sparkContext.broadcast((m, asked))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            m, asked = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                v, of = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1), np.asarray(b.column(2))
                for one in np.unique(of):
                    here, who = np.flatnonzero(of == one), asked.get(int(one))
                    if who is None:
                        continue
                    ids = b.column(0).take(pa.array(here))
                    step = max(1, BLOCK_SCORES // len(here))
                    for low in range(0, len(who), step):
                        s = np.round(m[who[low : low + step]] @ v[here].T, digits) + 0.0
                        r, at = best_of(s, np.asarray(ids), k)
                        yield pa.RecordBatch.from_arrays([pa.array(who[low + r], pa.int64()), ids.take(pa.array(at)), pa.array(s[r, at])], ["n", "doc_id", "score"])

        return run

    while (block := list(islice(rows, block_queries))) or near is None:
        m = np.asarray([r[1] for r in block], np.float64)
        lists = _nearest(m, np.asarray(centroids, np.float64), probes) if block and centroids else np.zeros((0, 0), np.int64)
        asked = {int(x): np.flatnonzero((lists == x).any(axis=1)) for x in np.unique(lists)}
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"n long, query_id {kinds[1]}")
        held = index.where(F.col("list").isin([*asked])) if asked else index.where(F.lit(False))
        part = held.select("doc_id", "embedding", "list").mapInArrow(scorer(m, asked), f"n long, doc_id {kinds[0]}, score double")
        part = part.join(F.broadcast(names), "n").select("query_id", "doc_id", "score")
        near = part if near is None else near.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
