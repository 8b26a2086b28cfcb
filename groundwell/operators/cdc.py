"""Write semantics without a table format: latest-wins merges, insert-ignore and corpus refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REFRESH_GUARD = 0.5


def merge_latest(base: DataFrame, delta: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: that of the largest ``seq``, the delta's on a tie. Every other column is overwritten."""
    both = base.withColumn("__d", F.lit(0)).unionByName(delta.withColumn("__d", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(seq), F.desc("__d"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__d")


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``base`` and, of the keys it lacks, the first row of ``delta``."""
    w = Window.partitionBy(*keys).orderBy(seq)
    fresh = delta.join(base.select(*keys), keys, "left_anti").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return base.unionByName(fresh)


def additive_upsert(totals: DataFrame, usage: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return totals.select(*keys, *sums).unionByName(usage.select(*keys, *sums)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def cache_put(cache: DataFrame, writes: DataFrame, seq: str = "seq") -> DataFrame:
    """(namespace, key, value, created_at): the last value, the first creation time."""
    cols = ["namespace", "key", "value", "created_at", seq]
    both = cache.select(*cols).unionByName(writes.select(*cols))
    return both.groupBy("namespace", "key").agg(F.max_by("value", seq).alias("value"), F.min_by("created_at", seq).alias("created_at"), F.max(seq).alias(seq))


def refresh_diff(old: DataFrame, new: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, change): ``new``, ``expired`` or ``changed``, by null-safe comparison of status."""
    o, n = old.select(key, F.col(status).alias("o"), F.lit(1).alias("io")), new.select(key, F.col(status).alias("n"), F.lit(1).alias("in_"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("io").isNull(), "new").when(F.col("in_").isNull(), "expired").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def refresh_apply(old: DataFrame, new: DataFrame, key: str, status: str = "status", updated: str = "last_updated", guard: float = REFRESH_GUARD) -> DataFrame:
    """``old`` brought up to ``new``: expired rows go, new ones come, changed ones get status and update time only.

    Refuses before anything is written if ``new`` has fewer than ``guard`` times the rows of a non-empty ``old``.
    """
    n_old, n_new = old.select(key).distinct().count(), new.select(key).distinct().count()
    if n_old and n_new < guard * n_old:
        raise ValueError(f"refresh refused: {n_new} rows fetched for {n_old} stored")
    n = new.select(key, F.col(status).alias("__s"), F.col(updated).alias("__u"))
    kept = old.join(n, key)
    changed = ~F.col(status).eqNullSafe(F.col("__s"))
    kept = kept.withColumns({updated: F.when(changed, F.col("__u")).otherwise(F.col(updated)), status: F.col("__s")}).select(*old.columns)
    return kept.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def resume(fetched: DataFrame, stored: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Fetched rows not yet embedded in any source."""
    return fetched.join(stored.where(F.col(vector).isNotNull()).select(key), key, "left_anti")
