"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side may have to be sent to every executor.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is, to be shuffled.

    Costs one look at ``most_rows + 1`` rows of what should be a small input.
    """
    small = df.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(df) if small else df


def broadcast_blocks(df: DataFrame, most_rows: int) -> list[DataFrame]:
    """``df`` in parts of about ``most_rows`` rows, each with a broadcast hint: for a stated query set that meets every row.

    Rows are dealt by a hash of the whole row, so a recomputed part is the same.
    """
    if df.limit(most_rows + 1).count() <= most_rows:
        return [F.broadcast(df)]
    # half of what is allowed, so that an uneven deal stays within it
    parts = -(-df.count() // max(1, most_rows // 2))
    at = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    return [F.broadcast(df.where(at == p)) for p in range(parts)]


def widen(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A file of one row group is one task however many cores wait. Only inputs
    with fewer splits than cores are dealt out anew, so large tables are never
    shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
