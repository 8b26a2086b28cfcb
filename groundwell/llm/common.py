"""Shared helpers: word splitting, skew-safe joins and ranking, prefix sums in a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.operators.lineage import cut, release  # noqa: F401 - the operators take them from here

#: Words are maximal runs of anything but space and the ASCII controls 9 to 13.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Groups of at least one row in so many are few enough to broadcast: as many groups at most.
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], values: Sequence[str], size: str, n_rows: int, spread_by: str, how: str = "inner") -> DataFrame:
    """``rows`` with the ``values`` of their group, of which ``groups`` has one row per ``keys`` and its ``size``.

    Groups of at least one row in ``HOT_SHARE`` are joined by broadcast, there
    being that many of them at most; their rows do not meet in a task but are
    dealt by ``spread_by``. So no task gets more than a small group by key.
    """
    is_hot = F.col(size) * HOT_SHARE >= n_rows
    names = {k: f"__{k}" for k in keys}
    value = F.struct(*values)
    hot = groups.where(is_hot).select(*[F.col(k).alias(f"__h{k}") for k in keys], value.alias("__hot"))
    # lane 0, but not a literal: the planner would take that out of the join's keys
    cold = groups.where(~is_hot).select(F.pmod(F.xxhash64(*keys), F.lit(1).cast("long")).alias("__lane"), *[F.col(k).alias(names[k]) for k in keys], value.alias("__cold"))
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"__h{k}") for k in keys], "left")
    # rows of hot groups find nothing in their lanes, of which there are many
    lane = F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(spread_by), F.lit(1 << 40)) + 1)
    out = met.withColumn("__at", lane).join(cold, [F.col("__at") == F.col("__lane"), *[F.col(k) == F.col(names[k]) for k in keys]], "left")
    out = out.withColumn("__got", F.coalesce("__hot", "__cold")).select(*rows.columns, "__got")
    out = out.where("__got is not null") if how == "inner" else out
    return out.select(*rows.columns, *[F.col("__got")[v].alias(v) for v in values])


def members_of(rows: DataFrame, groups: DataFrame, keys: Sequence[str], values: Sequence[str], size: str, n_rows: int) -> DataFrame:
    """The ``rows`` that have a group in ``groups`` (materialised), with its ``values``; keys are not null.

    For tables most of whose rows have no group. Groups of at least one row in
    ``HOT_SHARE`` are told by a hash of their keys, which the driver collects, so
    their rows stay out of the shuffle and rows without a group leave in the join.
    """
    mark = F.xxhash64(*keys)
    hot = [r[0] for r in groups.where(F.col(size) * HOT_SHARE >= n_rows).select(mark).distinct().collect()]
    side = groups.withColumn("__hot", mark.isin(hot)) if hot else groups.withColumn("__hot", F.lit(False))
    side = side.select("__hot", *[F.col(k).alias(f"__{k}") for k in keys], *values)
    on, out = [F.col(k) == F.col(f"__{k}") for k in keys], [*rows.columns, *values]
    if not hot:
        return rows.join(side, on).select(*out)
    cold = rows.where(~mark.isin(hot)).join(side.where("not __hot"), on)
    return rows.where(mark.isin(hot)).join(F.broadcast(side.where("__hot")), on).select(*out).unionByName(cold.select(*out))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone.

    ``lower`` does the same on pure ASCII and is much the fastest, so only texts
    with multi-byte characters go through ``translate``.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of words; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words (long): the pieces between breaks less the empty ones at either end."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_BREAK))).cast("long")


def spread(n_rows: int, rows_per_bucket: int = 20_000, least: int = 256) -> int:
    """Buckets into which a group of up to ``n_rows`` rows is dealt."""
    return max(least, -(-n_rows // rows_per_bucket))


def bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """Per (keys, bucket): its rows ``n``, the rows ``before`` it in its group, and the group's ``total``.

    Rows are pre-aggregated before the shuffle, so a group that holds a third of
    the table costs one row per bucket and task, not one per member.
    """
    per = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return per.withColumn("before", F.sum("n").over(w.orderBy(bucket)) - F.col("n")).withColumn("total", F.sum("n").over(w))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row; maps, which cannot be hashed, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes])


def sums_before(sizes: Column, chunk: int = 256) -> Column:
    """For each number of an array the sum of those before it, by sums within chunks and of chunks, so that long arrays are not quadratic."""

    def within(xs: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")))

    def whole(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(chunk)), lambda i: i <= F.size(xs))
        parts = F.transform(starts, lambda i: within(F.slice(xs, i, chunk)))
        return F.transform(F.array(parts), lambda ps: F.flatten(F.zip_with(ps, within(F.transform(ps, lambda p: p["sum"]))["before"], lambda p, b: F.transform(p["before"], lambda x: x + b))))[0]

    return F.transform(F.array(sizes), whole)[0]
