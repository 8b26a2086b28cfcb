"""Prices, budgets and token estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators.sizing import broadcast_if_small

# USD per million tokens in and out.
PRICES = [("deepinfra", "meta-llama/Llama-3.3-70B-Instruct-Turbo", 0.10, 0.32), ("groq", "llama-3.3-70b-versatile", 0.0, 0.0)]
DIVERGENCE_TOLERANCE = 0.10


def price_table(spark: SparkSession, prices: list[tuple[str, str, float, float]] = PRICES) -> DataFrame:
    return spark.createDataFrame(prices, "provider string, model string, usd_in double, usd_out double")


def table_usd(in_tokens: Column, out_tokens: Column, usd_in: Column, usd_out: Column) -> Column:
    """Null where the pair is not priced."""
    return (in_tokens * usd_in + out_tokens * usd_out) / 1_000_000


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``table_usd``, ``usd``, ``cost_source`` and ``drifted``: the provider's figure wins, then the table, then 0.

    A figure drifts if it is more than a tenth of the table's away from it; that
    is compared in decimals, so that exactly a tenth is no drift.
    """
    priced = usage.join(broadcast_if_small(prices), ["provider", "model"], "left")
    # precisions that leave every product and difference its eighteen places
    millionths = lambda tokens, usd: F.col(tokens).cast("decimal(10,0)") * F.col(usd).cast("decimal(8,4)")
    exact = millionths("in_tokens", "usd_in") + millionths("out_tokens", "usd_out")
    off = F.abs(F.col("provider_usd").cast("decimal(24,18)") * F.lit(1_000_000).cast("decimal(7,0)") - exact)
    table = table_usd(F.col("in_tokens"), F.col("out_tokens"), F.col("usd_in"), F.col("usd_out"))
    reported = F.col("provider_usd").cast("double")
    return (
        priced.withColumn("table_usd", table)
        .withColumn("usd", F.coalesce(reported, F.col("table_usd"), F.lit(0.0)))
        .withColumn("cost_source", F.when(reported.isNotNull(), "provider").when(F.col("table_usd").isNotNull(), "table").otherwise("unknown"))
        .withColumn("drifted", F.coalesce((exact > 0) & (off > exact * F.lit(DIVERGENCE_TOLERANCE).cast("decimal(4,2)")), F.lit(False)))
        .drop("usd_in", "usd_out")
    )


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def extract_usage(usage: Column, raw: Column) -> Column:
    """Struct of a response's usage: normalised counts where they say anything, else the raw ones, else 0.

    ``usage`` is a struct of ``input_tokens, output_tokens, total_tokens``; ``raw``
    one of ``prompt_tokens, completion_tokens, total_tokens, estimated_cost,
    model_name, model``. The provider's own cost and the model that it says it
    ran are only in the raw answer, and null if they are not there either.
    """
    some = lambda a, b: F.coalesce(F.nullif(a, F.lit(0)), F.nullif(b, F.lit(0)), F.lit(0)).cast("long")
    named = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        some(usage["input_tokens"], raw["prompt_tokens"]).alias("in_tokens"),
        some(usage["output_tokens"], raw["completion_tokens"]).alias("out_tokens"),
        some(usage["total_tokens"], raw["total_tokens"]).alias("tokens"),
        raw["estimated_cost"].cast("double").alias("provider_usd"),
        F.coalesce(named(raw["model_name"]), raw["model"]).alias("served_model"),
    )
