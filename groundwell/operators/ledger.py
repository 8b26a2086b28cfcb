"""Spend ledger over append-only usage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USD = "decimal(16,8)"


def daily(usage: DataFrame, ts: str = "ts") -> DataFrame:
    """(day, usd, tokens, calls); days without calls do not exist."""
    return usage.groupBy(F.to_date(ts).alias("day")).agg(F.sum(F.col("usd").cast(USD)).cast(USD).alias("usd"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def by_model(usage: DataFrame, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(day, model_key, usd, tokens, calls, source): keyed by the model that served; the last call names the source."""
    key = F.concat_ws("|", "provider", F.coalesce("served_model", "model"))
    return usage.groupBy(F.to_date(ts).alias("day"), key.alias("model_key")).agg(
        F.sum(F.col("usd").cast(USD)).cast(USD).alias("usd"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"), F.max_by("cost_source", seq).alias("source")
    )


def lifetime(days: DataFrame) -> DataFrame:
    return days.agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("days"))


def summary(days: DataFrame, today: Column, usd_cap: float, token_cap: int | None = None) -> DataFrame:
    """One row for today: spent, remaining, exhausted; zeros if nothing was spent."""
    t = days.where(F.col("day") == today).agg(F.coalesce(F.sum("usd"), F.lit(0).cast(USD)).alias("usd"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))
    left = F.greatest(F.lit(0.0), F.lit(usd_cap) - F.col("usd").cast("double"))
    full = (left <= 0) | ((F.col("tokens") >= token_cap) if token_cap is not None else F.lit(False))
    return t.withColumns({"remaining_usd": left, "exhausted": full})


def check(spent_tokens: Column, est_tokens: Column, spent_usd: Column, est_usd: Column, usd_cap: float, token_cap: int | None) -> Column:
    """True where the next call may go ahead: reaching a cap already blocks."""
    ok = spent_usd + est_usd < usd_cap
    return ok & (spent_tokens + est_tokens < token_cap) if token_cap is not None else ok


def budget_breaker(calls: DataFrame, usd_cap: float, token_cap: int | None = None, keys: tuple[str, ...] = ("day",), seq: str = "seq") -> DataFrame:
    """Adds ``allowed``: calls before the first that its key's spending so far does not leave room for.

    A key's spending is a running sum within the key, one day of one account.
    """
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    ok = check(before(F.col("tokens")), F.col("tokens"), before(F.col("usd")), F.col("usd"), usd_cap, token_cap)
    return calls.withColumn("__ok", ok).withColumn("allowed", F.bool_and("__ok").over(upto)).drop("__ok")
