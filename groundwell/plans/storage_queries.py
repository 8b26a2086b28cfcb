"""Ledger, merges, refresh, state machines and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import money
from groundwell.operators import cdc, ledger, stateful
from groundwell.operators.sizing import broadcast_if_small
from groundwell.plans.common import Registry, table
from groundwell.streaming import windows

reg = Registry()

_USAGE = "us AS (SELECT event_id AS seq, ts, (value)::DECIMAL(16,8) AS usd, (props->>'k')::BIGINT AS tokens, 'p' AS provider, event_type AS model FROM events)"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.col("value").cast("decimal(16,8)").alias("usd"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.lit("p").alias("provider"), F.col("event_type").alias("model"),
        F.when(F.col("event_id") % 3 == 0, "table").otherwise("provider").alias("cost_source"), F.lit(None).cast("string").alias("served_model"),
    )


@reg.add(f"WITH {_USAGE} SELECT ts::DATE AS day, round(sum(usd)::DOUBLE, 4) AS usd, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS calls FROM us GROUP BY 1")
def ledger_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily(_usage(spark, sf_dir)).select("day", F.round(F.col("usd").cast("double"), 4).alias("usd"), "tokens", "calls")


@reg.add(f"WITH {_USAGE} SELECT ts::DATE AS day, 'p|' || model AS model_key, round(sum(usd)::DOUBLE, 4) AS usd, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS calls, CASE WHEN max(seq) % 3 = 0 THEN 'table' ELSE 'provider' END AS source FROM us GROUP BY 1, 2")
def ledger_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.by_model(_usage(spark, sf_dir)).select("day", "model_key", F.round(F.col("usd").cast("double"), 4).alias("usd"), "tokens", "calls", "source")


@reg.add(f"WITH {_USAGE} SELECT round(sum(usd)::DOUBLE, 4) AS usd, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS calls, count(DISTINCT ts::DATE)::BIGINT AS days FROM us")
def ledger_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.lifetime(ledger.daily(_usage(spark, sf_dir))).select(F.round(F.col("usd").cast("double"), 4).alias("usd"), F.col("tokens").cast("long").alias("tokens"), F.col("calls").cast("long").alias("calls"), "days")


@reg.add(
    """WITH e AS (SELECT event_id AS seq, ts::DATE AS day, user_id, (props->>'k')::BIGINT AS tokens, value::DECIMAL(16,8) AS usd FROM events
    ), r AS (SELECT *, coalesce(sum(usd) OVER w, 0) + usd < 120 AND coalesce(sum(tokens) OVER w, 0) + tokens < 200 AS ok FROM e WINDOW w AS (PARTITION BY day, user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT seq, day, user_id, bool_and(ok) OVER (PARTITION BY day, user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS allowed FROM r"""
)
def budget_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.to_date("ts").alias("day"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").cast("decimal(16,8)").alias("usd"))
    return ledger.budget_breaker(e, 120, 200, ("day", "user_id")).select("seq", "day", "user_id", "allowed")


@reg.add(
    """WITH e AS (SELECT event_id, (props->>'k')::BIGINT AS k, event_type FROM events
    ), p AS (SELECT event_id, CASE WHEN event_type = 'click' THEN (k * 0.1 + (k + 1) * 0.32) / 1e6 WHEN event_type = 'view' THEN 0.0 END::DOUBLE AS t, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ((k * 0.1 + (k + 1) * 0.32) * (1 + (event_id % 3) * 0.1) / 1e6)::DOUBLE END AS r FROM e
    ), x AS (SELECT p.*, e.event_type, (e.k * 0.1 + (e.k + 1) * 0.32)::DECIMAL(24,6) AS exact, p.r::DECIMAL(24,18) * 1000000::DECIMAL(7,0) AS said FROM p JOIN e USING (event_id))
    SELECT event_id, round(coalesce(r, t, 0), 12) AS usd, CASE WHEN r IS NOT NULL THEN 'provider' WHEN t IS NOT NULL THEN 'table' ELSE 'unknown' END AS cost_source, coalesce(t > 0 AND abs(said - exact) * 10 > exact, false) AS drifted FROM x"""
)
def price_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    who = F.when(F.col("event_type") == "click", "deepinfra").when(F.col("event_type") == "view", "groq").otherwise("other")
    which = F.when(F.col("event_type") == "click", money.PRICES[0][1]).when(F.col("event_type") == "view", money.PRICES[1][1]).otherwise("m")
    said = F.when(F.col("event_id") % 4 != 0, (F.col("in_tokens") * 0.1 + F.col("out_tokens") * 0.32) * (1 + F.col("event_id") % 3 * 0.1) / 1e6)
    u = e.select("event_id", k.alias("in_tokens"), (k + 1).alias("out_tokens"), who.alias("provider"), which.alias("model")).withColumn("provider_usd", said)
    return money.with_cost(u, money.price_table(spark)).select("event_id", F.round("usd", 12).alias("usd"), "cost_source", "drifted")


# The stored corpus is nine tenths of the documents; the fetched one another nine tenths, status changed for every seventh.
_SNAP = "o AS (SELECT doc_id, lang AS status, 'old' AS last_updated FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS status, 'new' AS last_updated FROM documents WHERE doc_id % 10 <> 1)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 10 <> 0").select("doc_id", F.col("lang").alias("status"), F.lit("old").alias("last_updated"))
    new = d.where("doc_id % 10 <> 1").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("status"), F.lit("new").alias("last_updated"))
    return old, new


@reg.add(f"WITH {_SNAP} SELECT doc_id, CASE WHEN o.last_updated IS NULL THEN 'new' WHEN n.last_updated IS NULL THEN 'expired' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id) WHERE o.last_updated IS NULL OR n.last_updated IS NULL OR o.status IS DISTINCT FROM n.status")
def refresh_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.refresh_diff(*_snapshots(spark, sf_dir), "doc_id")


@reg.add(f"WITH {_SNAP} SELECT doc_id, n.status, CASE WHEN o.last_updated IS NULL OR o.status IS DISTINCT FROM n.status THEN 'new' ELSE 'old' END AS last_updated FROM n LEFT JOIN o USING (doc_id)")
def refresh_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.refresh_apply(*_snapshots(spark, sf_dir), "doc_id")


@reg.add("WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS v, 0 AS seq FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT l_orderkey, l_linestatus || l_linenumber, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0), r AS (SELECT k, v, seq, row_number() OVER (PARTITION BY k ORDER BY seq DESC, v DESC) AS n FROM b) SELECT k, v, seq::INTEGER AS seq FROM r WHERE n = 1")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(0).alias("seq"))
    delta = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("k"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("v"), F.col("l_linenumber").alias("seq"))
    # line numbers repeat within an order: the larger value is the later one
    delta = delta.groupBy("k", "seq").agg(F.max("v").alias("v")).select("k", "v", "seq")
    return cdc.merge_latest(base, delta, ["k"], "seq")


@reg.add("WITH d AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), f AS (SELECT k, p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM d WHERE k % 4 <> 0) WHERE r = 1) SELECT k, p FROM f UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 4 = 0")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("k"), F.lit(-1).cast("long").alias("p"), F.lit(0).alias("n"))
    delta = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p")).select("k", "p", "n")
    return cdc.insert_ignore(base, delta, ["k"], "n").select("k", "p")


@reg.add("SELECT event_type AS namespace, user_id::VARCHAR AS key, arg_max(props, event_id) AS value, min(event_id)::BIGINT AS created_at FROM events GROUP BY 1, 2")
def cache_write_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("created_at"), F.col("event_id").alias("seq"))
    return cdc.cache_put(e.where("seq % 2 = 0"), e.where("seq % 2 = 1")).select("namespace", "key", "value", "created_at")


@reg.add("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 3)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") != 3, F.col("embedding")).alias("embedding"))
    return cdc.resume(table(spark, sf_dir, "documents").select("doc_id", "lang"), stored, "doc_id")


@reg.add("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def label_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


@reg.add(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
    ), f AS (SELECT user_id, event_id, rn, true AS allowed, [t] AS hits FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.rn, len(list_filter(f.hits, lambda h: h >= e.t - 86400)) < 3,
        CASE WHEN len(list_filter(f.hits, lambda h: h >= e.t - 86400)) < 3 THEN list_append(list_filter(f.hits, lambda h: h >= e.t - 86400), e.t) ELSE list_filter(f.hits, lambda h: h >= e.t - 86400) END
      FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    SELECT user_id, event_id, allowed FROM f"""
)
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return stateful.rate_limiter(e, "user_id", "ts", 3, 86_400, "event_id").select("user_id", "event_id", "allowed")


_JOBS = """j AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, ts, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'create' WHEN event_type = 'signup' THEN 'complete' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'view' AND event_id % 50 = 0 THEN 'get' ELSE 'append' END AS type, event_id % 2 = 0 AS told FROM events)"""


@reg.add(
    f"""WITH {_JOBS}, b AS (SELECT job_id, min(epoch(ts)) AS born FROM j WHERE type = 'create' GROUP BY 1
    ), s AS (SELECT epoch(ts) AS t, seq FROM j WHERE type IN ('create', 'get')), g AS (SELECT job_id, min({{'t': t, 'seq': s.seq}}) AS gone FROM b LEFT JOIN s ON t - born > 864000 GROUP BY 1
    ), l AS (SELECT j.*, type IN ('complete', 'fail') AS ends FROM j JOIN g USING (job_id) WHERE type NOT IN ('create', 'get') AND (gone IS NULL OR gone.t IS NULL OR {{'t': epoch(ts), 'seq': j.seq}} < gone)
    ), a AS (SELECT job_id, count(*) FILTER (type <> 'complete' OR told) AS n, bool_or(type = 'append') AS ran, arg_max(type, {{'t': epoch(ts), 'seq': seq}}) FILTER (ends) AS last FROM l GROUP BY 1)
    SELECT job_id, CASE WHEN last = 'fail' THEN 'error' WHEN last = 'complete' THEN 'done' WHEN ran THEN 'running' ELSE 'queued' END AS status, coalesce(n, 0)::BIGINT AS n_events FROM b LEFT JOIN a USING (job_id)"""
)
def job_ttl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    j = e.join(first, "user_id").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.lit(None).cast("string").alias("error"),
        F.when(F.col("event_id") == F.col("first"), "create").when(F.col("event_type") == "signup", "complete").when(F.col("event_type") == "error", "fail")
        .when((F.col("event_type") == "view") & (F.col("event_id") % 50 == 0), "get").otherwise("append").alias("type"),
        F.when(F.col("event_id") % 2 == 0, "{}").alias("payload"),
    )
    return stateful.job_replay(j, 864_000).select("job_id", "status", "n_events")


@reg.add("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS end, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"])


@reg.add("SELECT b AS start, b + INTERVAL 2 DAY AS end, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS b FROM events) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(table(spark, sf_dir, "events"), "ts", "2 days", ["event_type"], slide="1 day")


@reg.add(
    """WITH s AS (SELECT user_id, ts, sum(CASE WHEN ts - prev < INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events))
    SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, g"""
)
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"])


@reg.add("SELECT DISTINCT user_id, event_type FROM events")
def events_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each kind and user; on a stream within the watermark."""
    return windows.deduplicated(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type")


@reg.add("SELECT event_type, count(*)::BIGINT AS n, round(sum(value * p.usd), 2) AS usd FROM events JOIN (VALUES ('click', 0.5), ('view', 0.1), ('purchase', 2.0)) AS p(event_type, usd) USING (event_type) GROUP BY 1")
def usage_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 0.5), ("view", 0.1), ("purchase", 2.0)], "event_type string, usd double")
    e = table(spark, sf_dir, "events").join(broadcast_if_small(prices), "event_type")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * F.col("usd")), 2).alias("usd"))
