"""Grounding, roll-up, arm metrics, significance and the gate, over lines of documents as quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import text as tx
from groundwell.operators import arm_metrics as am
from groundwell.operators import grounding as gr
from groundwell.operators.lineage import cut
from groundwell.plans.common import Registry, in_list, norm_sql, table

reg = Registry()

# Every line of every document is a criterion whose quote is the line itself or, by position, a spoiled copy.
_BASE = f"""
ln AS (SELECT doc_id, source AS trial_src, (unnest(generate_series(1, len(x))) - 1)::INTEGER AS pos, unnest(x) AS line, {norm_sql("text")} AS source_norm FROM (SELECT *, string_split(text, chr(10)) AS x FROM documents)
), aa AS (SELECT doc_id, pos, line AS criterion, CASE WHEN pos % 2 = 0 THEN 'inclusion' ELSE 'exclusion' END AS kind,
  list_element(['met', 'not_met', 'cannot_determine', 'not_met'], ((doc_id * 7 + pos * 3) % 4)::INTEGER + 1) AS verdict,
  CASE WHEN (doc_id + pos) % 3 = 0 THEN 'zzmissing ' || line ELSE line END AS quote, source_norm, {norm_sql("lang || ' ' || trial_src")} AS patient_norm FROM (SELECT l.*, d.lang FROM ln l JOIN documents d USING (doc_id))
)"""
_TERMS = f"list_filter(list_filter(string_split({norm_sql('criterion')}, ' '), lambda y: y <> ''), lambda t: length(t) >= 4 AND t NOT IN {in_list(tx.ABSENCE_STOPWORDS)} AND NOT regexp_full_match(t, '[0-9]+'))"


def _ground_sql(frm: str, m: str = "2") -> str:
    q = norm_sql("quote")
    return f"""(SELECT *, CASE WHEN gf THEN 'unverifiable' ELSE v0 END AS verdict FROM (SELECT *, v0 IN ('met', 'not_met') AND gb IS NULL AS gf FROM (SELECT * EXCLUDE (verdict), verdict AS v0,
      CASE WHEN (CASE WHEN {q} = '' THEN 0 ELSE len(string_split({q}, ' ')) END) >= {m} AND contains(source_norm, {q}) THEN 'quote'
      WHEN verdict = 'not_met' AND kind = 'exclusion' AND len({_TERMS}) > 0 AND len(list_filter({_TERMS}, lambda t: contains(patient_norm, t))) = 0 THEN 'absence' END AS gb FROM {frm})))"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", tx.normalize(F.col("text")).alias("source_norm"), tx.normalize(F.concat_ws(" ", "lang", "source")).alias("patient_norm"))


def _assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are normalised before the explode: beside it, that would be done for every line.
    return _answered(_sources(spark, sf_dir))


def _answered(d: DataFrame) -> DataFrame:
    d = d.select(*[c for c in d.columns if c != "text"], F.posexplode_outer(F.split("text", "\n")).alias("pos", "criterion"))
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("met", "not_met", "cannot_determine", "not_met")]), ((F.col("doc_id") * 7 + F.col("pos") * 3) % 4 + 1).cast("int"))
    quote = F.when((F.col("doc_id") + F.col("pos")) % 3 == 0, F.concat(F.lit("zzmissing "), "criterion")).otherwise(F.col("criterion"))
    return d.withColumns({"kind": F.when(F.col("pos") % 2 == 0, "inclusion").otherwise("exclusion"), "verdict": verdict, "quote": quote})


@reg.add(
    f"""WITH q AS (SELECT item_id, text AS quote, {norm_sql("text")} AS qn FROM benchmark), s AS (SELECT doc_id, {norm_sql("text")} AS sn FROM documents)
    SELECT item_id, doc_id FROM q JOIN s ON contains(sn, qn) WHERE qn <> '' AND len(string_split(qn, ' ')) >= 2"""
)
def ground_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items quoted whole in a document."""
    return gr.quote_hits(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


@reg.add(f"WITH {_BASE} SELECT doc_id, pos, len({_TERMS}) > 0 AND len(list_filter({_TERMS}, lambda t: contains(source_norm, t))) = 0 AS absent FROM (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN criterion ELSE 'xylograph ' || patient_norm END AS criterion, source_norm FROM aa)")
def absence_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assessments(spark, sf_dir)
    c = F.when(F.col("pos") % 2 == 0, F.col("criterion")).otherwise(F.concat(F.lit("xylograph "), "patient_norm"))
    return a.select("doc_id", "pos", gr.is_absence_grounded(c, F.col("source_norm")).alias("absent"))


@reg.add(f"WITH {_BASE} SELECT doc_id, pos, kind, verdict, gb IS NOT NULL AS grounded, gb AS grounded_by, gf AS grounding_failure FROM {_ground_sql('aa')}")
def ground_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.ground_assessments(_assessments(spark, sf_dir), patient_norm="patient_norm").select("doc_id", "pos", "kind", "verdict", "grounded", "grounded_by", "grounding_failure")


#: Quotes of the stress test: all of the item's words, found in a source made of the item.
@reg.add(
    f"""WITH c AS (SELECT item_id, {norm_sql("text")} AS s, list_filter(string_split({norm_sql("text")}, ' '), lambda y: y <> '') AS q FROM benchmark
    ), g AS (SELECT *, list_filter(q, lambda t: length(t) >= 3 AND t NOT IN {in_list(tx.CONTENT_STOPWORDS)}) AS k FROM c WHERE len(q) >= 2
    ), e AS (SELECT item_id, s, q, (unnest(generate_series(1, len(k))) - 1) AS i, unnest(k) AS tok FROM g
    ), r AS (SELECT NOT contains(s, array_to_string(list_transform(q, lambda t: CASE WHEN t = tok THEN 'zzq' || i || 'xq' ELSE t END), ' ')) AS caught FROM e)
    SELECT (SELECT count(*) FROM r)::BIGINT AS corrupted, (SELECT count(*) FROM r WHERE caught)::BIGINT AS caught, (SELECT count(*) FROM g)::BIGINT AS genuine, (SELECT count(*) FROM g WHERE contains(s, array_to_string(q, ' ')))::BIGINT AS kept"""
)
def stress_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"), F.array_join(tx.tokenize(F.col("text")), " ").alias("quote"))
    cases = b.withColumn("grounded", F.size(tx.tokenize(F.col("quote"))) >= 2)
    return gr.stress_test(cases, ["item_id"]).select("corrupted", "caught", "genuine", "kept")


_ROLL = "CASE WHEN bool_or((kind = 'exclusion' AND verdict = 'met') OR (kind <> 'exclusion' AND verdict = 'not_met')) THEN 'excluded' WHEN bool_or((kind = 'exclusion' AND verdict NOT IN ('met', 'not_met')) OR (kind <> 'exclusion' AND verdict NOT IN ('met', 'not_met'))) THEN 'cannot_determine' ELSE 'eligible' END"


@reg.add(f"WITH {_BASE} SELECT doc_id, {_ROLL} AS trial_verdict FROM {_ground_sql('aa')} GROUP BY doc_id")
def trial_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.rollup(gr.ground_assessments(_assessments(spark, sf_dir), patient_norm="patient_norm"), ["doc_id"])


_ARMS = f"""{_BASE}, ar AS (SELECT *, 'baseline' AS arm FROM {_ground_sql('aa')} UNION ALL SELECT *, 'verified' AS arm FROM {_ground_sql("(SELECT doc_id, pos, criterion, kind, verdict, criterion AS quote, source_norm, patient_norm FROM aa WHERE (doc_id + pos) % 5 > 0)")})"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _assessments(spark, sf_dir)
    base = gr.ground_assessments(a, patient_norm="patient_norm").withColumn("arm", F.lit("baseline"))
    again = a.where((F.col("doc_id") + F.col("pos")) % 5 > 0).withColumn("quote", F.col("criterion"))
    return base.unionByName(gr.ground_assessments(again, patient_norm="patient_norm").withColumn("arm", F.lit("verified")))


@reg.add(
    f"""WITH {_ARMS}, c AS (SELECT arm, coalesce(kind, 'all') AS kind, count(*)::BIGINT AS n_criteria, count(*) FILTER (verdict IN ('met', 'not_met') OR gf)::BIGINT AS d, count(*) FILTER (verdict IN ('met', 'not_met'))::BIGINT AS g, count(*) FILTER (verdict IN ('cannot_determine', 'unverifiable'))::BIGINT AS a
      FROM ar GROUP BY GROUPING SETS ((arm), (arm, kind)))
    SELECT arm, kind, n_criteria, d AS decisive_attempts, g AS grounded, a AS abstained, round(g / d, 6) AS citation_precision, round(1 - g / d, 6) AS unsupported_verdict_rate, round(g / n_criteria, 6) AS coverage, round(a / n_criteria, 6) AS abstention_rate FROM c"""
)
def arm_metrics_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = am.arm_metrics(_arms(spark, sf_dir))
    rates = ["citation_precision", "unsupported_verdict_rate", "coverage", "abstention_rate"]
    return m.select(*[c for c in m.columns if c not in rates], *[F.round(c, 6).alias(c) for c in rates])


@reg.add(
    f"""WITH {_BASE}, w AS (SELECT m, verdict, gf FROM (VALUES (1), (2), (3), (4)) AS v(m), LATERAL (SELECT 1) AS z, {_ground_sql("(SELECT aa.*, mm AS mt FROM aa, (VALUES (1), (2), (3), (4)) AS t(mm))", "mt")} AS g WHERE g.mt = m)
    SELECT m::INTEGER AS min_tokens, round(count(*) FILTER (verdict IN ('met', 'not_met')) / count(*), 6) AS coverage, round(count(*) FILTER (verdict IN ('met', 'not_met')) / count(*) FILTER (verdict IN ('met', 'not_met') OR gf), 6) AS citation_precision, count(*)::BIGINT AS n_criteria FROM w GROUP BY m"""
)
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = am.coverage_curve(_assessments(spark, sf_dir))
    return c.select("min_tokens", F.round("coverage", 6).alias("coverage"), F.round("citation_precision", 6).alias("citation_precision"), "n_criteria")


@reg.add(
    f"""WITH {_ARMS}, e AS (SELECT arm, doc_id % 50 AS trial_id, doc_id AS seq, count(*) FILTER (verdict IN ('met', 'not_met') OR gf) AS d, count(*) FILTER (gf) AS u FROM ar GROUP BY ALL
    ), l AS (SELECT arm, trial_id, arg_max(d, seq) AS d, arg_max(u, seq) AS u FROM e WHERE NOT (arm = 'verified' AND trial_id % 7 = 0) GROUP BY ALL)
    SELECT count(*)::BIGINT AS matched_trials, sum(b.u)::BIGINT AS b_uns, sum(b.d - b.u)::BIGINT AS b_grd, sum(v.u)::BIGINT AS v_uns, sum(v.d - v.u)::BIGINT AS v_grd FROM l b JOIN l v USING (trial_id) WHERE b.arm = 'baseline' AND v.arm = 'verified'"""
)
def matched_ab_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arms(spark, sf_dir).withColumns({"trial_id": F.col("doc_id") % 50, "patient_seq": F.col("doc_id")})
    t = am.per_trial(a).where("not (arm = 'verified' and trial_id % 7 = 0)")
    return am.matched_table(t)


_LOGP = "lgamma(r1 + 1) - lgamma({x} + 1) - lgamma(r1 - {x} + 1) + lgamma(r2 + 1) - lgamma(c1 - {x} + 1) - lgamma(r2 - c1 + {x} + 1) - lgamma(r1 + r2 + 1) + lgamma(c1 + 1) + lgamma(r1 + r2 - c1 + 1)"


@reg.add(
    f"""WITH {_ARMS}, e AS (SELECT arm, doc_id % 50 AS trial_id, doc_id AS seq, count(*) FILTER (verdict IN ('met', 'not_met') OR gf) AS d, count(*) FILTER (gf) AS u FROM ar GROUP BY ALL
    ), l AS (SELECT arm, trial_id, arg_max(d, seq) AS d, arg_max(u, seq) AS u FROM e GROUP BY ALL
    ), m AS (SELECT count(*) AS n, sum(b.u)::DOUBLE AS a, sum(b.d - b.u)::DOUBLE AS b, sum(v.u)::DOUBLE AS c, sum(v.d - v.u)::DOUBLE AS d FROM l b JOIN l v USING (trial_id) WHERE b.arm = 'baseline' AND v.arm = 'verified'
    ), t AS (SELECT *, a + b AS r1, c + d AS r2, a + c AS c1 FROM m
    ), p AS (SELECT sum(exp({_LOGP.format(x="x")})) FILTER ({_LOGP.format(x="x")} <= {_LOGP.format(x="a")} + 1e-7) AS p FROM t, unnest(generate_series(greatest(0, c1 - r2)::BIGINT, least(r1, c1)::BIGINT)) AS g(x))
    SELECT n::BIGINT AS matched_trials, round(a / r1, 4) AS baseline_unsupported_rate, round(c / r2, 4) AS verified_unsupported_rate, round((c / r2 - a / r1) / (a / r1), 4) AS relative_change, round(a * d / (b * c), 4) AS odds_ratio, round(least(1.0, p), 4)::DOUBLE AS fisher_p, p < 0.05 AS significant_05 FROM t, p"""
)
def matched_ab_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched table's odds ratio and Fisher p, on its one row."""
    a = _arms(spark, sf_dir).withColumns({"trial_id": F.col("doc_id") % 50, "patient_seq": F.col("doc_id")})
    r = am.matched_ab(am.per_trial(a))
    return spark.createDataFrame([tuple(r.values())], "matched_trials long, baseline_unsupported_rate double, verified_unsupported_rate double, relative_change double, odds_ratio double, fisher_p double, significant_05 boolean")


@reg.add(
    """WITH l AS (SELECT doc_id % 40 AS patient_id, doc_id AS nct_id, doc_id AS seq, CASE WHEN quality = 1 AND toxic = 0 THEN 'eligible' WHEN quality = 1 THEN 'excluded' ELSE 'irrelevant' END AS label FROM labels
    ), k AS (SELECT l.*, len(string_split(text, chr(10))) - 1 AS nc, row_number() OVER (PARTITION BY patient_id, label ORDER BY seq) AS n FROM l JOIN documents d ON d.doc_id = l.nct_id WHERE label IN ('eligible', 'excluded')
    ), f AS (SELECT patient_id FROM k WHERE n <= 1 GROUP BY 1 HAVING count(*) FILTER (label = 'eligible') >= 1 AND count(*) FILTER (label = 'excluded') >= 1
    ), u AS (SELECT k.* FROM k SEMI JOIN f USING (patient_id) WHERE n <= 1 AND nc > 0
    ), c AS (SELECT patient_id FROM (SELECT DISTINCT u.patient_id, s.fs FROM u JOIN (SELECT patient_id, min(seq) AS fs FROM l GROUP BY 1) s USING (patient_id)) ORDER BY fs LIMIT 10)
    SELECT patient_id, nct_id, label AS gold, n::INTEGER AS n FROM u SEMI JOIN c USING (patient_id)"""
)
def subset_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "eligible").when(F.col("quality") == 1, "excluded").otherwise("irrelevant")
    labels = l.select((F.col("doc_id") % 40).alias("patient_id"), F.col("doc_id").alias("nct_id"), F.col("doc_id").alias("seq"), label.alias("label"))
    trials = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nct_id"), (F.size(F.split("text", "\n")) - 1).alias("n_criteria"))
    return am.build_subset(labels, trials, 10, 1)


# Prompts are documents: every fifth is not in the code, every seventh not registered, every third's registered text is another.
_PROMPTS = """p AS (SELECT 'v' || doc_id AS version, substr(sha256(text), 1, 16) AS h FROM documents WHERE doc_id % 5 <> 0
), g AS (SELECT 'v' || doc_id AS version, doc_id % 2 = 0 AS frozen, substr(sha256(CASE WHEN doc_id % 3 = 0 THEN lang ELSE text END), 1, 16) AS sha16 FROM documents WHERE doc_id % 7 <> 0
), vi AS (SELECT version, CASE WHEN frozen IS NULL THEN 'unregistered' WHEN h IS NULL THEN 'missing' WHEN frozen AND h <> sha16 THEN 'drifted' END AS violation FROM p FULL JOIN g USING (version))"""


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    version = F.concat(F.lit("v"), n).alias("version")
    body = F.when(n % 3 == 0, F.col("lang")).otherwise(F.col("text"))
    registry = d.where("doc_id % 7 <> 0").select(version, (n % 2 == 0).alias("frozen"), F.substring(F.sha2(body.cast("binary"), 256), 1, 16).alias("sha16"))
    return am.registry_violations(d.where("doc_id % 5 <> 0").select(version, F.col("text").alias("body")), registry)


@reg.add(f"WITH {_PROMPTS} SELECT version, violation FROM vi WHERE violation IS NOT NULL")
def prompt_registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir)


_THRESHOLDS = [("catch_rate", ">=", 1.0), ("false_rejection_rate", "<=", 0.0), ("registry", ">=", 1.0), ("share.click", ">=", 0.15), ("share.view", "<=", 0.15), ("share.error", "==", 0.25)]


@reg.add(
    f"""WITH {_PROMPTS}, st AS ({reg.oracles["stress_test"]}), v AS (SELECT 'catch_rate' AS metric, CASE WHEN corrupted > 0 THEN caught / corrupted::DOUBLE ELSE 1 END AS value FROM st UNION ALL SELECT 'false_rejection_rate', CASE WHEN genuine > 0 THEN 1 - kept / genuine::DOUBLE ELSE 0 END FROM st
    UNION ALL SELECT 'registry', (count(violation) = 0)::INTEGER::DOUBLE FROM vi UNION ALL SELECT 'share.' || event_type, count(*) / (SELECT count(*) FROM events)::DOUBLE FROM events GROUP BY 1
    ), t AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{op}', {x}::DOUBLE)" for m, op, x in _THRESHOLDS)}) AS t(metric, op, threshold))
    SELECT metric, op, threshold, round(value, 4) AS value, CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold ELSE value = threshold END AS passed FROM t JOIN v USING (metric)"""
)
def gate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds held against the stress test, the prompt registry, and a JSON report of event shares."""
    words = tx.tokenize(F.col("text"))
    cases = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("source"), F.array_join(words, " ").alias("quote"), (F.size(words) >= 2).alias("grounded"))
    stress = am.scores_table(gr.stress_test(cases, ["item_id"]), ["catch_rate", "false_rejection_rate"]).select(F.col("name").alias("metric"), "value")
    registry = _violations(spark, sf_dir).agg((F.count(F.lit(1)) == 0).cast("double").alias("value")).select(F.lit("registry").alias("metric"), "value")
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    shares = e.crossJoin(F.broadcast(e.agg(F.sum("n").alias("all")))).select("event_type", (F.col("n") / F.col("all")).alias("x"))
    report = shares.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("event_type", "x"))).alias("share"))).alias("report"))
    paths = [m for m, _, _ in _THRESHOLDS if "." in m]
    long = report.select(F.explode(F.array(*[F.struct(F.lit(p).alias("metric"), am.dotted(F.col("report"), p).alias("value")) for p in paths])).alias("x")).select("x.*")
    return am.gate(spark.createDataFrame(_THRESHOLDS, "metric string, op string, threshold double"), stress, registry, long)


@reg.add(
    f"""WITH {_BASE}, t0 AS (SELECT g.*, 0 AS attempt FROM {_ground_sql('aa')} AS g
    ), f0 AS (SELECT DISTINCT doc_id FROM t0 WHERE gf
    ), t1 AS (SELECT g.*, 1 AS attempt FROM {_ground_sql("(SELECT doc_id, pos, criterion, kind, verdict, CASE WHEN doc_id % 3 = 0 THEN quote ELSE criterion END AS quote, source_norm, patient_norm FROM aa SEMI JOIN f0 USING (doc_id))")} AS g
    ), f1 AS (SELECT DISTINCT doc_id FROM t1 WHERE gf
    ), t2 AS (SELECT g.*, 2 AS attempt FROM {_ground_sql("(SELECT aa.* FROM aa SEMI JOIN f1 USING (doc_id))")} AS g
    ), a AS (SELECT * FROM t0 ANTI JOIN f0 USING (doc_id) UNION ALL SELECT * FROM t1 ANTI JOIN f1 USING (doc_id) UNION ALL SELECT * FROM t2)
    SELECT doc_id, max(attempt)::INTEGER AS retries, {_ROLL} AS trial_verdict, count(*) FILTER (gf)::BIGINT AS failures FROM a GROUP BY doc_id"""
)
def bounded_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing documents are labelled again: the second answer quotes right except for every third, whose third is as the first."""
    pairs = cut(_sources(spark, sf_dir).dropDuplicates(["doc_id"]))

    def label(todo: DataFrame, attempt: int) -> DataFrame:
        again = _answered(todo.drop("failed"))
        return again.withColumn("quote", F.when(F.col("doc_id") % 3 == 0, F.col("quote")).otherwise(F.col("criterion"))) if attempt == 1 else again

    # only what is asked of a pass is kept of it
    done = gr.bounded_retry(pairs, label, ["doc_id"], cut=lambda df: cut(df.select("doc_id", "pos", "criterion", "kind", "verdict", "grounding_failure", "attempt")))
    return done.groupBy("doc_id").agg(F.max("attempt").alias("retries"), gr.verdict_of().alias("trial_verdict"), F.count_if("grounding_failure").alias("failures"))
