"""Arm metrics, strictness curve, matched A/B, subset building and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.stats import matched_summary
from groundwell.operators.grounding import ground_assessments


def _counts() -> list[Column]:
    v = F.col("verdict")
    kept, failed = v.isin("met", "not_met"), F.coalesce(F.col("grounding_failure"), F.lit(False))
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return [
        F.count(F.lit(1)).alias("n_criteria"),
        n(kept | (failed & ~kept), "decisive_attempts"),
        n(kept, "grounded"),
        n(v.isin("cannot_determine", "unverifiable"), "abstained"),
    ]


def _rate(x: str, n: str, empty: float = 0.0) -> Column:
    return F.when(F.col(n) > 0, F.col(x) / F.nullif(F.col(n), F.lit(0))).otherwise(F.lit(empty))


def arm_metrics(assessments: DataFrame, arm: str = "arm") -> DataFrame:
    """(arm, kind, ...) with kind ``all`` for the whole arm, by one grouping-sets pass.

    Without decisive attempts precision is 0 and the unsupported rate 1 for the
    whole arm but 0 for a kind.
    """
    sets = assessments.withColumn("kind", F.coalesce("kind", F.lit("inclusion"))).groupingSets([[arm], [arm, "kind"]], arm, "kind").agg(*_counts(), F.grouping("kind").alias("whole"))
    cp = _rate("grounded", "decisive_attempts")
    return sets.select(
        arm,
        F.when(F.col("whole") == 1, "all").otherwise(F.col("kind")).alias("kind"),
        "n_criteria",
        "decisive_attempts",
        "grounded",
        "abstained",
        cp.alias("citation_precision"),
        F.when((F.col("whole") == 0) & (F.col("decisive_attempts") == 0), 0.0).otherwise(1 - cp).alias("unsupported_verdict_rate"),
        _rate("grounded", "n_criteria").alias("coverage"),
        _rate("abstained", "n_criteria").alias("abstention_rate"),
    )


def trial_accuracy(verdicts: DataFrame, arm: str = "arm") -> DataFrame:
    """(arm, n_trials, trial_accuracy, mean_retries, trials_with_retry) from rows with ``trial_verdict, gold, retries``."""
    return verdicts.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg((F.col("trial_verdict") == F.col("gold")).cast("double")).alias("trial_accuracy"),
        F.avg("retries").alias("mean_retries"),
        F.sum((F.col("retries") > 0).cast("long")).alias("trials_with_retry"),
    )


def per_trial(assessments: DataFrame, arm: str = "arm", trial: str = "trial_id", seq: str = "patient_seq") -> DataFrame:
    """(arm, trial, decisive, unsupported): a trial met by several patients counts as the last one left it."""
    v = F.col("verdict")
    dec = v.isin("met", "not_met") | F.coalesce(F.col("grounding_failure"), F.lit(False))
    uns = ~v.isin("met", "not_met") & F.coalesce(F.col("grounding_failure"), F.lit(False))
    each = assessments.groupBy(arm, trial, seq).agg(F.sum(dec.cast("long")).alias("decisive"), F.sum(uns.cast("long")).alias("unsupported"))
    return each.groupBy(arm, trial).agg(F.max_by(F.struct("decisive", "unsupported"), seq).alias("x")).select(arm, trial, "x.decisive", "x.unsupported")


def matched_table(trials: DataFrame, trial: str = "trial_id", baseline: str = "baseline", verified: str = "verified") -> DataFrame:
    """One row: matched trials and the 2x2 cells over trials that both arms completed."""
    b = trials.where(F.col("arm") == baseline).select(trial, F.col("decisive").alias("bd"), F.col("unsupported").alias("bu"))
    v = trials.where(F.col("arm") == verified).select(trial, F.col("decisive").alias("vd"), F.col("unsupported").alias("vu"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return b.join(v, trial).agg(
        F.count(F.lit(1)).alias("matched_trials"), s("bu").alias("b_uns"), s(F.col("bd") - F.col("bu")).alias("b_grd"), s("vu").alias("v_uns"), s(F.col("vd") - F.col("vu")).alias("v_grd")
    )


def matched_ab(trials: DataFrame, trial: str = "trial_id") -> dict:
    """The matched report: Spark sums the cells, Fisher's test runs on that one row."""
    r = matched_table(trials, trial).first()
    return matched_summary(*(int(r[c]) for c in ("matched_trials", "b_uns", "b_grd", "v_uns", "v_grd")))


def coverage_curve(raw: DataFrame, min_tokens: list[int] = [1, 2, 3, 4], patient_norm: str | None = "patient_norm") -> DataFrame:  # noqa: B006
    """(min_tokens, coverage, citation_precision, n_criteria) of labels grounded anew at each strictness."""
    swept = raw.withColumn("min_tokens", F.explode(F.array(*[F.lit(m) for m in min_tokens])))
    done = ground_assessments(swept, patient_norm=patient_norm, min_tokens=F.col("min_tokens"))
    return done.groupBy("min_tokens").agg(*_counts()).select("min_tokens", _rate("grounded", "n_criteria").alias("coverage"), _rate("grounded", "decisive_attempts").alias("citation_precision"), "n_criteria")


def build_subset(labels: DataFrame, trials: DataFrame, n_patients: int, per_class: int) -> DataFrame:
    """(patient_id, nct_id, gold, n): patients with enough eligible and excluded in-corpus trials, first ones in label order.

    ``labels`` has ``seq``; ``trials`` has ``nct_id, n_criteria``. Trials without criteria go after the picking.
    """
    known = labels.where(F.col("label").isin("eligible", "excluded")).join(trials, "nct_id")
    w = Window.partitionBy("patient_id", "label").orderBy("seq")
    picked = known.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_class)
    full = picked.groupBy("patient_id").agg(F.count_if(F.col("label") == "eligible").alias("e"), F.count_if(F.col("label") == "excluded").alias("x")).where(f"e >= {per_class} and x >= {per_class}")
    seen = labels.groupBy("patient_id").agg(F.min("seq").alias("first_seq"))
    useful = picked.where("n_criteria > 0").join(full.select("patient_id"), "patient_id", "left_semi").join(seen, "patient_id")
    chosen = useful.select("patient_id", "first_seq").distinct().orderBy("first_seq").limit(n_patients)
    return useful.join(chosen.select("patient_id"), "patient_id", "left_semi").select("patient_id", "nct_id", F.col("label").alias("gold"), "n")


def passes(value: Column, op: Column, threshold: Column) -> Column:
    return (
        F.when(op == ">=", value >= threshold)
        .when(op == "<=", value <= threshold)
        .when(op == "==", value == threshold)
        .otherwise(F.raise_error(F.concat(F.lit("unknown op "), op)).cast("boolean"))
    )


def gate(thresholds: DataFrame, stress: DataFrame, registry: DataFrame, report: DataFrame) -> DataFrame:
    """(metric, op, threshold, value, passed): a metric is looked up in stress, then registry, then the report.

    All four inputs are long-form (metric, value); values compare unrounded.
    """
    named = lambda df, n: df.select("metric", F.col("value").alias(n))
    t = thresholds.join(named(stress, "s"), "metric", "left").join(named(registry, "r"), "metric", "left").join(named(report, "p"), "metric", "left")
    value = F.coalesce("s", "r", "p")
    return t.select("metric", "op", "threshold", F.round(value, 4).alias("value"), passes(value, F.col("op"), F.col("threshold")).alias("passed"))


def gate_passed(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def dotted(report: Column, path: str) -> Column:
    """A number by its dotted path in a JSON report."""
    return F.get_json_object(report, f"$.{path}").cast("double")


def registry_violations(prompts: DataFrame, registry: DataFrame) -> DataFrame:
    """(version, violation): unregistered prompts, registered ones without text, frozen ones whose hash drifted.

    ``prompts`` has ``version, body``; ``registry`` has ``version, frozen, sha16``.
    """
    p = prompts.select("version", F.substring(F.sha2(F.col("body").cast("binary"), 256), 1, 16).alias("h"))
    j = p.join(registry, "version", "full_outer")
    why = F.when(F.col("frozen").isNull(), "unregistered").when(F.col("h").isNull(), "missing").when(F.col("frozen") & (F.col("h") != F.col("sha16")), "drifted")
    return j.select("version", why.alias("violation")).where("violation is not null")


def scores_table(row: DataFrame, names: list[str]) -> DataFrame:
    """(name, value, text, data_type): numbers as NUMERIC, strings as CATEGORICAL."""
    kinds = dict(row.dtypes)
    one = lambda n: F.struct(F.lit(n).alias("name"), (F.lit(None) if kinds[n] == "string" else F.col(n)).cast("double").alias("value"), (F.col(n) if kinds[n] == "string" else F.lit(None)).cast("string").alias("text"), F.lit("CATEGORICAL" if kinds[n] == "string" else "NUMERIC").alias("data_type"))
    return row.select(F.explode(F.array(*[one(n) for n in names])).alias("s")).select("s.*")


#: Scores of an arm that are sent to the observer.
OBSERVED = ["citation_precision", "unsupported_verdict_rate", "coverage", "abstention_rate", "trial_accuracy"]


def observability(arm: DataFrame, ledger_before: DataFrame | None = None, ledger_after: DataFrame | None = None) -> DataFrame:
    """Score rows (:func:`scores_table`) of one arm's row, with ``run_usd``, what the ledger (usd) grew by, where both its states are given."""
    if ledger_before is not None and ledger_after is not None:
        total = lambda d, n: d.agg(F.coalesce(F.sum("usd"), F.lit(0)).cast("double").alias(n))
        arm = arm.crossJoin(total(ledger_before, "__b")).crossJoin(total(ledger_after, "__a")).withColumn("run_usd", F.round(F.col("__a") - F.col("__b"), 8)).drop("__a", "__b")
    return scores_table(arm, [c for c in [*OBSERVED, "run_usd"] if c in arm.columns])
