"""Assessing retrieved trials for many notes in one job: labelling chain, verdicts, and the events of a job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions.money import estimate_tokens
from groundwell.functions.text import analyst_cache_key, is_blank, normalize, parse_keywords, retry_note, user_prompt
from groundwell.operators.criteria import MAX_CRITERIA, attach_kinds, build_typed_criteria, parse_answer
from groundwell.operators.grounding import bounded_retry, rollup
from groundwell.operators.ledger import budget_breaker
from groundwell.operators.lineage import cut
from groundwell.operators.models import label
from groundwell.operators.retrieve import generate_keywords, keyword_misses
from groundwell.operators.sizing import broadcast_if_small
from groundwell.operators.stateful import take_until_breach

#: Tokens that an answer may take, on top of the prompt's.
ANSWER_TOKENS = 4096
BUDGET = "budget_exhausted"


def admitted(notes: DataFrame, note: str = "note") -> DataFrame:
    """Notes that are not blank."""
    return notes.where(~is_blank(F.col(note)))


def flag_candidates(hits: DataFrame, trials: DataFrame, most: int = MAX_CRITERIA) -> DataFrame:
    """Hits (query_id, doc_id, ...) with their trials and typed criteria, and ``error``: ``not_found``, ``no_criteria`` or null.

    Callers that show no errors drop the flagged rows, as the batch form does.
    """
    typed = build_typed_criteria(trials.withColumn("__found", F.lit(True)), most)
    joined = hits.join(typed.withColumnRenamed("nct_id", "doc_id"), "doc_id", "left")
    error = F.when(F.col("__found").isNull(), "not_found").when(F.size("criteria") == 0, "no_criteria")
    return joined.withColumn("error", error).drop("__found")


def with_cache_policy(notes: DataFrame, presets: DataFrame, note: str = "note") -> DataFrame:
    """Adds ``skip_cache_write``: answers to notes that are no preset (compared without their edges) are not kept."""
    known = broadcast_if_small(presets.select(F.btrim(note, F.lit(" \t\n\r")).alias("__p")).distinct().withColumn("__known", F.lit(True)))
    return notes.join(known, F.btrim(F.col(note), F.lit(" \t\n\r")) == F.col("__p"), "left").withColumn("skip_cache_write", F.col("__known").isNull()).drop("__p", "__known")


def cached_only(items: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """Items whose answer is already kept."""
    return items.join(cached.select(key).distinct(), key, "left_semi")


@dataclass
class Policy:
    """Who is asked, with which prompt, and what may still be spent today."""

    labeller: str
    system: str
    version: str = "v4"
    provider: str = "deepinfra"
    model: str = "m"
    usd_in: float = 0.0
    usd_left: float = 2.0
    tokens_left: int | None = None


@dataclass
class Labelled:
    """``answers`` (keys, assessments, error), ``usage`` of fresh calls, and the ``writes`` (key, assessments) that the cache takes."""

    answers: DataFrame
    usage: DataFrame
    writes: DataFrame


def label_pairs(pairs: DataFrame, cached: DataFrame, policy: Policy, keys: tuple[str, ...] = ("query_id", "doc_id")) -> Labelled:
    """Answers to pairs (keys, seq, note, criteria, skip_cache_write): kept ones first, fresh ones while the budget lasts.

    Calls are gated in the order of ``seq`` on an estimate, the prompt and the
    longest answer; from the first that does not fit on all have the error
    ``budget_exhausted``. Usage is billed on what the model reports. One budget
    is one running sum, so the gate, though not the calls, is one task's.
    """
    p = policy
    key = analyst_cache_key(F.lit(p.version), F.lit(p.provider), F.lit(p.model), F.col("doc_id").cast("string"), F.col("note"))
    asked = pairs.withColumn("key", key).join(cached.select("key", F.col("assessments").alias("__kept")), "key", "left")
    kept = asked.where("__kept is not null").select(*keys, F.col("__kept").alias("assessments"), F.lit(None).cast("string").alias("error"))
    prompt = user_prompt(F.col("note"), F.col("doc_id").cast("string"), F.col("criteria"), p.version)
    todo = asked.where("__kept is null").select(*keys, "seq", "key", "skip_cache_write", F.lit(p.system).alias("system"), prompt.alias("user"))
    cost = todo.withColumn("tokens", estimate_tokens(F.concat("system", "user")) + ANSWER_TOKENS).withColumn("usd", F.col("tokens") * p.usd_in / 1e6).withColumn("account", F.lit(p.provider))
    gated = budget_breaker(cost, p.usd_left, p.tokens_left, ("account",)).drop("account", "usd", "tokens")
    made = cut(label(gated.where("allowed").drop("allowed"), p.labeller))
    refused = gated.where("not allowed").select(*keys, F.array().cast("array<struct<criterion:string,verdict:string,quote:string,rationale:string>>").alias("assessments"), F.lit(BUDGET).alias("error"))
    fresh = parse_answer(made.withColumn("raw", F.coalesce("raw", F.lit(""))))
    answers = kept.unionByName(fresh.select(*keys, "assessments", "error")).unionByName(refused)
    usage = made.where("error is null").select(*keys, F.lit(p.provider).alias("provider"), F.lit(p.model).alias("model"), "served_model", "in_tokens", "out_tokens", "provider_usd")
    writes = fresh.where("error is null and not skip_cache_write").select("key", "assessments")
    return Labelled(answers, usage, writes)


class BudgetExhausted(RuntimeError):
    """The day's budget does not leave room for all that is asked."""


def expand_keywords(notes: DataFrame, disk: DataFrame, store: DataFrame, policy: Policy, n_max: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keywords of every note (:func:`generate_keywords`), the usage of fresh calls, and the (query_id, keywords) that the store takes.

    Only notes that neither the disk nor the store answers reach the model; an
    answer that fails or is no JSON leaves the note itself as keyword. A spent
    budget is raised before any call instead, so that no note passes for a keyword.
    """
    seq = F.row_number().over(Window.partitionBy("account").orderBy("query_id"))
    todo = keyword_misses(notes, disk, store).select("query_id", F.lit(policy.system).alias("system"), F.col("text").alias("user"), F.lit(policy.provider).alias("account"))
    cost = todo.withColumn("seq", seq).withColumn("tokens", estimate_tokens(F.concat("system", "user")) + ANSWER_TOKENS).withColumn("usd", F.col("tokens") * policy.usd_in / 1e6)
    gated = cut(budget_breaker(cost, policy.usd_left, policy.tokens_left, ("account",)))
    if not gated.where("not allowed").isEmpty():
        raise BudgetExhausted(f"{gated.where('not allowed').count()} of {gated.count()} notes are beyond the budget")
    made = cut(label(gated.select("query_id", "system", "user"), policy.labeller))
    fresh = made.select("query_id", F.when(F.col("error").isNull(), parse_keywords(F.coalesce("raw", F.lit("")), n_max)).alias("keywords")).where(F.size("keywords") > 0)
    usage = made.where("error is null").select("query_id", F.lit(policy.provider).alias("provider"), F.lit(policy.model).alias("model"), "served_model", "in_tokens", "out_tokens", "provider_usd")
    return generate_keywords(notes, disk, store, fresh, n_max), usage, fresh


def assess(
    candidates: DataFrame, answer: Callable[[DataFrame, int], DataFrame], max_retries: int = 2, keys: tuple[str, ...] = ("query_id", "doc_id")
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, assessments) of flagged candidates that have ``note`` and ``eligibility_raw``.

    ``answer(pairs, attempt)`` gives (keys, assessments, error) for pairs whose
    ``note`` from the second attempt on names what failed and quotes the source.
    A pair that has an error, flagged or answered, or no criterion answered,
    cannot be determined; it leaves the others alone.
    """
    ready = cut(candidates.where("error is null").withColumn("source_norm", normalize(F.concat_ws("\n", "note", "eligibility_raw"))).withColumn("patient_norm", normalize(F.col("note"))))
    criteria = ready.select(*keys, F.posexplode("criteria").alias("pos", "c")).select(*keys, "pos", "c.text", "c.kind")
    errors: list[DataFrame] = []

    def attempt(todo: DataFrame, n: int) -> DataFrame:
        note = F.col("note") if n == 0 else retry_note(F.col("note"), F.lit(n), F.col("failed"), F.col("eligibility_raw"))
        said = cut(answer(todo.withColumn("note", note).drop("failed"), n))
        errors.append(said.where("error is not null").select(*keys, F.col("error").alias("__error")))
        each = said.where("error is null").select(*keys, F.posexplode("assessments").alias("pos", "a")).select(*keys, "pos", "a.criterion", "a.verdict", "a.quote", "a.rationale")
        return attach_kinds(each, criteria, [*keys])

    done = cut(bounded_retry(ready, attempt, [*keys], max_retries, cut))
    failed = errors[0]
    for more in errors[1:]:
        failed = failed.unionByName(more)
    failed = failed.groupBy(*keys).agg(F.max("__error").alias("__error"))
    verdicts = candidates.drop("error").join(candidates.select(*keys, F.col("error").alias("__flag")), [*keys]).join(failed, [*keys], "left").join(rollup(done, [*keys], candidates), [*keys])
    out = verdicts.withColumn("error", F.coalesce("__flag", "__error"))
    return out.withColumn("trial_verdict", F.when(F.col("error").isNull(), F.col("trial_verdict")).otherwise("cannot_determine")).drop("__flag", "__error"), done


def assess_notes(hits: DataFrame, notes: DataFrame, trials: DataFrame, cached: DataFrame, policy: Policy, max_retries: int = 2) -> tuple[DataFrame, DataFrame, list[Labelled]]:
    """Retrieved hits (query_id, doc_id, score, rank) of admitted notes (query_id, note) to verdicts, assessments and what labelling did."""
    known = notes if "skip_cache_write" in notes.columns else notes.withColumn("skip_cache_write", F.lit(False))
    flagged = cut(flag_candidates(hits, trials).join(admitted(known).select("query_id", "note", "skip_cache_write"), "query_id"))
    runs: list[Labelled] = []

    def answer(pairs: DataFrame, attempt: int) -> DataFrame:
        told = pairs.withColumn("seq", F.struct("query_id", "rank", "doc_id"))
        runs.append(label_pairs(told, cached, policy))
        return runs[-1].answers

    verdicts, done = assess(flagged, answer, max_retries)
    return verdicts, done, runs


def _payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def job_events(results: DataFrame, job: str = "job_id", pos: str = "pos") -> DataFrame:
    """(job_id, seq, type, payload): an event for each trial in order, then the summary; a spent budget ends the job with an error instead.

    ``results`` has ``job_id, pos, nct_id, trial_verdict, error``. Any other
    error is told in its trial's event and the job goes on.
    """
    kept = take_until_breach(results.withColumn("__ok", ~F.col("error").eqNullSafe(F.lit(BUDGET))), pos, [job], "__ok")
    trials = kept.select(job, F.col(pos).cast("long").alias("seq"), F.lit("trial").alias("type"), _payload(type=F.lit("trial"), nct_id=F.col("nct_id"), error=F.col("error"), trial_verdict=F.col("trial_verdict")).alias("payload"))
    ends = results.groupBy(job).agg(F.count(F.lit(1)).alias("n"), F.max(pos).alias("last"), F.min(F.when(F.col("error") == BUDGET, F.col(pos))).alias("broke"))
    broke = F.col("broke").isNotNull()
    last = F.when(broke, _payload(type=F.lit("error"), error=F.lit(BUDGET))).otherwise(_payload(type=F.lit("summary"), n_trials=F.col("n"), status=F.lit("done")))
    end = ends.select(job, F.when(broke, F.col("broke")).otherwise(F.col("last") + 1).cast("long").alias("seq"), F.when(broke, "error").otherwise("summary").alias("type"), last.alias("payload"))
    return trials.unionByName(end)
