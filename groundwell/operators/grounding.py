"""Evidence checks as column expressions: no user function, one normalisation of each source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import absence_terms, content_tokens, normalize, normalized_tokens, replace_token, sentinel
from groundwell.operators.sizing import broadcast_blocks

MIN_TOKENS = 2


def is_grounded(quote: Column, source_norm: Column, min_tokens: int | Column = MIN_TOKENS) -> Column:
    """Normalised quote of ``min_tokens`` words or more, a substring of the normalised source."""
    q = normalize(F.coalesce(quote, F.lit("")))
    n = F.when(q == "", F.lit(0)).otherwise(F.size(F.split(q, " ")))
    return (n >= min_tokens) & F.contains(F.coalesce(source_norm, F.lit("")), q)


def is_absence_grounded(criterion: Column, note_norm: Column) -> Column:
    """Some distinctive terms, none of them anywhere in the normalised note."""
    terms = absence_terms(F.coalesce(criterion, F.lit("")))
    return (F.size(terms) > 0) & ~F.exists(terms, lambda t: F.contains(note_norm, t))


def ground_assessments(df: DataFrame, source_norm: str = "source_norm", patient_norm: str | None = None, min_tokens: int | Column = MIN_TOKENS) -> DataFrame:
    """Adds ``grounded, grounded_by, grounding_failure`` and turns ungrounded decisive verdicts into ``unverifiable``.

    Rows have ``criterion, kind, verdict, quote`` and normalised texts. Absence
    is tried for exclusions answered ``not_met`` when a patient text is there.
    """
    by_quote = is_grounded(F.col("quote"), F.col(source_norm), min_tokens)
    absent = F.lit(False)
    if patient_norm:
        asked = (F.col("verdict") == "not_met") & (F.col("kind") == "exclusion") & F.col(patient_norm).isNotNull()
        absent = F.when(asked, is_absence_grounded(F.col("criterion"), F.col(patient_norm))).otherwise(F.lit(False))
    by = F.when(by_quote, "quote").when(absent, "absence")
    decisive = F.col("verdict").isin("met", "not_met")
    return (
        df.withColumn("grounded_by", by)
        .withColumn("grounded", F.col("grounded_by").isNotNull())
        .withColumn("grounding_failure", decisive & ~F.col("grounded"))
        .withColumn("verdict", F.when(F.col("grounding_failure"), "unverifiable").otherwise(F.col("verdict")))
    )


def with_sources(pairs: DataFrame, note: str = "note", source: str = "source_text") -> DataFrame:
    """Adds the normalised combined source and note, once a pair."""
    return pairs.withColumns({"source_norm": normalize(F.concat_ws("\n", note, source)), "patient_norm": normalize(F.col(note))})


#: Quotes that meet every source at once.
BLOCK_QUOTES = 10_000


def quote_hits(quotes: DataFrame, sources: DataFrame, min_tokens: int = MIN_TOKENS, block_quotes: int = BLOCK_QUOTES) -> DataFrame:
    """(item_id, doc_id) of the quotes (item_id, text) that are grounded in a source (doc_id, text).

    Any word of a quote but its first and last must be a whole word of the
    source, so its longest inner word is looked for among the source's words
    before the substring is; a source that has none of those words goes no
    further. Quotes of two words have no inner word and meet every source.
    Quotes go to every executor, ``block_quotes`` at a time.
    """
    words = F.split("qn", " ")
    asked = quotes.select("item_id", "text", normalize(F.coalesce("text", F.lit(""))).alias("qn")).where((F.col("qn") != "") & (F.size(words) >= min_tokens))
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2))
    probe = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    asked = asked.select("item_id", "text", probe.alias("probe"))
    told = sources.select("doc_id", normalize(F.coalesce("text", F.lit(""))).alias("sn"))
    out = []
    for block in broadcast_blocks(asked.where("probe is not null"), block_quotes):
        probes = [r[0] for r in block.select("probe").distinct().collect()]
        held = F.filter(F.split("sn", " "), lambda t: t.isin(probes)) if probes else F.array().cast("array<string>")
        # explode_outer: explode would have the words found once more, in an inferred filter
        met = told.select("doc_id", "sn", F.explode_outer(F.array_distinct(held)).alias("probe")).join(block, "probe")
        out.append(met.where(is_grounded(F.col("text"), F.col("sn"), min_tokens)).select("item_id", "doc_id"))
    for block in broadcast_blocks(asked.where("probe is null").select("item_id", "text"), block_quotes):
        out.append(told.crossJoin(block).where(is_grounded(F.col("text"), F.col("sn"), min_tokens)).select("item_id", "doc_id"))
    return reduce(DataFrame.unionByName, out)


def verdict_of(kind: str = "kind", verdict: str = "verdict") -> Column:
    """Aggregate of a trial's criteria: exclusions inverted, a hard exclude first, then anything unresolved; null rows are no criteria."""
    k, v = F.col(kind), F.col(verdict)
    bad, good = F.when(k == "exclusion", "met").otherwise("not_met"), F.when(k == "exclusion", "not_met").otherwise("met")
    hard, open_ = F.bool_or(v.eqNullSafe(bad)), F.bool_or(~v.eqNullSafe(bad) & ~v.eqNullSafe(good))
    return F.when(hard, "excluded").when(open_, "cannot_determine").otherwise("eligible")


def rollup(df: DataFrame, keys: list[str], trials: DataFrame | None = None) -> DataFrame:
    """(keys, trial_verdict) by :func:`verdict_of`; of ``trials`` those without a criterion cannot be determined."""
    said = df.groupBy(*keys).agg(verdict_of().alias("trial_verdict"))
    if trials is None:
        return said
    every = trials.select(*keys).distinct().join(said, keys, "left")
    return every.select(*keys, F.coalesce("trial_verdict", F.lit("cannot_determine")).alias("trial_verdict"))


def bounded_retry(pairs: DataFrame, label: Callable[[DataFrame, int], DataFrame], keys: list[str], max_retries: int = 2, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every pair's latest attempt, grounded, with ``attempt``: pairs with a failure are labelled again, at most ``max_retries`` times.

    ``label(pairs, attempt)`` gives ``keys, pos, criterion, kind, verdict, quote``;
    pairs have ``keys, source_norm, patient_norm`` and, from the second attempt
    on, ``failed``: the last attempt's ungrounded criteria in order. Answers that
    carry their pair's two texts along need no join. A retry replaces all of a
    pair's criteria. ``cut`` materialises a pass so that no pass is labelled twice.
    """
    todo, done = pairs, None
    for attempt in range(max_retries + 1):
        answers = label(todo, attempt)
        carried = {"source_norm", "patient_norm"} <= {*answers.columns}
        told = answers if carried else answers.join(todo.select(*keys, "source_norm", "patient_norm"), keys)
        out = ground_assessments(told, patient_norm="patient_norm").withColumn("attempt", F.lit(attempt)).drop("source_norm", "patient_norm")
        out = cut(out) if cut else out
        kept = out
        if attempt < max_retries:
            named = F.transform(F.array_sort(F.collect_list(F.struct("pos", "criterion"))), lambda x: x["criterion"])
            failed = out.where("grounding_failure").groupBy(*keys).agg(named.alias("failed"))
            kept = out.join(failed, keys, "left_anti")
            todo = todo.drop("failed").join(failed, keys)
        done = kept if done is None else done.unionByName(kept)
    return done


def stress_cases(cases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, caught) for every content word of every grounded quote, swapped for a word the source lacks."""
    c = cases.where("grounded").withColumns({"s": normalize(F.col("source")), "q": normalized_tokens(F.col("quote"))})
    each = c.select(*keys, "s", "q", F.posexplode(content_tokens(F.col("quote"))).alias("pos", "tok"))
    spoiled = replace_token(F.col("q"), F.col("tok"), sentinel(F.col("s"), F.col("pos")))
    return each.select(*keys, "pos", (~is_grounded(spoiled, F.col("s"))).alias("caught"))


def stress_test(cases: DataFrame, keys: list[str]) -> DataFrame:
    """One row: corruptions, caught, catch rate; genuine quotes, kept, false rejection rate."""
    bad = stress_cases(cases, keys).agg(F.count(F.lit(1)).alias("corrupted"), F.coalesce(F.sum(F.col("caught").cast("long")), F.lit(0)).alias("caught"))
    ok = is_grounded(F.col("quote"), normalize(F.col("source")))
    good = cases.where("grounded").agg(F.count(F.lit(1)).alias("genuine"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("kept"))
    rate = lambda x, n, empty: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(empty)
    both = bad.crossJoin(good)
    return both.withColumns({"catch_rate": rate("caught", "corrupted", 1.0), "false_rejection_rate": F.when(F.col("genuine") > 0, 1 - F.col("kept") / F.nullif(F.col("genuine"), F.lit(0))).otherwise(0.0)})
