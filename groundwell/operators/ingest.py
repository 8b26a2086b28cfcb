"""Bringing trials into the store: those not yet embedded are normalised, encoded and merged in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import document_text
from groundwell.operators.cdc import resume
from groundwell.operators.criteria import normalise_trials
from groundwell.operators.models import encode
from groundwell.schema import TRIAL, conform
from groundwell.sources.sinks import VersionedTable


def ingest(fetched: DataFrame, store: VersionedTable, source: str, encoder: str, exclusions: bool = False, batch: int = 32) -> int:
    """Merges fetched trials (nct_id, title, eligibility_raw, ...) of a source and gives how many were new to it.

    Partitions are encoded by themselves, so there is no batching to steer, and
    a job that is run again takes up what it had not stored.
    """
    stored = store.read()
    todo = resume(fetched.dropDuplicates(["nct_id"]), stored, "nct_id") if stored is not None else fetched.dropDuplicates(["nct_id"])
    trials = normalise_trials(todo)
    text = document_text(F.col("title"), F.col("inclusion_criteria"), F.col("exclusion_criteria") if exclusions else None)
    embedded = encode(trials.withColumn("__text", text), "__text", encoder, batch=batch).drop("__text")
    rows = conform(embedded.withColumn("source", F.lit(source)).withColumn("ingested_at", F.current_timestamp()), TRIAL)
    return store.upsert(rows, ["nct_id"], "ingested_at")
