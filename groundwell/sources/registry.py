"""The registry as a Spark data source: pages pulled by a pluggable transport, with status and size limits pushed to it.

    spark.dataSource.register(RegistrySource)
    spark.read.format("trial_registry").option("transport", "my_module:fetch").load()

The transport is ``fetch(params: dict, **options) -> (http status, json dict)``;
options named ``transport.x`` reach it as ``x``. ``groundwell.sources.dump:fetch``
answers from a file. One search is one chain of pages, each with the token of
the next, so it is read by one task and ``max_trials`` ends it; with the option
``split`` every condition is a search of its own, and :func:`read_registry`
brings their trials together and cuts them to the limit.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from groundwell.schema import STUDY
from groundwell.sources.readers import flatten_study

# What the registry is asked for.
FIELDS = ("NCTId", "BriefTitle", "OverallStatus", "Phase", "Condition", "InterventionName", "EligibilityCriteria", "MinimumAge", "MaximumAge", "Sex", "HealthyVolunteers", "LastUpdatePostDate")
STATUSES = ("RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION")
CONDITIONS = ("cancer", "oncology", "tumor", "neoplasm")
MAX_TRIALS = 5000


class RegistryError(RuntimeError):
    """The registry answered with an error; what has been read of the search is not a whole answer."""


def pages(fetch: Callable[[dict], tuple[int, dict]], params: dict, most: int, delay_s: float = 0.0, retry_s: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Studies page by page, at most ``most``; a page refused as too many requests is asked for again, an empty one is the last."""
    token, given = None, 0
    while given < most:
        status, body = fetch(params | ({"pageToken": token} if token else {}))
        if status == 429:
            sleep(retry_s)
            continue
        if not 200 <= status < 300:
            raise RegistryError(f"status {status} after {given} studies")
        studies = body.get("studies") or []
        if not studies:
            return
        for study in studies:
            if ((study.get("protocolSection") or {}).get("identificationModule") or {}).get("nctId"):
                yield study
                given += 1
                if given >= most:
                    return
        token = body.get("nextPageToken")
        if not token:
            return
        sleep(delay_s)


class RegistrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trial_registry"

    def schema(self) -> str:
        return "study string"

    def reader(self, schema) -> DataSourceReader:
        return RegistryReader(self.options)


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def conditions(self) -> list[str]:
        return [c.strip() for c in self.options.get("conditions", ",".join(CONDITIONS)).split(",") if c.strip()]

    def params(self, condition: str) -> dict:
        return {
            "query.cond": condition,
            "filter.overallStatus": self.options.get("statuses", ",".join(STATUSES)),
            "pageSize": self.options.get("page_size", "100"),
            "format": "json",
            "fields": ",".join(FIELDS),
        }

    def partitions(self) -> list[InputPartition]:
        asked = self.conditions()
        split = self.options.get("split", "false").lower() == "true"
        return [InputPartition(c) for c in (asked if split else [" OR ".join(asked)])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        extra = {k.partition(".")[2]: v for k, v in self.options.items() if k.startswith("transport.")}
        found = pages(lambda p: fetch(p, **extra), self.params(partition.value), int(self.options.get("max_trials", MAX_TRIALS)), float(self.options.get("delay", "0")), float(self.options.get("retry", "10")))
        for study in found:
            yield (json.dumps(study),)


def read_registry(spark: SparkSession, **options: str) -> DataFrame:
    """Trials of a registry search, each once, ``max_trials`` at most over all conditions."""
    spark.dataSource.register(RegistrySource)
    raw = spark.read.format("trial_registry").options(**options).load()
    trials = flatten_study(raw.select(F.from_json("study", STUDY).alias("s")).select("s.*"))
    if str(options.get("split", "false")).lower() != "true":
        return trials
    return trials.dropDuplicates(["nct_id"]).limit(int(options.get("max_trials", MAX_TRIALS)))
