"""Ledger, merges, refresh guard, limiter, jobs, streams and sources."""

from __future__ import annotations

import datetime as dt
import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from groundwell.functions import money
from groundwell.functions.stats import fisher_exact, matched_summary
from groundwell.operators import arm_metrics as am
from groundwell.operators import cdc, ledger, stateful
from groundwell.sources import readers, registry, sinks
from groundwell.sources.sinks import VersionedTable


@pytest.mark.parametrize(("cells", "odds", "p"), [((37, 361, 10, 332), 3.4028, 0.0004), ((9, 115, 1, 118), 9.2348, 0.0193), ((77, 439, 49, 454), 1.6251, 0.0132), ((123, 873, 80, 871), 1.534, 0.0048)])
def test_published_tables(cells, odds, p):
    got = fisher_exact(*cells)
    assert (round(got[0], 4), round(got[1], 4)) == (odds, p)


def test_matched_summary_edges():
    assert matched_summary(0, 0, 0, 0, 0)["fisher_p"] == 1.0
    assert matched_summary(1, 40, 160, 2, 198)["significant_05"] and not matched_summary(1, 12, 88, 11, 89)["significant_05"]


def test_prices(spark):
    u = spark.createDataFrame([("deepinfra", money.PRICES[0][1], 12, 2, None), ("x", "y", 1, 1, None), ("deepinfra", money.PRICES[0][1], 25, 6, 5e-6)], "provider string, model string, in_tokens long, out_tokens long, provider_usd double")
    got = [(r["usd"], r["cost_source"], r["drifted"]) for r in money.with_cost(u, money.price_table(spark)).orderBy("in_tokens").collect()]
    assert got == [(0.0, "unknown", False), (pytest.approx(1.84e-6), "table", False), (5e-6, "provider", True)]


def test_budget_blocks_at_the_cap(spark):
    rows = [(1, "d", 500, 0.0), (2, "d", 499, 0.0), (3, "d", 1, 0.0), (4, "d", 0, 0.0)]
    df = spark.createDataFrame(rows, "seq int, day string, tokens int, usd double")
    got = [r["allowed"] for r in ledger.budget_breaker(df, 2.0, 1000).orderBy("seq").collect()]
    assert got == [True, True, False, False]


def test_merge_insert_and_cache(spark):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "keep")], "k string, seq int, v string")
    delta = spark.createDataFrame([("a", 2, "new"), ("c", 1, "add"), ("c", 2, "last")], "k string, seq int, v string")
    assert {(r["k"], r["v"]) for r in cdc.merge_latest(base, delta, ["k"], "seq").collect()} == {("a", "new"), ("b", "keep"), ("c", "last")}
    assert {(r["k"], r["v"]) for r in cdc.insert_ignore(base, delta, ["k"], "seq").collect()} == {("a", "old"), ("b", "keep"), ("c", "add")}


def test_refresh_guard_is_strict(spark):
    old = spark.createDataFrame([(i, "x", "o") for i in range(10)], "k int, status string, last_updated string")
    with pytest.raises(ValueError, match="refused"):
        cdc.refresh_apply(old, old.limit(4), "k")
    new = spark.createDataFrame([(i, None if i == 1 else "x", "n") for i in range(5, 10)] + [(1, None, "n")], "k int, status string, last_updated string")
    got = {r["k"]: (r["status"], r["last_updated"]) for r in cdc.refresh_apply(old, new, "k").collect()}
    assert got == {1: (None, "n"), **{i: ("x", "o") for i in range(5, 10)}}


def limiter(times, limit, window):
    q, out = deque(), []
    for t in times:
        while q and q[0] < t - window:
            q.popleft()
        out.append(len(q) < limit)
        if out[-1]:
            q.append(t)
    return out


def test_rate_limiter_is_the_fold(spark):
    start = dt.datetime(2024, 1, 1)
    times = {k: [(i * i * (k + 3)) % 97 for i in range(40)] for k in range(5)}
    rows = [(k, i, start + dt.timedelta(seconds=t)) for k, ts in times.items() for i, t in enumerate(sorted(ts))]
    df = spark.createDataFrame(rows, "k int, i int, ts timestamp")
    got = {(r["k"], r["i"]): r["allowed"] for r in stateful.rate_limiter(df, "k", "ts", 3, 10, "i").collect()}
    for k, ts in times.items():
        assert [got[k, i] for i in range(40)] == limiter(sorted(ts), 3, 10)


def plain_store(rows, ttl):
    """The job store replayed one event at a time."""
    jobs, last = {}, {}
    for job, seq, kind, t, error, payload in rows:
        if kind in ("create", "get"):
            for k in [k for k, j in jobs.items() if t - j["born"] > ttl]:
                del jobs[k]
        if kind == "create":
            jobs[job] = last[job] = {"born": t, "status": "queued", "n": 0, "error": None}
        elif kind != "get" and job in jobs:
            j = jobs[job]
            j["n"] += kind != "complete" or payload is not None
            if kind == "append" and j["status"] == "queued":
                j["status"] = "running"
            elif kind != "append":
                j["status"], j["error"] = {"complete": "done", "fail": "error"}[kind], error if kind == "fail" else j["error"]
    return {k: (j["status"], j["n"], j["error"]) for k, j in last.items()}


@pytest.mark.parametrize("ttl", [0, 3, 10, 1000])
def test_job_replay_is_the_store(spark, ttl):
    r = random.Random(ttl)
    rows, t = [], 0.0
    for seq in range(400):
        t += r.choice((0.0, 0.5, 1.0, 7.0))
        job = f"j{r.randint(0, 25)}"
        kind = "create" if job not in {x[0] for x in rows} else r.choice(("append", "append", "append", "get", "complete", "fail"))
        rows.append((job, seq, kind, t, "boom" if kind == "fail" else None, r.choice((None, "{}"))))
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(j, s, k, t0 + dt.timedelta(seconds=x), e, p) for j, s, k, x, e, p in rows], "job_id string, seq int, type string, ts timestamp, error string, payload string")
    got = {x["job_id"]: (x["status"], x["n_events"], x["error"]) for x in stateful.job_replay(df.repartition(3), ttl).collect()}
    assert got == plain_store(rows, ttl)


def test_streamed_jobs(spark, tmp_path):
    from groundwell.streaming import stateful as ss

    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [("a", 0, "create", "{}", at(0)), ("a", 1, "trial", "{1}", at(5)), ("a", 2, "complete", "{2}", at(9)), ("b", 0, "create", "{}", at(0)), ("b", 1, "trial", "{3}", at(99)), ("c", 0, "trial", "{4}", at(1)), ("d", 0, "create", "{}", at(0)), ("d", 1, "fail", "{5}", at(3))]
    df = spark.createDataFrame(rows, "job_id string, seq int, type string, payload string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = ss.job_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 10).writeStream.format("memory").queryName("jobs").outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r["job_id"]: (r["status"], r["n_events"], r["frames"]) for r in spark.table("jobs").collect()}
    assert got == {"a": ("done", 2, "event: trial\ndata: {1}\n\nevent: complete\ndata: {2}\n\n"), "b": ("queued", 0, ""), "d": ("error", 1, "event: fail\ndata: {5}\n\n")}


def test_event_feed_sends_ordered_frames(spark, tmp_path):
    from groundwell.streaming import feed

    rows = [("j", 2, "summary", "{2}"), ("j", 0, "trial", "{0}"), ("k", 0, "error", "{9}"), ("j", 1, "trial", "{1}"), ("k", 1, "trial", "{8}")]
    df = spark.createDataFrame(rows, "job_id string, seq long, type string, payload string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    sent = []
    q = feed.follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b, i: sent.extend(r["frame"] for r in b.collect()), str(tmp_path / "ck"), None)
    assert q.awaitTermination(90)
    assert sent == ["event: trial\ndata: {0}\n\n", "event: trial\ndata: {1}\n\n", "event: summary\ndata: {2}\n\n", "event: error\ndata: {9}\n\n"]


def test_streamed_limiter_equals_the_batch(spark, tmp_path):
    from groundwell.streaming import stateful as ss

    start = dt.datetime(2024, 1, 1)
    rows = [(k, i, start + dt.timedelta(seconds=i * (k + 1))) for k in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "k int, i int, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ss.limited(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts", "i", 2, 5)
    # processing-time state would otherwise be swept in empty batches without end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    want = {(r["k"], r["i"], r["allowed"]) for r in stateful.rate_limiter(df, "k", "ts", 2, 5, "i").collect()}
    assert {(r["k"], r["i"], r["allowed"]) for r in spark.table("limited").collect()} == want


def test_gate_names_the_failure(spark):
    m = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    t = spark.createDataFrame([("a", ">=", 1.0), ("b", "<=", 0.05)], "metric string, op string, threshold double")
    rows = am.gate(t, m([("a", 1.0)]), m([("a", 0.0)]), m([("b", 0.5), ("a", 0.0)]))
    assert {(r["metric"], r["passed"]) for r in rows.collect()} == {("a", True), ("b", False)}
    assert am.gate_passed(rows).first()["passed"] is False


def test_registry_pages_retry_and_stop(spark):
    calls, slept = [], []

    def fetch(params):
        calls.append(params.get("pageToken"))
        if len(calls) == 2:
            return 429, {}
        study = lambda i: {"protocolSection": {"identificationModule": {"nctId": f"N{i}"}}}
        return 200, {"studies": [study(len(calls) * 10), study(len(calls) * 10 + 1), {"protocolSection": {}}], "nextPageToken": "t"}

    got = [s["protocolSection"]["identificationModule"]["nctId"] for s in registry.pages(fetch, {}, 3, sleep=slept.append)]
    assert got == ["N10", "N11", "N30"] and calls == [None, "t", "t"] and 10.0 in slept


def test_registry_errors_and_empty_pages(spark):
    study = {"protocolSection": {"identificationModule": {"nctId": "N1"}}}
    answers = iter([(200, {"studies": [study], "nextPageToken": "t"}), (500, {})])
    with pytest.raises(registry.RegistryError, match="status 500 after 1"):
        list(registry.pages(lambda p: next(answers), {}, 10, sleep=lambda s: None))
    endless = lambda p: (200, {"studies": [], "nextPageToken": "t"})
    assert list(registry.pages(endless, {}, 10, sleep=lambda s: None)) == []


def dump(path, n=25):
    studies = [
        {
            "protocolSection": {
                "identificationModule": {"nctId": f"N{i}"},
                "statusModule": {"overallStatus": ["RECRUITING", "ENROLLING_BY_INVITATION", "COMPLETED"][i % 3]},
                "conditionsModule": {"conditions": ["Lung Cancer", "Tumor of skin", "asthma"][i % 2 : i % 2 + 1] if i < 20 else "Oncology"},
            }
        }
        for i in range(n)
    ]
    path.write_text(json.dumps({"studies": studies}))
    return str(path)


def test_registry_source_reads_a_dump(spark, tmp_path):
    path = dump(tmp_path / "dump.json")
    options = {"transport": "groundwell.sources.dump:fetch", "transport.path": path, "page_size": "4"}
    want = {f"N{i}" for i in range(25) if i % 3 < 2}
    got = registry.read_registry(spark, **options)
    assert {r["nct_id"] for r in got.collect()} == want and got.count() == len(want)
    assert [r["conditions"] for r in got.where("nct_id = 'N21'").collect()] == [["Oncology"]]
    raw = spark.read.format("trial_registry").options(**options).load()
    assert raw.count() == len(want) and raw.rdd.getNumPartitions() == 1
    assert registry.read_registry(spark, **options, max_trials="5").count() == 5
    split = registry.read_registry(spark, **options, split="true")
    assert {r["nct_id"] for r in split.collect()} == want and split.count() == len(want)
    assert registry.read_registry(spark, **options, split="true", max_trials="3").count() == 3


def test_registry_request(spark):
    reader = registry.RegistryReader({})
    (one,) = reader.partitions()
    asked = reader.params(one.value)
    assert asked["query.cond"] == "cancer OR oncology OR tumor OR neoplasm" and asked["format"] == "json"
    assert asked["filter.overallStatus"] == "RECRUITING,NOT_YET_RECRUITING,ENROLLING_BY_INVITATION" and asked["fields"].startswith("NCTId,BriefTitle,") and asked["fields"].count(",") == 11
    assert len(registry.RegistryReader({"split": "true"}).partitions()) == 4


def test_conflicting_writers(spark, tmp_path):
    row = lambda k, v, s: spark.createDataFrame([(k, v, s)], "k string, v string, seq int")
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.upsert(row("a", "one", 1), ["k"], "seq") == 1
    number = t._pointer()[0]
    t.upsert(row("b", "two", 1), ["k"], "seq")
    with pytest.raises(sinks.Conflict):
        t.replace(row("c", "lost", 1), number)  # started from what is no longer current
    slept = []

    class Late(VersionedTable):
        """Another writer comes between this one's read and write, once."""

        def replace(self, df, after=None):
            if not slept:
                t.upsert(row("d", "other", 1), ["k"], "seq")
            return super().replace(df, after)

    Late(spark, str(tmp_path / "t")).upsert(row("e", "mine", 1), ["k"], "seq", sleep=slept.append)
    assert slept == [1.0] and {r["k"] for r in t.read().collect()} == {"a", "b", "d", "e"}
    before = {r["k"] for r in t.read().collect()}
    with pytest.raises(Exception, match="[Cc]annot"):
        t.upsert(spark.createDataFrame([(1,)], "other int"), ["k"], "seq", sleep=slept.append)
    assert slept == [1.0] and {r["k"] for r in t.read().collect()} == before


def test_ledger_is_banked(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "ledger"))
    day = lambda d, usd, tok, n: spark.createDataFrame([(dt.date(2024, 1, d), usd, tok, n)], "day date, usd double, tokens long, calls long")
    for d in (day(1, 0.1, 5, 1), day(1, 0.2, 7, 2), day(2, 0.0, 0, 0), day(3, 1.0, 1, 1)):
        sinks.write_ledger(t, d)
    assert sorted((r["day"].day, float(r["usd"]), r["tokens"], r["calls"]) for r in t.read().collect()) == [(1, pytest.approx(0.3), 12, 3), (3, 1.0, 1, 1)]


def test_markdown_table_is_whole_or_an_error(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sinks.markdown_table(df) == "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | x |"
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.markdown_table(df, 1)


def test_reports_and_snapshots(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([(0.5, "ok")], "rate double, label string"), str(tmp_path / "r"))
    assert readers.read_report(spark, str(tmp_path / "r")).select(am.dotted(F.col("report"), "rate")).first()[0] == 0.5
    p = tmp_path / "pat.jsonl"
    p.write_text('{"_id":"a","text":"t"}\n{"id":"b"}\n{}\n')
    assert sorted(map(tuple, readers.read_patients(spark, str(p), "trec_2021").collect())) == [("", "", "trec_2021"), ("a", "t", "trec_2021"), ("b", "", "trec_2021")]
    c = tmp_path / "corpus.jsonl"
    c.write_text('{"_id":"A","title":"T","text":"x","metadata":{"phase":"P1"}}\n{"title":"no id"}\n{"_id":"B"}\n')
    got = {r["nct_id"]: (r["phase"], r["eligibility_raw"]) for r in readers.read_corpus_jsonl(spark, str(c), "s").collect()}
    assert got == {"A": ("P1", "x"), "B": (None, "")}
    ids = spark.createDataFrame([("A",), ("A",), ("Z",)], "nct_id string")
    assert [r["nct_id"] for r in readers.read_corpus_jsonl(spark, str(c), "s", ids).collect()] == ["A"]
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        readers.read_corpus_jsonl(spark, str(tmp_path / "missing.jsonl"), "s").count()


def test_ragged_vectors_are_an_error(spark):
    t = spark.createDataFrame([("a", [3.0, 4.0], "s"), ("b", [0.0, 0.0], "s"), ("c", None, "s"), ("d", [1.0], "r")], "nct_id string, embedding array<double>, source string")
    assert {r["nct_id"]: list(r["embedding"]) for r in readers.embedded(t, "s").collect()} == {"a": [pytest.approx(0.6), pytest.approx(0.8)], "b": [0.0, 0.0]}
    with pytest.raises(ValueError, match="1 to 2 dimensions"):
        readers.embedded(t)


def test_drift_at_the_edge(spark):
    u = spark.createDataFrame([("p", "m", 10, 0, x) for x in (1.1e-06, 1.1000000001e-06, 0.9e-06, 0.89e-06, 1e-06)], "provider string, model string, in_tokens long, out_tokens long, provider_usd double")
    prices = spark.createDataFrame([("p", "m", 0.1, 0.3)], "provider string, model string, usd_in double, usd_out double")
    assert {r["provider_usd"]: r["drifted"] for r in money.with_cost(u, prices).collect()} == {1.1e-06: False, 1.1000000001e-06: True, 0.9e-06: False, 0.89e-06: True, 1e-06: False}


def test_readers(spark, tmp_path):
    study = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "T"}, "designModule": {"phases": ["P2", "P3"]}, "armsInterventionsModule": {"interventions": [{"name": "d"}, {"name": ""}]}, "eligibilityModule": {"healthyVolunteers": "Yes"}}}
    (tmp_path / "s.json").write_text(json.dumps(study) + "\n" + json.dumps({"protocolSection": {}}))
    (r,) = readers.read_studies(spark, str(tmp_path / "s.json")).collect()
    assert (r["nct_id"], r["phase"], r["interventions"], r["conditions"], r["healthy_volunteers"]) == ("N1", "P2", ["d"], [], True)
    people = [{"patient_id": "1", "0": [{"NCTID": "A", "inclusion_criteria": "i", "exclusion_criteria": "e"}]}, {"patient": "x", "1": [{"NCTID": "A", "inclusion_criteria": "other"}, {"NCTID": "B"}]}]
    (tmp_path / "p.json").write_text(json.dumps(people))
    assert {(r["nct_id"], r["eligibility_raw"]) for r in readers.read_patient_corpus(spark, str(tmp_path / "p.json")).collect()} == {("A", "i\ne"), ("B", "")}
    (tmp_path / "l.tsv").write_text("query-id\tcorpus-id\tscore\nq\tA\t2\nq\tB\t7\n")
    assert {(r["nct_id"], r["label"]) for r in readers.read_labels(spark, str(tmp_path / "l.tsv"), "sigir").collect()} == {("A", "eligible"), ("B", "irrelevant")}
    with pytest.raises(ValueError, match="allow-list"):
        readers.read_labels(spark, "x", "hospital")


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    row = lambda v, s: spark.createDataFrame([("a", v, s)], "k string, v string, seq int")
    t.upsert(row("one", 1), ["k"], "seq")
    t.upsert(row("two", 2), ["k"], "seq")
    assert [r["v"] for r in t.read().collect()] == ["two"]


def test_subset_builder(spark):
    l = spark.createDataFrame([("p", "t1", "eligible", 0), ("p", "t2", "excluded", 1), ("q", "t1", "eligible", 2), ("p", "t3", "eligible", 3)], "patient_id string, nct_id string, label string, seq int")
    t = spark.createDataFrame([("t1", 2), ("t2", 0), ("t3", 1)], "nct_id string, n_criteria int")
    assert [(r["patient_id"], r["nct_id"]) for r in am.build_subset(l, t, 5, 1).collect()] == [("p", "t1")]


def test_scores_table(spark):
    df = spark.createDataFrame([(0.5, "ok")], "rate double, label string")
    assert {(r["name"], r["value"], r["text"], r["data_type"]) for r in am.scores_table(df, ["rate", "label"]).collect()} == {("rate", 0.5, None, "NUMERIC"), ("label", None, "ok", "CATEGORICAL")}


def test_daily_rollover(spark):
    u = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), 1.0, 5), (dt.datetime(2024, 1, 2, 1), 2.0, 7)], "ts timestamp, usd double, tokens int")
    days = ledger.daily(u)
    assert days.count() == 2
    today = ledger.summary(days, F.lit("2024-01-02").cast("date"), 2.0).first()
    assert float(today["usd"]) == 2.0 and today["exhausted"]


def test_schemas_and_conforming_tables(spark):
    from groundwell import schema

    for ddl in (schema.TRIAL, schema.ASSESSMENT, schema.USAGE, schema.PATIENT, schema.QREL, schema.CORPUS_JSONL, schema.STUDY, f"c {schema.CRITERION}"):
        assert spark.createDataFrame([], ddl).count() == 0
    df = spark.createDataFrame([("1", "x", "gone")], "n string, s string, other string")
    assert schema.conform(df, "s string, n int, missing double").collect() == [("x", 1, None)]


def test_one_trial(spark):
    t = spark.createDataFrame([("A", "s", "one"), ("A", "r", "two")], "nct_id string, source string, title string")
    assert [r["title"] for r in readers.get_trial(t, "A", "r").collect()] == ["two"] and readers.get_trial(t, "Z").count() == 0
