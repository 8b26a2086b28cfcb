"""Labelling chain, batch assessment, job events, models as given functions, table functions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from groundwell.functions import text as tx
from groundwell.functions.udtfs import criteria_of, register
from groundwell.operators import assess as asx
from groundwell.operators import models
from groundwell.operators.criteria import typed

TRIALS = "nct_id string, title string, status string, eligibility_raw string, inclusion_criteria array<string>, exclusion_criteria array<string>"
POLICY = asx.Policy("tests.fake_models:labeller", "system")
NONE = "key string, assessments array<struct<criterion:string,verdict:string,quote:string,rationale:string>>"


def trials(spark):
    one = lambda i, inc, exc: (i, f"title {i}", "RECRUITING", "\n".join(inc + exc), inc, exc)
    return spark.createDataFrame(
        [one("good", ["adults over eighteen"], ["prior carboplatin use"]), one("wrong", ["wrong at first here"], []), one("never", ["never quoted right"], []), one("bad", ["explode now please"], []), one("none", [], [])], TRIALS
    )


def notes(spark):
    return spark.createDataFrame([("n1", "a note"), ("n2", "  \n ")], "query_id string, note string")


def hits(spark, ids=("good", "wrong", "never", "bad", "none", "lost")):
    return spark.createDataFrame([(q, d, 1.0 / (i + 1), i + 1) for q in ("n1", "n2") for i, d in enumerate(ids)], "query_id string, doc_id string, score double, rank int")


def test_assess_notes(spark):
    verdicts, done, runs = asx.assess_notes(hits(spark), notes(spark), trials(spark), spark.createDataFrame([], NONE), POLICY)
    got = {(r["query_id"], r["doc_id"]): (r["trial_verdict"], r["error"], r["title"]) for r in verdicts.collect()}
    want = {"good": ("eligible", None), "wrong": ("eligible", None), "never": ("cannot_determine", None), "bad": ("cannot_determine", "model fell over"), "none": ("cannot_determine", "no_criteria"), "lost": ("cannot_determine", "not_found")}
    assert got == {("n1", d): (v, e, None if d == "lost" else f"title {d}") for d, (v, e) in want.items()}  # the blank note is not admitted
    attempts = {r["doc_id"]: r["attempt"] for r in done.collect()}
    assert attempts == {"good": 0, "wrong": 1, "never": 2}
    calls = [{r["doc_id"] for r in run.usage.collect()} for run in runs]
    assert calls == [{"good", "wrong", "never"}, {"wrong", "never"}, {"never"}]
    assert {r["served_model"] for r in runs[0].usage.collect()} == {"fake-1"}


def pairs(spark, ids, skip=False):
    rows = [("q", d, i, "a note", [(f"{d} criterion text", "inclusion")], skip) for i, d in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id string, doc_id string, seq int, note string, criteria array<struct<text:string,kind:string>>, skip_cache_write boolean")


def test_label_chain_cache_and_writes(spark):
    none = spark.createDataFrame([], NONE)
    first = asx.label_pairs(pairs(spark, ["a", "b", "explode"]), none, POLICY)
    got = {r["doc_id"]: (len(r["assessments"]), r["error"]) for r in first.answers.collect()}
    assert got == {"a": (1, None), "b": (1, None), "explode": (0, "model fell over")}
    assert first.writes.count() == 2 and first.usage.count() == 2
    again = asx.label_pairs(pairs(spark, ["a", "b", "c"]), first.writes, POLICY)
    assert again.usage.collect()[0]["doc_id"] == "c" and again.usage.count() == 1 and again.answers.count() == 3
    assert asx.label_pairs(pairs(spark, ["d"], skip=True), none, POLICY).writes.count() == 0
    other = asx.Policy(POLICY.labeller, "system", model="other")
    assert asx.label_pairs(pairs(spark, ["a"]), first.writes, other).usage.count() == 1  # another model, another key


def test_label_chain_stops_at_the_budget(spark):
    tight = asx.Policy(POLICY.labeller, "system", tokens_left=2 * (asx.ANSWER_TOKENS + 60))
    run = asx.label_pairs(pairs(spark, ["a", "b", "c", "d"]), spark.createDataFrame([], NONE), tight)
    got = {r["doc_id"]: r["error"] for r in run.answers.collect()}
    assert got == {"a": None, "b": None, "c": asx.BUDGET, "d": asx.BUDGET} and run.usage.count() == 2


def test_job_events_end_at_the_budget(spark):
    rows = [("j", 0, "a", "eligible", None), ("j", 1, "b", "cannot_determine", "boom"), ("j", 2, "c", "cannot_determine", asx.BUDGET), ("j", 3, "d", "eligible", None), ("k", 0, "a", "excluded", None)]
    df = spark.createDataFrame(rows, "job_id string, pos int, nct_id string, trial_verdict string, error string")
    got = sorted((r["job_id"], r["seq"], r["type"], json.loads(r["payload"]).get("error")) for r in asx.job_events(df).collect())
    assert got == [("j", 0, "trial", None), ("j", 1, "trial", "boom"), ("j", 2, "error", asx.BUDGET), ("k", 0, "trial", None), ("k", 1, "summary", None)]


def test_encoder_batches_and_nulls(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aab", None, "zzz", "d"] * 20)], "i int, t string").repartition(3)
    got = {r["i"]: r["embedding"] for r in models.encode(df, "t", "tests.fake_models:encoder", batch=7).collect()}
    root = 5**0.5
    assert got[0] == pytest.approx([2 / root, 1 / root, 0, 0]) and got[1] is None and got[2] == [0, 0, 0, 0] and got[3] == [0, 0, 0, 1]
    asked = {r["i"]: r["embedding"] for r in models.encode(df, "t", "tests.fake_models:encoder", True, prefix="dddd ").collect()}
    assert asked[3] == [0, 0, 0, 1] and asked[0] != got[0]
    assert models.encode(df.limit(0), "t", "tests.fake_models:encoder").count() == 0


def test_rerank_scores_only_what_the_cache_lacks(spark):
    c = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("ABCD")], "query_id string, doc_id string, rank int")
    n = spark.createDataFrame([("q", "x y z")], "query_id string, note string")
    texts = spark.createDataFrame([("A", "x"), ("B", "x y z"), ("C", "x y")], "doc_id string, text string")
    cached = spark.createDataFrame([("q", "C", 2.5)], "query_id string, doc_id string, score double")
    best, fresh = models.rerank_fresh(c, n, texts, cached, "tests.fake_models:scorer", 3)
    assert [r["doc_id"] for r in best.orderBy("rank").collect()] == ["B", "C", "A"]
    assert {(r["doc_id"], r["score"]) for r in fresh.collect()} == {("A", 1.0), ("B", 3.0), ("D", 0.0)}


def test_cache_policy_and_blank(spark):
    n = spark.createDataFrame([("a", " preset one\n"), ("b", "free text"), ("c", None)], "i string, note string")
    p = spark.createDataFrame([("preset one",)], "note string")
    assert {r["i"]: r["skip_cache_write"] for r in asx.with_cache_policy(n, p).collect()} == {"a": False, "b": True, "c": True}
    assert [r["i"] for r in asx.admitted(n).collect()] == ["a", "b"]


RAW = [
    "## **Inclusion Criteria:**\n- Adults over eighteen\n1. `Signed` [consent form](http://x) given\nExclusion Criteria:\n- Pregnant\n* Prior *chemotherapy* course",
    "EXCLUSION CRITERIA: none of these things\nInclusion criteria\n1. Age at least 18",
    "Just a headerless line of text\nshort", "Exclusion criteria:\nActive infection of any kind", "", None,
]


def test_criteria_table_function_agrees_with_the_columns(spark):
    register(spark)
    df = spark.createDataFrame(list(enumerate(RAW)), "i int, raw string")
    df.createOrReplaceTempView("raws")
    got = sorted(map(tuple, spark.sql("SELECT i, c.* FROM raws, LATERAL criteria(raw) c").collect()))
    s = df.select("i", tx.split_criteria(F.col("raw")).alias("c"))
    want = s.select("i", F.posexplode(typed(F.col("c.inclusion"), F.col("c.exclusion"))).alias("pos", "t")).select("i", "pos", "t.kind", "t.text")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 7
    assert criteria_of(RAW[0])[1] == ("inclusion", "Signed consent form given")


def test_websearch_table_function(spark):
    register(spark)
    got = sorted(map(tuple, spark.sql("""SELECT * FROM websearch_terms('lung "old mill" -x or river')""").collect()))
    assert got == [(0, 0, False, 0, "lung"), (0, 1, False, 0, "old"), (0, 1, False, 1, "mill"), (0, 2, True, 0, "x"), (1, 0, False, 0, "river")]


def test_retry_note_is_the_contract_text(spark):
    df = spark.createDataFrame([("note", ["c1", "c2"], "  source text \n")], "n string, f array<string>, s string")
    got = df.select(tx.retry_note(F.col("n"), F.lit(1), F.col("f"), F.col("s"))).first()[0]
    assert got.startswith("note\n\n[Retry 1] These criteria need") and "last time:\n- c1\n- c2\n\nCopy quotes" in got and got.endswith('text:\n"""\nsource text\n"""')


def test_expanded_keywords(spark):
    n = spark.createDataFrame([("a", "note a"), ("b", "note b"), ("c", "note explode"), ("d", "note d")], "query_id string, text string")
    k = lambda rows: spark.createDataFrame(rows, "query_id string, keywords array<string>")
    p = asx.Policy("tests.fake_models:keyworder", "system")
    out, usage, writes = asx.expand_keywords(n, k([("a", [])]), k([("b", ["kept"])]), p)
    assert {r["query_id"]: (r["keywords"], r["origin"]) for r in out.collect()} == {"a": ([], "disk"), "b": (["kept"], "store"), "c": (["note explode"], "note"), "d": (["note", "d"], "fresh")}
    assert [r["query_id"] for r in usage.collect()] == ["d"] and [r["query_id"] for r in writes.collect()] == ["d"]
    with pytest.raises(asx.BudgetExhausted, match="1 of 2"):
        asx.expand_keywords(n, k([("a", [])]), k([("b", ["kept"])]), asx.Policy("tests.fake_models:keyworder", "system", tokens_left=asx.ANSWER_TOKENS + 100))


def test_ingest_takes_up_where_it_stopped(spark, tmp_path):
    from groundwell.operators.ingest import ingest
    from groundwell.sources.sinks import VersionedTable

    rows = lambda ids: spark.createDataFrame([(i, f"t {i}", "Inclusion criteria: abcd abcd abcd\nExclusion criteria: dddddddddddd") for i in ids], "nct_id string, title string, eligibility_raw string")
    store = VersionedTable(spark, str(tmp_path / "trials"))
    assert ingest(rows(["A", "B", "A"]), store, "s", "tests.fake_models:encoder") == 2
    assert ingest(rows(["B", "C"]), store, "s", "tests.fake_models:encoder") == 1
    got = {r["nct_id"]: r for r in store.read().collect()}
    assert set(got) == {"A", "B", "C"} and got["A"]["inclusion_criteria"] == ["abcd abcd abcd"] and sum(x * x for x in got["C"]["embedding"]) == pytest.approx(1, abs=1e-5)


def test_fetch_once(spark, tmp_path):
    from groundwell.sources.files import fetch_once

    path = str(tmp_path / "f.bin")

    def broken():
        yield b"abc"
        raise OSError("line dropped")

    with pytest.raises(OSError):
        fetch_once(spark, path, broken)
    assert not (tmp_path / "f.bin").exists()
    assert fetch_once(spark, path, lambda: [b"abc", b"def"]) and not fetch_once(spark, path, broken)
    assert (tmp_path / "f.bin").read_bytes() == b"abcdef"
