"""Grounding, roll-up, retry and the stress test."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from groundwell.functions import text as tx
from groundwell.operators import grounding as gr

SOURCE = "A 48 M smoker. EF was 25%; lesion in the T-L spine. HER2 positive, dose 60 mg."
GOLDEN = [("48 M", True), ("EF was 25%", True), ("T-L spine", True), ("her2   POSITIVE", True), ("spine", False), ("EF was 35%", False), ("HER2 negative", False), ("dose 90 mg", False), ("", False)]


@pytest.mark.parametrize(("quote", "ok"), GOLDEN)
def test_golden_quotes(spark, quote, ok):
    df = spark.createDataFrame([(quote, SOURCE)], "q string, s string")
    assert df.select(gr.is_grounded(F.col("q"), tx.normalize(F.col("s")))).first()[0] is ok


def test_substring_not_token(spark):
    df = spark.createDataFrame([("48 m", "148 mg daily")], "q string, s string")
    assert df.select(gr.is_grounded(F.col("q"), tx.normalize(F.col("s")))).first()[0] is True


def test_stress_catches_every_corruption(spark):
    cases = spark.createDataFrame([(i, SOURCE, q, ok) for i, (q, ok) in enumerate(GOLDEN)], "i int, source string, quote string, grounded boolean")
    r = gr.stress_test(cases, ["i"]).first()
    assert r["corrupted"] == 3 and r["catch_rate"] == 1.0 and r["false_rejection_rate"] == 0.0
    empty = gr.stress_test(cases.where("i < 0"), ["i"]).first()
    assert (empty["catch_rate"], empty["false_rejection_rate"]) == (1.0, 0.0)


def test_assessments(spark):
    rows = [
        (0, "age", "inclusion", "met", "48 M"),
        (1, "age", "inclusion", "met", "52 M"),
        (2, "x", "inclusion", "cannot_determine", ""),
        (3, "prior carboplatin use", "exclusion", "not_met", ""),
        (4, "prior smoker use", "exclusion", "not_met", ""),
        (5, "prior carboplatin use", "exclusion", "met", ""),
        (6, "prior carboplatin use", "inclusion", "not_met", ""),
    ]
    df = spark.createDataFrame(rows, "pos int, criterion string, kind string, verdict string, quote string").withColumns({"source_norm": tx.normalize(F.lit(SOURCE)), "patient_norm": tx.normalize(F.lit(SOURCE))})
    got = {r["pos"]: (r["verdict"], r["grounded_by"], r["grounding_failure"]) for r in gr.ground_assessments(df, patient_norm="patient_norm").collect()}
    un = ("unverifiable", None, True)
    assert got == {0: ("met", "quote", False), 1: un, 2: ("cannot_determine", None, False), 3: ("not_met", "absence", False), 4: un, 5: un, 6: un}
    without = {r["pos"]: r["verdict"] for r in gr.ground_assessments(df).collect()}
    assert without[3] == "unverifiable"


@pytest.mark.parametrize(
    ("rows", "verdict"),
    [
        ([("inclusion", "met"), ("exclusion", "met")], "excluded"),
        ([("inclusion", "met"), ("exclusion", "not_met")], "eligible"),
        ([("inclusion", "unverifiable"), ("exclusion", "not_met")], "cannot_determine"),
        ([("inclusion", "not_met"), ("exclusion", "unverifiable")], "excluded"),
    ],
)
def test_rollup(spark, rows, verdict):
    df = spark.createDataFrame([(1, k, v) for k, v in rows], "t int, kind string, verdict string")
    assert gr.rollup(df, ["t"]).first()["trial_verdict"] == verdict


@pytest.mark.parametrize(("most", "good_from", "verdict", "attempt"), [(0, 1, "unverifiable", 0), (2, 1, "met", 1), (2, 9, "unverifiable", 2)])
def test_bounded_retry(spark, most, good_from, verdict, attempt):
    pairs = spark.createDataFrame([(1,)], "t int").withColumns({"source_norm": tx.normalize(F.lit(SOURCE)), "patient_norm": F.lit("")})

    def label(todo, n):
        quote = "48 M" if n >= good_from else "made up words"
        return todo.select("t", F.lit(0).alias("pos"), F.lit("age").alias("criterion"), F.lit("inclusion").alias("kind"), F.lit("met").alias("verdict"), F.lit(quote).alias("quote"))

    (r,) = gr.bounded_retry(pairs, label, ["t"], most).collect()
    assert (r["verdict"], r["attempt"]) == (verdict, attempt)


def test_retry_note_names_source_and_failures(spark):
    note = spark.range(1).select(tx.retry_note(F.lit("note"), F.lit(1), F.array(F.lit("crit A")), F.lit("the span"))).first()[0]
    assert note.startswith("note") and "crit A" in note and "the span" in note
