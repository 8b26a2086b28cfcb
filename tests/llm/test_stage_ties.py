"""Filtering stages on null ids, rows that share an id, repeated rows and clashing columns; notices in rows of one id."""

from __future__ import annotations

from collections import Counter

from groundwell.llm import exact_dedup, license_scan, quality_rules

GOOD = " ".join(["the old mill and a river with its garden by the town"] + [f"word{i} of the" for i in range(60)])


def test_exact_dedup_stage_ties(spark):
    rows = [
        (1, "Same", "a", "r"), (5, "same", "b", "r"), (5, "same", "c", "r"), (None, "same", "d", "r"), (5, "SAME", "c", "r"),
        (None, None, "e", "r"), (None, "", "f", "r"), (7, "alone", "g", "r"), (8, "twice", "h", "r"), (8, "twice", "h", "r"), (None, "only null", "i", "r"), (9, "x" * 300_000, "j", "r"), (10, "X" * 300_000, "k", "r"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, sha string, row string").repartition(4)
    got = Counter(map(tuple, exact_dedup.drop_exact_duplicates(d).collect()))
    texts = Counter((r[1] or "").lower() for r in got)
    assert set(texts.values()) == {1} and set(texts) == {"same", "", "alone", "twice", "only null", "x" * 300_000}
    assert all(n == 1 and r in rows for r, n in got.items())
    assert {r[0] for r in got} == {5, None, 7, 8, 10} and (10, "X" * 300_000, "k", "r") in got


def test_quality_stage_keeps_clean_rows_and_all_columns(spark):
    rows = [(1, GOOD, 1.0, "k"), (None, GOOD, 2.0, "k"), (1, GOOD, 1.0, "k"), (2, None, 0.0, "k"), (3, "short", 0.0, "k"), (4, "$ # " * 100, 0.0, "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words double, kept string")
    got = quality_rules.keep_quality(d)
    assert got.columns == d.columns and Counter((r["doc_id"], r["n_words"]) for r in got.collect()) == {(1, 1.0): 2, (None, 2.0): 1}


def test_notices_of_rows_that_share_an_id(spark):
    mit, gpl = license_scan.TEMPLATES["mit-line"], license_scan.TEMPLATES["gpl-3.0-line"]
    rows = [(1, "before " * 9 + mit), (1, mit), (1, gpl), (None, mit), (2, None), (3, "word " * 50_000 + gpl)]
    got = {(r["doc_id"], r["license"]): (r["containment"], r["word_at"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({})).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "mit-line"): 1.0, (1, "gpl-3.0-line"): 1.0, (None, "mit-line"): 1.0, (3, "gpl-3.0-line"): 1.0}
    assert got[1, "mit-line"][1] == 0 and got[3, "gpl-3.0-line"][1] > 49_000
