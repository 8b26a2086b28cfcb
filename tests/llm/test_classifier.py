"""The quality classifier on awkward rows, and its parts against plain arithmetic."""

from __future__ import annotations

import random
import zlib

import pytest

from groundwell.llm import quality_classifier as qc

GOOD = "the river runs past an old mill and the town keeps its garden".split()
JUNK = "click $$$ buy now!!! free %%% offer ### win".split()


def corpus(n=500, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = r.random() < 0.5
        words = r.choices(GOOD, k=r.randint(5, 60)) if good else r.choices(JUNK + GOOD[:4], k=r.randint(5, 60))
        rows.append((i, " ".join(words), int(good)))
    return rows


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_held_out_accuracy_and_awkward_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", 0.5, 1) for i, t, _ in rows] + [(9000, None, "s", 0.5, 1), (9001, "", "s", 0.5, 1), (9002, "river " * 100_000, "s", 0.5, 1), (0, rows[0][1], "s", 0.5, 1)], "doc_id long, text string, label string, score double, predicted int").repartition(3)
    # labels given twice, of unknown documents, and null ones
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i, y) for i, _, y in rows[:50]] + [(77_777, 1), (3, None)], "doc_id long, quality int")
    got = qc.score(docs, qc.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    assert auc([(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]) > 0.95
    same = [r["score"] for r in got if r["doc_id"] == 0]
    assert len(same) == 2 and same[0] == same[1]
    assert qc.score(docs.limit(0), qc.train(docs, labels)).count() == 0


def test_held_out_labels_are_never_learnt(spark):
    rows = corpus(300, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    right = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    wrong = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, quality int")
    one = {r["doc_id"]: r["score"] for r in qc.score(docs, qc.train(docs, right)).collect()}
    two = {r["doc_id"]: r["score"] for r in qc.score(docs, qc.train(docs, wrong)).collect()}
    assert one == pytest.approx(two)
