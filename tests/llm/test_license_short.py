"""License lines written out here, not read from the templates."""

from __future__ import annotations

from groundwell.llm import license_scan

LINES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
}


def found(spark, texts, **more):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["license"]): (r["containment"], r["word_at"]) for r in license_scan.license_scan(d, **more).collect()}


def test_every_planted_line_is_found(spark):
    texts = [f"{'some prose goes here. ' * 30}\n{line}" for line in LINES.values()]
    assert {k: v[0] for k, v in found(spark, texts).items()} == {(i, name): 1.0 for i, name in enumerate(LINES)}


def test_templates_under_five_words(spark):
    texts = ["All rights reserved.", "(c) 2020 ALL RIGHTS\nRESERVED by us", "all rights are reserved", "rights reserved", "all rights", "reserved all rights", "x " * 50 + "all rights reserved", None, ""]
    assert found(spark, texts) == {(0, "all-rights-reserved"): (1.0, 0), (1, "all-rights-reserved"): (1.0, 1), (6, "all-rights-reserved"): (1.0, 49)}
    own = {"one": "Proprietary", "two": "public domain", "four": "do not copy this", "none": "..."}
    assert found(spark, ["it is proprietary", "in the public domain, do not copy this", "do not copy"], templates=own).keys() == {(0, "one"), (1, "two"), (1, "four")}
    assert found(spark, ["anything"], templates={}) == {}
