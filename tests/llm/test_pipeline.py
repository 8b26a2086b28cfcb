"""The corpus pipeline, each stage held against what it should do to its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from groundwell.llm import mixing, quality_rules, simhash

WORDS = "the river of and old mill in a town that was by with from his garden to for road it".split()


def prose(seed: int, n: int = 90) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 11 + 3) + i * i) % len(WORDS)] + str((seed * i) % 17) for i in range(n))


def test_stages(spark, tmp_path):
    texts = [prose(i) + " the of and to" for i in range(60)]
    texts += [texts[3], texts[3].upper(), texts[5], None, "", "too short", "### $$$ " * 60, texts[9][:-3] + "up"]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        out.append(docs := spark.read.parquet(str(tmp_path / f"s{k}")))
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert all(df.columns == names for df in out[:4])
    assert ids(out[0]) == ids(quality_rules.quality_rules(source).where("kept"))
    equal = defaultdict(list)
    for r in out[0].collect():
        equal["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])].append(r["doc_id"])
    assert ids(out[1]) == Counter(max(v) for v in equal.values()) and any(len(v) > 1 for v in equal.values())
    assert ids(out[2]) == ids(simhash.simhash_groups(out[1]).where("doc_id = component_id"))
    # the stage's seeded hash covers whole rows, so picks within a length may differ, their number may not
    source_of = {r["doc_id"]: r["source"] for r in out[2].collect()}
    plan, done, size = Counter(), Counter(), {}
    for r in mixing.mix(out[2]).collect():
        size[r["doc_id"]] = r["size"]
        plan[source_of[r["doc_id"]], r["size"]] += r["taken"] // r["size"]
    for i, n in ids(out[3]).items():
        assert n <= 3
        done[source_of[i], size[i]] += n
    assert done == Counter({k: n for k, n in plan.items() if n})
    pieces = out[4].collect()
    assert set(ids(out[4])) == set(ids(out[3])) and all(r["length"] <= 2048 for r in pieces)
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
