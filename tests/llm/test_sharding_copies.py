"""Sharding where every text has copies."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from groundwell.llm import sharding


def test_grants_count_what_leaves():
    assert sharding.grants([(0, 1, 10), (1, 0, 10)], [0.0, 0.0]) == [1.0, 1.0]
    assert sharding.grants([(0, 1, 10), (1, 0, 5)], [0.0, 0.0]) == pytest.approx([1.0, 0.5])
    assert sharding.grants([(0, 1, 10)], [0.0, 0.0]) == [1.0, 0.0]
    assert sharding.grants([], [1.0]) == [1.0]


@pytest.mark.parametrize("texts, copies", [(2000, 2), (600, 20)])
def test_every_text_has_copies(spark, texts, copies):
    rows = [(i * copies + j, f"text {i} " * (i % 7 + 1)) for i in range(texts) for j in range(copies)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(texts * copies))
    sizes, where, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        where[r["doc_id"] // copies].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 16
    assert sum(len(s) == 1 for s in where.values()) >= 0.95 * texts
