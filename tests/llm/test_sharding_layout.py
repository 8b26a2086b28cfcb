"""Shards follow from the rows alone; linking keeps copies together far better than chance."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from groundwell.llm import sharding


def rows_of(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = [(i, f"text {r.randint(0, 150)} " * r.randint(1, 3), "x", 1) for i in range(900)]
    return rows + [rows[7]] * 30 + [(None, "no id", "x", 1)] * 12 + [(2000 + i, None, "x", 1) for i in range(9)] + [(3000 + i, "hot text", "x", 1) for i in range(400)] + [(4000, "é" * 20_000, "x", 1)]


def shards(df):
    return Counter(map(tuple, df.select("doc_id", "size", "text_crc32", "shard").collect()))


def test_another_layout_gives_the_same_shards(spark):
    df = spark.createDataFrame(rows_of(1), "doc_id long, text string, shard string, tag int")
    one = shards(sharding.shard_documents(df.repartition(1)))
    assert one == shards(sharding.shard_documents(df.repartition(7))) and sum(one.values()) == df.count()


@pytest.mark.parametrize("chunk", [2, 1024])
def test_equal_rows_are_numbered(spark, chunk):
    slim = spark.createDataFrame([(1, 5, 2, b"k")] * 7 + [(None, 5, 2, b"k")] * 3 + [(2, 6, 2, b"j")], "id long, size long, crc long, text_key binary")
    got = sharding._numbered(slim, 5, chunk).collect()
    assert len(got) == 11 and len({r["tag"] for r in got}) == 11
    assert {r["tag"] for r in got} == {r["tag"] for r in sharding._numbered(slim.repartition(4), 5).collect()}


def test_cut_edges_against_chance_and_brute_force(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b int")
    got = sharding.shard_documents(df).collect()
    where, sizes = defaultdict(Counter), Counter()
    for r in got:
        where[r["text_crc32"]][r["shard"]] += 1
        sizes[r["shard"]] += r["size"]
    pairs = lambda n: n * (n - 1) // 2
    total = sum(pairs(sum(c.values())) for c in where.values())
    cut = total - sum(pairs(n) for c in where.values() for n in c.values())
    # by chance 15 of 16 links are cut; a text that is far larger than a shard must be split
    assert cut < 0.25 * total
    fair = sum(sizes.values()) / 16
    small = [c for c in where.values() if sum(c.values()) > 1 and sum(c.values()) * 60 < fair / 4]
    assert sum(len(c) == 1 for c in small) >= 0.9 * len(small)
    long = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= max(0.05 * fair, long)
