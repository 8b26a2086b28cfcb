"""Links between fingerprints by brute force: every chain, prefix budgets, keys split for being heavy, hot groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.llm import simhash
from groundwell.llm.common import with_groups
from groundwell.llm.graph import components

SIGN = lambda x: x - (1 << 64) if x >= 1 << 63 else x


def sparse_and_near(seed: int, n: int = 260) -> list[int]:
    """Fingerprints with a quarter of their bits, even ones, and chains of near copies."""
    rng = np.random.default_rng(seed)
    bits = lambda p: sum(1 << b for b in range(64) if rng.random() < p)
    out = [bits(0.05) for _ in range(n)] + [bits(0.5) for _ in range(40)] + [0, (1 << 64) - 1]
    for x in out[:30]:
        for _ in range(4):
            x ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False))
            out.append(x)
    return sorted({*out})


def roots(fps: list[int], t: int) -> dict[int, frozenset]:
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= t:
                parent[find(b)] = find(a)
    groups: dict[int, set] = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
    return {x: frozenset(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("chain, heavy", [(4, simhash.HEAVY), (4, 0), (4, 40), (6, simhash.HEAVY), (6, 0), (8, simhash.HEAVY)])
def test_links_brute_force(spark, monkeypatch, chain, heavy):
    monkeypatch.setattr(simhash, "SALTED", 7)
    fps = sparse_and_near(chain + min(heavy, 50))
    nodes = spark.createDataFrame([(SIGN(x), 1 + x % 3) for x in fps], "fp long, n long").repartition(3)
    got: dict[int, set] = {}
    for r in simhash.links(nodes, len(fps), chain=chain, heavy=heavy).collect():
        got.setdefault(r["root"], set()).add(r["fp"] % (1 << 64))
    want = {g for g in roots(fps, 4).values() if len(g) > 1}
    assert {frozenset(g) for g in got.values()} == want and max(map(len, want)) > 20


@pytest.mark.parametrize("chain", simhash.CHAINS)
def test_prefix_budgets(chain):
    """Each pair within reach keeps all budgets of some chain whose key it shares; the budgets are those of the ring."""
    rng = np.random.default_rng(chain)
    masks, prefixes = simhash.ring(9, chain, 4)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        d = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))
        found = [p for p, m in enumerate(masks) if not d & m]
        assert any(all((d & x).bit_count() <= (l + 1) * 4 // 9 for l, x in enumerate(prefixes[p])) for p in found), hex(a ^ d)
    assert all(p[-1] == (1 << 64) - 1 and all(x & y == x for x, y in zip(p, p[1:])) for p in prefixes)


def test_longer_chains_split_the_same_start():
    for a, b in zip(simhash.CHAINS, simhash.CHAINS[1:]):
        short, long = simhash.ring(9, a, 4)[1], simhash.ring(9, b, 4)[1]
        assert {x[0] for x in short} == {x[0] for x in long}


def test_components_of_a_hub_and_a_path(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(5000, 5040)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()}
    assert got == {i: 0 for i in range(1500)} | {i: 5000 for i in range(5000, 5041)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_with_their_groups(spark, how):
    """A group of a third of the rows is joined by broadcast, the others by a shuffle; nothing is lost or doubled."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 4000).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("c"))
    few = groups.where("k < 2000")
    got = with_groups(rows, few, ["k"], ["low", "c"], "c", 9000, "id", how).collect()
    want: dict[int, list] = {}
    for r in rows.collect():
        want.setdefault(r["k"], []).append(r["id"])
    kept = [r for r in got if r["k"] < 2000]
    assert sorted(r["id"] for r in kept) == sorted(i for k, v in want.items() if k < 2000 for i in v)
    assert all((r["low"], r["c"]) == (min(want[r["k"]]), len(want[r["k"]])) for r in kept)
    others = [r for r in got if r["k"] >= 2000]
    assert len(others) == (0 if how == "inner" else sum(len(v) for k, v in want.items() if k >= 2000)) and all(r["low"] is None for r in others)


@pytest.mark.parametrize("most", [simhash.GONE_BROADCAST, 0])
def test_near_duplicates_with_ties_and_nulls(spark, monkeypatch, most):
    """By broadcast and by a Bloom filter. Null ids name a component, rows of one id are told apart, rows equal in every column stay together."""
    monkeypatch.setattr(simhash, "GONE_BROADCAST", most)
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text, "a"), (5, text, "b"), (None, text, "c"), (9, text + " end", "d"), (7, "other words here now", "e"), (7, "other words here now", "e"), (8, None, "f"), (3, "", "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = sorted(map(tuple, simhash.drop_near_duplicates(d).collect()), key=str)
    assert kept == sorted([(None, text, "c"), (7, "other words here now", "e"), (7, "other words here now", "e"), (3, "", "g")], key=str)
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(d.where("doc_id is not null")).collect()}
    assert got == {5: 5, 9: 5, 7: 7, 8: 3, 3: 3}
