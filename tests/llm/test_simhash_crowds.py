"""Large groups of near copies: what the joins make, and that comparisons do not grow with the square of the group."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.llm import simhash
from groundwell.llm.common import members_of

SIGN = lambda x: x - (1 << 64) if x >= 1 << 63 else x


def cloud(spark, size: int, others: int):
    """``size`` fingerprints at three bits from one that is absent, and ``others`` of even bits."""
    rng = np.random.default_rng(size)
    centre, out = int(rng.integers(0, 1 << 63)), set()
    while len(out) < size:
        out.add(centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    while len(out) < size + others:
        out.add(int(rng.integers(0, 1 << 64, dtype=np.uint64)))
    return spark.createDataFrame([(SIGN(x), 1) for x in sorted(out)], "fp long, n long").repartition(3)


def made_by_joins(spark, after: int) -> list[int]:
    """Rows of each join of the executions from number ``after`` on."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    for i in range(store.executionsList().size()):
        number = store.executionsList().apply(i).executionId()
        if number < after:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for m in map(node.metrics().apply, range(node.metrics().size())) if "Join" in node.name() else ():
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_joins_make_rows_of_shared_keys_only(spark):
    """Each fingerprint has 18 keys; those that no other has must not come out of a join."""
    nodes = cloud(spark, 200, 3800).cache()
    nodes.count()
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    last = store.executionsList()
    after = max((last.apply(i).executionId() for i in range(last.size())), default=-1) + 1
    got = simhash.links(nodes, 4000).collect()
    made = made_by_joins(spark, after)
    assert len({r["root"] for r in got}) == 1 and len(got) == 200
    assert made and max(made) <= 18 * 200 + 4000


def test_comparisons_of_a_large_group(spark, monkeypatch):
    """One star a key leaves some 115,000 comparisons, four times as many as for half the group; further stars leave few."""
    monkeypatch.setattr(simhash, "COMPARED", 1, raising=False)
    left, pairs = [], simhash._pairs
    monkeypatch.setattr(simhash, "_pairs", lambda members, *a: left.append(members.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]) or pairs(members, *a))
    got = simhash.links(cloud(spark, 3000, 100), 3100).collect()
    assert len(got) == 3000 and len({r["root"] for r in got}) == 1
    assert sum(left) <= 30_000, left


@pytest.mark.parametrize("chain, heavy", [(4, 40), (6, simhash.HEAVY)])
def test_rounds_of_stars_by_brute_force(spark, monkeypatch, chain, heavy):
    """Rounds in every open key, with hot and cold ones, lose no link and make none."""
    from tests.llm.test_simhash_links import roots, sparse_and_near

    monkeypatch.setattr(simhash, "COMPARED", 0)
    fps = sparse_and_near(40 + chain)
    nodes = spark.createDataFrame([(SIGN(x), 1 + x % 3) for x in fps], "fp long, n long").repartition(3)
    got: dict[int, set] = {}
    for r in simhash.links(nodes, len(fps), chain=chain, heavy=heavy).collect():
        got.setdefault(r["root"], set()).add(r["fp"] % (1 << 64))
    assert {frozenset(g) for g in got.values()} == {g for g in roots(fps, 4).values() if len(g) > 1}


def test_members_of_hot_and_cold_groups(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 4000).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("c")).where("k < 2000").cache()
    want = {(r["k"], r["id"]) for r in rows.where("k < 2000").collect()}
    for n_rows in (9000, 10_000_000):
        got = members_of(rows, groups, ["k"], ["low"], "c", n_rows).collect()
        assert len(got) == len(want) and {(r["k"], r["id"]) for r in got} == want
        assert {(r["k"], r["low"]) for r in got} == {(r["k"], r["low"]) for r in groups.collect()}
