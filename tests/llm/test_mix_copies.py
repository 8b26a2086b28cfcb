"""The mixed table against the mix: how many words of which source, with repeated rows and many lengths."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from groundwell.llm import mixing

SCHEMA = "doc_id long, text string, source string, bucket int, edge int, row string"


def table(spark, seed=0):
    r = random.Random(seed)
    rows = [(i, "w " * r.randint(0, 12), r.choice(("a", "a", "a", "b", "c", None)), 1, 2, "x") for i in range(700)]
    rows += [rows[3]] * 9 + [(None, "w w w", "a", 1, 2, "x")] * 5 + [(5000, None, "b", 1, 2, "x")] * 3 + [(6000 + i, "one two", "d", 1, 2, "x") for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


@pytest.mark.parametrize("most", [mixing.CUTOFFS, 0])
def test_mixed_rows_are_what_the_mix_takes(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "CUTOFFS", most)  # sent to all, and shuffled
    df, rows = table(spark)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    got = Counter(map(tuple, out.collect()))
    assert set(got) <= set(rows) and all(got[x] == rows.count(x) for x in set(rows) if not (x[1] or "").split())
    taken, of = Counter(), {}
    for r in mixing.mix(df).collect():
        of[r["source_size"], r["target"]] = of.get((r["source_size"], r["target"]), 0) + r["taken"]
    for x, n in got.items():
        taken[x[2]] += n * len((x[1] or "").split())
        assert n <= 3 * rows.count(x)
    sizes = Counter()
    for x in rows:
        sizes[x[2]] += len((x[1] or "").split())
    goal = mixing.targets(dict(sizes))
    assert sorted(of.values()) == sorted(taken[s] for s in sizes)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    # copies of a length differ by one at most
    for s in sizes:
        for n in range(1, 13):
            each = [got[x] / rows.count(x) for x in set(rows) if x[2] == s and len((x[1] or "").split()) == n]
            assert not each or max(each) - min(each) <= 1


def test_mix_does_not_depend_on_the_partitions(spark):
    df, _ = table(spark, 1)
    one = Counter(map(tuple, mixing.apply_mix(df.repartition(1)).collect()))
    assert one == Counter(map(tuple, mixing.apply_mix(df.repartition(7)).collect()))


def test_targets_of_many_sources_equal_the_few(spark):
    r = random.Random(3)
    sizes = {f"s{i:04d}": r.choice((0, 1, 5, 1000, r.randint(0, 50))) for i in range(800)} | {None: 77}
    want = mixing.targets(sizes)
    sums = spark.createDataFrame([("n" if s is None else f"s{s}", n, 1) for s, n in sizes.items()], "src string, s long, c long")
    for per in (100_000, 100):
        got = {None if x["src"] == "n" else x["src"][1:]: (x["source_size"], x["target"]) for x in mixing.source_plan(sums, per_part=per).collect()}
        assert {s: n for s, (n, _) in got.items()} == sizes and {s: t for s, (_, t) in got.items()} == pytest.approx(want)
    assert sum(want.values()) == pytest.approx(sum(sizes.values())) and all(t <= 3 * sizes[s] + 1e-6 for s, t in want.items())
    assert mixing.source_plan(sums.limit(0)).count() == 0


def test_knapsack_of_very_long_texts_stays_bounded(monkeypatch):
    monkeypatch.setattr(mixing, "TABLE", 3000)
    lengths, counts = [3, 50, 900, 10**9, 3 * 10**9], [400, 30, 10, 2, 1]
    total = sum(a * b for a, b in zip(lengths, counts))
    for budget in (1, 777, 12_000, 10**9, 10**9 + 4001, 2 * 10**9 + 12, 3 * 10**9 + 5000, total - 1):
        take = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(a * t for a, t in zip(lengths, take))
        whole = min(abs(sum(x * 10**9 for x in (a, 3 * b)) + small - budget) for a in range(3) for b in range(2) for small in (0, 11_700, max(0, min(11_700, budget - (a + 3 * b) * 10**9))))
        assert abs(got - budget) <= max(whole, 3), (budget, got)
