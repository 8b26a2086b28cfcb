"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). A source whose target is b
whole passes and a rest takes every document b times and fits the rest with a
bounded knapsack over its length counts; the documents that give a length its
extra copies are picked by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import bucket_offsets, cut, row_hash, spread, with_groups, word_count

#: Passes over a source at most.
MOST = 3
#: Sums in a knapsack table at most: 17 bytes each.
TABLE = 1 << 23


def level(total: int, weights: tuple[float, ...], tally) -> float:
    """The words a weight of one stands for, such that all targets add up to ``total``.

    ``tally(level)`` gives the words at which the sources over their cap at
    that level stop, and how many sources of each weight are left. Each pass
    stops those over their cap, which raises the level for the others.
    """
    found = 0.0
    while True:
        stopped, left = tally(found)
        open_ = sum(n * w for n, w in zip(left, weights))
        new = (total - stopped) / open_ if open_ else found
        if new <= found:
            return found
        found = new


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> dict[str | None, float]:
    """Share of the total by weight, none above ``most`` times its source; the excess goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    at = {s: i % len(weights) for i, s in enumerate(names)}

    def tally(found: float) -> tuple[float, list[int]]:
        over = {s for s in names if weights[at[s]] * found > most * sizes[s]}
        return sum(most * sizes[s] for s in over), [sum(at[s] == i for s in names if s not in over) for i in range(len(weights))]

    found = level(sum(sizes.values()), weights, tally)
    return {s: min(weights[at[s]] * found, float(most * sizes[s])) for s in names}


def source_plan(sums: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST, per_part: int = 100_000) -> DataFrame:
    """(src, source_size, target, c) of every (src, s, c): :func:`targets` in a few aggregations, for any number of sources."""
    whole = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("s"), F.lit(0))).first()
    # their order: by code point, null ("n") last; ranges of sources are numbered apart
    order = [F.col("src") == "n", F.col("src")]
    parts = -(-int(whole[0]) // per_part) or 1
    dealt = cut(sums.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [sum(n for q, n in counts.items() if q < p) for p in range(parts)]
    nth = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    known = cut(dealt.withColumn("w", F.pmod(nth, F.lit(len(weights))).cast("int")))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("w"))
    cap = F.col("s") * most

    def tally(found: float) -> tuple[int, list[int]]:
        over = weight * found > cap
        left = [F.count_if(~over & (F.col("w") == i)) for i in range(len(weights))]
        r = known.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), *left).first()
        return int(r[0]), list(r[1:])

    found = level(int(whole[1]), weights, tally)
    return known.select("src", F.col("s").alias("source_size"), F.least(weight * found, cap.cast("double")).alias("target"), "c")


def _with_giants(lengths: list[int], counts: list[int], budget: int, big: list[int]) -> list[int]:
    """:func:`fit_budget` where the lengths ``big`` are too long for its table.

    They give, the longest first, what the others together cannot reach; then
    the others are fitted to what is left, once as it is and once with one
    document more of the shortest that is to be had.
    """
    small = [i for i in range(len(lengths)) if i not in {*big}]
    can = sum(lengths[i] * counts[i] for i in small)
    take, left = [0] * len(lengths), budget
    for i in sorted(big, key=lambda i: -lengths[i]):
        n = max(0, min(counts[i] - take[i], left // lengths[i], -(-(left - can) // lengths[i])))
        take[i] += n
        left -= n * lengths[i]

    def filled(have: list[int], rest: int) -> tuple[int, list[int]]:
        given, out = fit_budget([lengths[i] for i in small], [counts[i] for i in small], max(0, rest)), list(have)
        for i, t in zip(small, given):
            out[i] = t
        return abs(rest - sum(lengths[i] * t for i, t in zip(small, given))), out

    tried = [filled(take, left)]
    more = [i for i in big if take[i] < counts[i]]
    if more:
        i = min(more, key=lambda i: lengths[i])
        tried.append(filled([t + (k == i) for k, t in enumerate(take)], left - lengths[i]))
    return min(tried, key=lambda x: x[0])[1]


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the words come as near ``budget`` as can be.

    Every length first gives its proportional number; the rest, less than one
    document of each length, is cut down greedily from the longest and closed
    by a bounded-knapsack table over sums up to three times the longest
    document. Documents too long for a table of ``TABLE`` sums are chosen first.
    """
    import numpy as np

    total = sum(l * c for l, c in zip(lengths, counts))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    if big := [i for i, l in enumerate(lengths) if l > TABLE // 3]:
        return _with_giants(lengths, counts, budget, big)
    take = [c * budget // total for c in counts]
    rest = budget - sum(l * t for l, t in zip(lengths, take))
    longest = max(lengths)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        while lengths[i] and take[i] < counts[i] and rest - lengths[i] >= longest:
            n = min(counts[i] - take[i], (rest - longest) // lengths[i])
            take[i] += n
            rest -= n * lengths[i]
    # Bounded knapsack: first[s] is the item (length i, how many) that first reached sum s.
    most = rest + longest
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    first_i, first_n = np.full(most + 1, -1, np.int64), np.zeros(most + 1, np.int64)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        spare, part = min(counts[i] - take[i], most // lengths[i] if lengths[i] else 0), 1
        while spare > 0:
            n = min(part, spare)
            spare, part, step = spare - n, part * 2, n * lengths[i]
            if step <= most:
                new = np.zeros_like(reach)
                new[step:] = reach[: most + 1 - step]
                new &= ~reach
                first_i[new], first_n[new] = i, n
                reach |= new
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, n = int(first_i[at]), int(first_n[at])
        take[i] += n
        at -= n * lengths[i]
    return take


def _counted(df: DataFrame, text: str, source: str, weights: tuple[float, ...], seed: int, *ids) -> tuple[DataFrame, DataFrame]:
    """Checkpointed (id..., src, size, h, bucket) rows, and (src, size, bucket, n, before, base, extra, source_size, target).

    Rows are counted by source, length and a bucket of their seeded hash ``h``;
    the extra copies of a length go to its first rows by bucket, then hash.
    """
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    docs = cut(df.select(*ids, key.alias("src"), word_count(F.col(text)).alias("size")))
    docs = docs.withColumn("h", F.xxhash64("id", F.lit(seed)))
    sums = cut(docs.groupBy("src").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")))
    plan = source_plan(sums, weights)
    n_buckets = spread(sums.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    dealt = docs.withColumn("bucket", _bucket(n_buckets))
    offsets = cut(bucket_offsets(dealt, ["src", "size"]))
    by_length = offsets.groupBy("src", "size").agg(F.sum("n").alias("count")).join(plan.drop("c"), "src")

    def fit(pdf):
        import pandas as pd

        size, goal_ = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(MOST, int(goal_ // size)) if size else 0
        budget = round(goal_ - base * size) if base < MOST else 0
        pdf = pdf.sort_values("size")
        extra = fit_budget(pdf["size"].tolist(), pdf["count"].tolist(), budget)
        return pd.DataFrame({"src": pdf["src"], "size": pdf["size"], "source_size": size, "target": goal_, "base": base, "extra": extra})

    fitted = by_length.groupBy("src").applyInPandas(fit, "src string, size long, source_size long, target double, base long, extra long")
    return dealt, offsets.select("src", "size", "bucket", "n", "before").join(fitted, ["src", "size"])


def _bucket(n_buckets: int):
    return F.pmod(F.xxhash64("h"), F.lit(n_buckets)).cast("int")


def mix(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, taken``.

    ``taken`` is the words that the mix takes of the document, repeats counted:
    0 to 3 times its size. Null texts have size 0 and null sources are one
    source, ordered last. Rows of one id are picked apart by their order in the
    seeded hash; which of several equal rows is picked makes no difference to
    the mix. An empty table gives no rows, a table without words takes none.
    There may be any number of sources; what meets in one task are the distinct
    lengths of one source.
    """
    dealt, quota = _counted(df, text, source, weights, seed, F.col(id_col).alias("id"))
    w = Window.partitionBy("src", "size", "bucket").orderBy("h", "id")
    ranked = dealt.join(quota.drop("n"), ["src", "size", "bucket"]).withColumn("rank", F.row_number().over(w))
    copies = F.col("base") + (F.col("rank") <= F.col("extra") - F.col("before")).cast("long")
    return ranked.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


#: Lengths of sources whose cut-offs are sent to every executor: some 30 MB.
CUTOFFS = 1 << 18


def cutoffs(dealt: DataFrame, quota: DataFrame) -> DataFrame:
    """(src, size, rows, base, edge, h_edge, at_edge, held): a length's rows before bucket ``edge``, and in it those of hash below ``h_edge``, get one more copy.

    ``held`` of them have just ``h_edge``, and ``at_edge`` of those get one more.
    """
    room = F.col("extra") - F.col("before")
    edges = quota.where((room > 0) & (room <= F.col("n"))).select("src", "size", "bucket", room.alias("room"))
    near = dealt.join(edges, ["src", "size", "bucket"]).groupBy("src", "size", "bucket", "room", "h").agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy("src", "size", "bucket").orderBy("h"))
    last = near.withColumn("upto", upto).where((F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("held") < F.col("room")))
    last = last.select("src", "size", F.col("bucket").alias("edge"), F.col("h").alias("h_edge"), (F.col("room") - F.col("upto") + F.col("held")).alias("at_edge"), "held")
    return quota.groupBy("src", "size").agg(F.sum("n").alias("rows"), F.max("base").alias("base")).join(last, ["src", "size"], "left")


def apply_mix(df: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mixed table: each row of ``df`` as often as the mix takes it, columns unchanged.

    Documents without words cost nothing and stay once. Rows that share an id
    are told apart by a hash of the whole row; nulls are as in :func:`mix`. What
    a row gets follows from its source, length and hash and the cut-off of its
    length, so texts are not shuffled unless there are very many lengths; only rows equal in every column, where
    some of them get one more copy, are brought together.
    """
    named = F.struct(F.col(id_col).alias("i"), row_hash(df).alias("tag")).alias("id")
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("t"), F.col(source).alias("s"), named)
    dealt, quota = _counted(tagged, "t", "s", weights, seed, F.col("id"))
    edges = cut(cutoffs(dealt, quota))
    n_rows = dealt.count()
    key = F.when(F.col("s").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("s").cast("string")))
    rows = tagged.select("row", key.alias("src"), word_count(F.col("t")).alias("size"), F.xxhash64("id", F.lit(seed)).alias("h")).withColumn("bucket", _bucket(spread(n_rows)))
    if edges.count() <= CUTOFFS:
        known = rows.join(F.broadcast(edges), ["src", "size"])
    else:
        known = with_groups(rows, edges, ["src", "size"], ["base", "edge", "h_edge", "at_edge", "held"], "rows", n_rows, "h")
    at_edge = F.coalesce((F.col("bucket") == F.col("edge")) & (F.col("h") == F.col("h_edge")), F.lit(False))
    below = F.coalesce((F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.col("h") < F.col("h_edge"))), F.lit(False))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("base") + (below | (at_edge & (F.col("at_edge") == F.col("held")))).cast("long")).cast("int")
    known = known.withColumns({"copies": copies, "split": at_edge & (F.col("at_edge") < F.col("held")) & (F.col("size") > 0)})
    times = lambda n: F.explode(F.sequence(F.lit(1), n))
    single = known.where("not split and copies > 0").select("row", times(F.col("copies")).alias("k"))
    equal = known.where("split").groupBy("src", "size", "h").agg(F.first("row").alias("row"), F.first((F.col("base") * F.col("held") + F.col("at_edge")).cast("int")).alias("n"))
    return single.unionByName(equal.where("n > 0").select("row", times(F.col("n")).alias("k"))).select("row.*")
