"""SimHash near-duplicates, candidates pruned by pigeonring filtering.

A 64-bit fingerprint is laid out as a ring of ``m`` segments. If two differ in
at most ``t`` bits, some segment starts a chain all of whose prefixes of length
l differ in at most floor(l * t / m) bits (the strong pigeonhole form). The
first ``chain`` segments of such a chain agree but for floor(chain * t / m) of
them, at places the budgets allow, so fingerprints are joined on the agreeing
segments (one key per start and per allowed set of places); every pair the join
finds is held to all of its chain's budgets and last, at length m, to the full
Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import cut, members_of, release, row_hash, with_groups
from groundwell.llm.exact_dedup import SLICE_BLOCKS, bitmaps, filter_blocks, flagged
from groundwell.llm.graph import components

BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> bytes:
    """Big-endian SimHash: a bit is 1 if set in over half of the shingles' XXH64 (seed 42)."""
    import numpy as np
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(tokens))
    n = len(tokens) - k + 1
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[k - 1 :].tolist()))
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, pieces, repeat(42))), np.uint8).reshape(n, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 32_768):
        ones += np.unpackbits(digests[i : i + 32_768], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(df: DataFrame, text: str, keep: list[Column], types: str, shingle: int = 4) -> DataFrame:
    """``keep`` columns (DDL ``types``) and ``fp`` long, in Arrow batches; no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [int.from_bytes(fingerprint(x.as_py(), shingle), "big", signed=True) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*batch.schema.names[:-1], "fp"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{types}, fp long")


def ring(m: int, chain: int, t: int, bits: int = BITS) -> tuple[list[int], list[list[int]]]:
    """Key masks, and for each key the m prefix masks of its chain."""
    cuts = [bits * i // m for i in range(m + 1)]
    segment = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(m)]
    free = chain * t // m
    places = [w for w in combinations(range(chain), free) if all(sum(p < l for p in w) <= l * t // m for l in range(1, chain + 1))]
    masks, prefixes = [], []
    for start in range(m):
        at = [segment[(start + l) % m] for l in range(m)]
        for w in places:
            masks.append(sum(at[l] for l in range(chain) if l not in w))
            prefixes.append([sum(at[: l + 1]) for l in range(m)])
    return masks, prefixes


#: Chain lengths in use: a longer chain agrees on more segments at more places.
CHAINS = (4, 6, 8)
#: Comparisons in one key beyond which its members are split by keys of the next longer chain.
HEAVY = 1 << 20
#: Rows to drop, as (id, hash) pairs, that are sent to every executor: some 25 MB. Of more a Bloom filter is.
GONE_BROADCAST = 1 << 19
#: Fingerprints outside a key's main component that one task compares with the rest of the key.
SALTED = 1024
#: Comparisons for each member of the open keys that are made without a further round of stars; chance matches take under two, the check tool's large group five.
COMPARED = 16


def ring_shape(n: int, m: int = 9, t: int = 4, wanted: float = 1.0) -> tuple[int, int]:
    """(m, chain): the shortest chain whose keys have about ``wanted`` chance matches among n fingerprints of even bits."""
    for chain in CHAINS:
        agreed = chain - chain * t // m
        if n <= wanted * 2 ** (BITS * agreed / m) or chain == CHAINS[-1]:
            return m, chain
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(masks: list[int]) -> Column:
    """A (p, k) pair for each mask: its number and the bits of ``fp`` it leaves."""
    return F.array(*[F.struct(F.lit(p).alias("p"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("k")) for p, x in enumerate(masks)])


def _near(a: Column, b: Column, prefixes: list[list[int]], t: int) -> Column:
    """Whether ``a`` and ``b`` keep all budgets of the chain of key number ``p``; the last budget is the full distance."""
    m, differ, ok = len(prefixes[0]), a.bitwiseXOR(b), F.lit(True)
    for l in range(m):
        mask = F.get(F.array(*[F.lit(_signed(x[l])) for x in prefixes]), F.col("p")) if l < m - 1 else F.lit(-1)
        ok &= F.bit_count(differ.bitwiseAND(mask)) <= (l + 1) * t // m
    return ok


def _crowds(keyed: DataFrame, n_keyed: int) -> DataFrame:
    """(p, k, fp, hub) of the keys that two fingerprints or more share; ``hub`` is the key's most frequent one."""
    crowd = keyed.groupBy("p", "k").agg(F.max(F.struct("n", "fp")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("p", "k", F.col("hub.fp").alias("hub"), "size")
    return cut(members_of(keyed, cut(crowd), ["p", "k"], ["hub"], "size", n_keyed).select("p", "k", "fp", "hub"))


def _open_keys(shared: DataFrame, first: DataFrame, n_shared: int) -> DataFrame:
    """(p, k, fp, root, main, size, rest): the members of keys that hold more than one component, with the key's largest, and how many are in and outside it."""
    placed = cut(shared.select("p", "k", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    tally = placed.groupBy("p", "k", "root").agg(F.count(F.lit(1)).alias("c"))
    main = tally.groupBy("p", "k").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    main = cut(main.select("p", "k", F.col("top.root").alias("main"), "size", (F.col("size") - F.col("top.c")).alias("rest")))
    return cut(members_of(placed, main, ["p", "k"], ["main", "size", "rest"], "size", n_shared))


def _merged(first: DataFrame, second: DataFrame, n: int) -> DataFrame:
    """(node, root) of ``first`` with its roots, and nodes it has not, joined as ``second`` has them."""
    sizes = first.groupBy("root").agg(F.count(F.lit(1)).alias("c")).join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root")
    whole = with_groups(first, sizes, ["root"], ["top"], "c", n, "node", "left").select("node", F.coalesce("top", "root").alias("root"))
    return whole.unionByName(second.join(first, "node", "left_anti").select("node", "root"))


def _gathered(shared: DataFrame, first: DataFrame, n: int, t: int) -> tuple[DataFrame, DataFrame]:
    """The open keys' members, and ``first``, after rounds of stars in keys that still take many comparisons.

    A round links each key's members to one fingerprint outside its main
    component. The rounds end with the first that does not halve the comparisons.
    """
    n_shared = shared.count()
    members, before = _open_keys(shared, first, n_shared), None
    while True:
        count, work = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("rest"), F.lit(0))).first()
        if work <= COMPARED * count or before is not None and 2 * work > before:
            return members, first
        before = work
        hubs = members.where("root <> main").groupBy("p", "k").agg(F.max(F.struct(F.xxhash64("p", "fp"), "fp", "root")).alias("hub"), F.max("size").alias("size"))
        hubs = cut(hubs.select("p", "k", F.col("hub.fp").alias("hub"), F.col("hub.root").alias("hub_root"), "size"))
        near = (F.col("root") != F.col("hub_root")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= t)
        star = members_of(members, hubs, ["p", "k"], ["hub", "hub_root"], "size", count).where(near)
        first = cut(_merged(first, components(star.select("root", "hub_root"), "root", "hub_root"), n))
        release(members)
        members = _open_keys(shared, first, n_shared)


def _pairs(members: DataFrame, prefixes: list[list[int]], t: int) -> DataFrame:
    """(ra, rb): components that a pair within the budgets links. The left side is salted, the right side repeated for each salt."""
    salts = F.floor((F.col("rest") - 1) / SALTED)
    left = members.where("root <> main").select("p", "k", F.col("fp").alias("a"), F.col("root").alias("ra"), F.pmod(F.xxhash64("fp"), salts + 1).alias("salt"))
    right = members.select(F.col("p").alias("p2"), F.col("k").alias("k2"), F.col("fp").alias("b"), F.col("root").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt2"))
    same = (F.col("p") == F.col("p2")) & (F.col("k") == F.col("k2")) & (F.col("salt") == F.col("salt2"))
    return left.join(right, same & (F.col("ra") != F.col("rb")) & _near(F.col("a"), F.col("b"), prefixes, t)).select("ra", "rb").distinct()


def links(nodes: DataFrame, n: int, t: int = 4, m: int = 9, chain: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """(fp, root) for every fingerprint with another one in reach, over steps of at most ``t`` bits.

    ``nodes`` has distinct ``fp`` and its number of rows ``n``. Within one key a
    first pass links each fingerprint to the key's most frequent one, which
    turns a large group of near copies into a star, and so do further rounds while
    many comparisons are left; the second pass joins only fingerprints outside
    the key's main component with the rest of the key. So
    every pair is either linked already or compared, and the work in a group of
    k near copies is about k rather than k * k. Keys that would still take more
    than ``heavy`` comparisons (short texts set few bits, so their fingerprints
    share many) are split by the next longer chain: a pair that keeps the
    budgets has a common key at every length of the chain it starts.
    """
    chain = chain or ring_shape(n, m, t)[1]
    masks, prefixes = ring(m, chain, t)
    keyed = cut(nodes.select("fp", "n", F.explode(_keys(masks)).alias("key")).select("fp", "n", "key.p", "key.k"))
    shared = _crowds(keyed, n * len(masks))
    release(keyed)
    # The hub pass needs no chain of its own: any two within t bits are a link.
    star = shared.where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= t)).select("fp", "hub").distinct()
    first = components(star, "fp", "hub")
    members, first = _gathered(shared, first, n, t)
    found = []
    while True:
        is_heavy = F.col("size") * F.col("rest") > heavy
        last = chain == CHAINS[-1]
        found.append(_pairs(members if last else members.where(~is_heavy), prefixes, t))
        crowded = members.where(is_heavy)
        if last or crowded.isEmpty():
            break
        chain = CHAINS[CHAINS.index(chain) + 1]
        finer, budgets = ring(m, chain, t)
        # a key number's start is that of its prefixes; its members go on to all keys of the longer chain there
        goes = [[q for q, y in enumerate(budgets) if y[0] == x[0]] for x in prefixes]
        nexts = F.get(F.array(*[F.array(*map(F.lit, g)) for g in goes]), F.col("p"))
        keyed = cut(crowded.select("fp", "p").distinct().select("fp", F.explode(F.transform(nexts, lambda q: F.get(_keys(finer), q))).alias("key")).select("fp", F.lit(1).alias("n"), "key.p", "key.k").distinct())
        prefixes = budgets
        shared = _crowds(keyed, keyed.count())
        members = _open_keys(shared, first, shared.count())
    more = found[0]
    for pairs in found[1:]:
        more = more.unionByName(pairs)
    second = components(more.distinct(), "ra", "rb")
    return _merged(first, second, n).select(F.col("node").alias("fp"), "root")


def _with_least(placed: DataFrame, low: str, n: int) -> DataFrame:
    """``placed`` (fp, root, ...) with ``least``: the smallest ``low`` of its root."""
    lowest = placed.groupBy("root").agg(F.min(low).alias("least"), F.count(F.lit(1)).alias("c"))
    return with_groups(placed, lowest, ["root"], ["least"], "c", n, "fp")


def with_components(rows: DataFrame, t: int = 4, m: int = 9, chain: int | None = None) -> DataFrame:
    """``rows`` (id, fp, ...) with ``component_id``: the smallest id over fingerprints reachable."""
    nodes = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")))
    n = nodes.count()
    placed = cut(nodes.join(links(nodes, n, t, m, chain), "fp", "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root")))
    found = cut(_with_least(placed, "low", n).select("fp", "n", F.col("least").alias("component_id")))
    return with_groups(rows, found, ["fp"], ["component_id"], "n", rows.count(), "id")


def simhash_groups(df: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 4, t: int = 4) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    Null, empty and blank texts have fingerprint zero, which links like any
    other. Repeated rows are equal fingerprints. Null ids never name a component
    unless all of it is null. An empty table gives no rows; other columns are
    not read. Texts of any length are hashed whole, one at a time.
    """
    rows = cut(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text).alias("body")), "body", [F.col("id")], f"id {dict(df.dtypes)[id_col]}", shingle))
    return with_components(rows, t).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 4, t: int = 4) -> DataFrame:
    """``df`` with one row of each component, that of the smallest id; columns unchanged.

    Several rows with that id are told apart by a hash of the whole row, of
    which the smallest stays; rows equal in every column are one document and
    stay together. Null ids sort before all others. Nulls and empty texts are
    as in :func:`simhash_groups`.
    """
    kind = dict(df.dtypes)[id_col]
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("body"), F.col(id_col).alias("rid"), row_hash(df).alias("tag"))
    rows = cut(fingerprints(tagged, "body", [F.col("rid").alias("id"), F.col("tag")], f"id {kind}, tag long", shingle))
    nodes = cut(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tag")).alias("low")))
    n = nodes.count()
    placed = cut(nodes.join(links(nodes, n, t), "fp", "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root")))
    best = cut(_with_least(placed, "low", n).select("fp", "n", F.col("least").alias("best")))
    known = with_groups(rows, best, ["fp"], ["best"], "n", rows.count(), "tag")
    gone = cut(known.where((F.col("tag") != F.col("best.tag")) | ~F.col("id").eqNullSafe(F.col("best.id"))).select("id", "tag").distinct())
    same, n_gone = (F.col("rid").eqNullSafe(gone.id)) & (tagged.tag == gone.tag), gone.count()
    if n_gone <= GONE_BROADCAST:
        return tagged.join(F.broadcast(gone), same, "left_anti").select("row.*")
    # rows whose hash is not in the filter stay where they are; only the others, few more than go, are shuffled
    blocks = filter_blocks(n_gone, most=SLICE_BLOCKS)
    marks = cut(bitmaps(gone.withColumn("h", F.xxhash64("id", "tag")), "h", blocks, 1))
    seen = flagged(tagged.withColumn("h", F.xxhash64("rid", "tag")), marks, "h", blocks)
    maybe = seen.where("maybe")
    held = maybe.join(gone, maybe.rid.eqNullSafe(gone.id) & (maybe.tag == gone.tag), "left_anti")
    return seen.where("not maybe").select("row.*").unionByName(held.select("row.*"))
