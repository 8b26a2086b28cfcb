"""Sharding by balanced label propagation under capacity quotas.

Documents with equal texts are linked. All copies of a text have one size, so
the graph is held as cells (text, shard, number of copies) and a round moves
copies between cells: each text asks for the shard that already holds most of
it, and every shard grants the same fraction of its askers, as far as its room
and what leaves it in the same round allow. Texts that are too large for one
shard end up in several. Texts that are still scattered but would fit are dealt
whole, and so are small ones that an overfull shard gives back; then unlinked
documents, and copies of larger texts that had to be given back, fill each shard
to the same number of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import bucket_offsets, cut, release, spread, with_groups


def _uniform(*cols: Column | str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _loads(cells: DataFrame, shards: int) -> list[int]:
    """Bytes by shard: one number a shard reaches the driver."""
    found = {r["shard"]: int(r["b"]) for r in cells.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _merged(cells: DataFrame) -> DataFrame:
    return cells.where("n > 0").groupBy("text_key", "size", "shard").agg(F.sum("n").alias("n"))


def grants(asking: list[tuple[int, int, int]], room: list[float]) -> list[float]:
    """The largest shares of its askers (from, to, bytes) that every shard can grant when what leaves a shard counts as room."""
    asked, share = [0.0] * len(room), [1.0] * len(room)
    for _, to, b in asking:
        asked[to] += b
    for _ in range(1000):
        leaves = [0.0] * len(room)
        for at, to, b in asking:
            leaves[at] += b * share[to]
        new = [min(x, (r + out) / a) if a else x for x, r, out, a in zip(share, room, leaves, asked)]
        still = max(x - y for x, y in zip(share, new)) < 1e-6
        share = new
        if still:
            break
    return share


def propagate(cells: DataFrame, shards: int, quota: float, whole: float, rounds: int | None, seed: int) -> DataFrame:
    """Cells (text_key, size, shard, n) after moves towards each text's main shard, until none moves or for ``rounds``.

    Cells of at most ``whole`` bytes move whole, all those of a text or none. A move adds to the sum of the squares of n, so the rounds end.
    """
    r = 0
    while rounds is None or r < rounds:
        # The main shard: where most copies are; ties go by a hash, another one each round, so that no shard is favoured.
        best = cells.groupBy("text_key").agg(F.max(F.struct("n", F.xxhash64("text_key", "shard", F.lit(seed + r)).alias("h"), "shard")).alias("m"))
        asked = cut(cells.join(best.select("text_key", F.col("m.shard").alias("to")), "text_key"))
        pairs = sorted(asked.where("shard <> to").groupBy("shard", "to").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect())
        if not pairs:
            break
        share = grants([(p["shard"], p["to"], int(p["b"])) for p in pairs], [max(0.0, quota - x) for x in _loads(cells, shards)])
        granted = F.get(F.array(*[F.lit(x) for x in share]), F.col("to"))
        some = F.least(F.col("n"), F.floor(F.col("n") * granted + _uniform("text_key", "shard", F.lit(seed + r))))
        every = F.when(_uniform("text_key", F.lit(seed + r)) < granted, F.col("n")).otherwise(0)
        moves = F.when(F.col("n") * F.col("size") <= whole, every).otherwise(some).cast("long")
        moved = asked.withColumn("k", F.when(F.col("shard") == F.col("to"), F.lit(0)).otherwise(moves))
        if moved.where("k > 0").isEmpty():
            break
        last = cells
        cells = cut(
            _merged(
                moved.select("text_key", "size", "shard", (F.col("n") - F.col("k")).alias("n")).unionByName(
                    moved.select("text_key", "size", F.col("to").alias("shard"), F.col("k").alias("n"))
                )
            )
        )
        release(asked)
        if r:
            release(last)
        r += 1
    return cells


def _dealt(cells: DataFrame, units: DataFrame, shards: int, fair: float, seed: int) -> DataFrame:
    """``cells`` and the (text_key, size, n) of ``units``, each text whole, in the room that ``cells`` leave."""
    key = F.col("text_key")
    items = cut(units.groupBy("text_key", "size").agg(F.sum("n").alias("n")).select(key.alias("id"), (F.col("n") * F.col("size")).alias("size"), F.col("size").alias("one"), "n", key.alias("tag")))
    room = [max(0.0, fair - x) for x in _loads(cells, shards)]
    dealt = fill(items, room, items.count(), seed)
    return cut(_merged(cells.unionByName(dealt.select(F.col("id").alias("text_key"), F.col("one").alias("size"), "shard", "n"))))


def settle(cells: DataFrame, shards: int, fair: float, whole: float, limit: float, seed: int) -> DataFrame:
    """Cells with scattered texts of up to ``whole`` bytes together, and without what shards hold above ``fair``.

    An overfull shard gives back texts whole, small ones of up to ``limit``
    bytes first: they are ordered by a hash in ``steps`` steps, and only the
    last step that is reached is given back in part. Small ones are dealt anew.
    """
    steps = 1024
    per = cells.groupBy("text_key").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.count(F.lit(1)).alias("parts"))
    known = cut(cells.join(per.select("text_key", ((F.col("bytes") <= whole) & (F.col("parts") > 1)).alias("stray")), "text_key"))
    cells = _dealt(known.where("not stray").drop("stray"), known.where("stray").drop("stray"), shards, fair, seed + 3)
    step = F.pmod(F.xxhash64("text_key", F.lit(seed)), F.lit(steps)) + F.when(F.col("small"), 0).otherwise(steps)
    held = cells.withColumn("small", F.col("n") * F.col("size") <= limit).withColumn("step", step.cast("int"))
    sums = [{} for _ in range(shards)]
    for r in held.groupBy("shard", "step").agg(F.sum(F.col("n") * F.col("size")).alias("b")).collect():
        sums[r["shard"]][r["step"]] = int(r["b"])
    last, part = [], []
    for by in sums:
        need, at, f = sum(by.values()) - fair, -1, 0.0
        for k in sorted(by):
            if need <= 0:
                break
            at, f = k, min(1.0, need / by[k])
            need -= by[k]
        last.append(at)
        part.append(f)
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.col("shard"))
    share = F.when(F.col("step") < pick(last), 1.0).when(F.col("step") == pick(last), pick(part)).otherwise(0.0)
    u = _uniform("text_key", "shard", F.lit(seed + 1))
    back = F.when(F.col("small"), F.when(u < share, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.floor(F.col("n") * share + u)))
    held = cut(held.withColumn("back", back.cast("long")))
    kept = held.select("text_key", "size", "shard", (F.col("n") - F.col("back")).alias("n")).where("n > 0")
    return _dealt(kept, held.where("small and back > 0").select("text_key", "size", "n"), shards, fair, seed + 2)


def fill(free: DataFrame, room: list[float], n_free: int, seed: int, block_rows: int = 8192) -> DataFrame:
    """Adds ``shard`` to (id, size, ...) rows so that shard s gains bytes in proportion to ``room[s]``.

    Rows are dealt to blocks of bounded size by a hash; each block, largest
    document first, gives to the shard that is furthest below its share.
    """
    blocks = max(1, -(-n_free // block_rows))
    total = sum(room) or 1.0
    shares = [x / total for x in room] if sum(room) else [1 / len(room)] * len(room)

    def run(pdf):
        import heapq

        pdf = pdf.sort_values(["size", "id", "tag"], ascending=[False, True, True], kind="stable")
        goal = float(pdf["size"].sum())
        heap = [(-s * goal, i) for i, s in enumerate(shares)]
        heapq.heapify(heap)
        out = []
        for size in pdf["size"].tolist():
            lack, i = heap[0]
            out.append(i)
            heapq.heapreplace(heap, (lack + size, i))
        return pdf.assign(shard=out)[[*names, "shard"]].astype({"shard": "int32"})

    names = free.columns
    dealt = free.withColumn("block", F.pmod(F.xxhash64("tag", F.lit(seed)), F.lit(blocks)))
    schema = ", ".join(f"`{c}` {t}" for c, t in free.dtypes)
    return dealt.groupBy("block").applyInPandas(run, f"{schema}, shard int")


def _numbered(slim: DataFrame, seed: int, chunk: int = 1024) -> DataFrame:
    """(id, size, crc, text_key, tag), with a ``tag`` that follows from the row and its number among rows equal to it.

    Equal rows are counted before they are numbered, and where one stands for
    many they are laid out in chunks by several tasks.
    """
    names = slim.columns
    counted = cut(slim.groupBy(*names).agg(F.count(F.lit(1)).alias("times")))
    many = (counted.agg(F.max("times")).first()[0] or 0) > 100 * chunk
    if counted.where("times > 1").isEmpty():
        rows = counted.select(*names, F.lit(0).cast("long").alias("nth"))
    else:
        rows = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {chunk}"))).alias("part"))
        rows = rows.repartition(*names, "part") if many else rows
        first = F.col("part") * chunk
        rows = rows.select(*names, F.explode(F.sequence(first, F.least(first + chunk, F.col("times")) - 1)).alias("nth"))
    return cut(rows.select(*names, F.xxhash64("id", "text_key", "nth", F.lit(seed)).alias("tag")))


def shard_documents(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", shards: int = 16, rounds: int | None = None, slack: float = 0.02, seed: int = 5
) -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards hold near equal numbers of bytes, a document
    counting its UTF-8 length (null: none) and one. Copies of a text share a
    shard as far as that allows. Slots count from 0 in each shard without gaps.
    Null and empty texts are copies of one another; repeated rows are documents
    of their own; an empty table gives no rows; other columns are not read. The
    result depends on the rows only, not on the files or partitions they are in.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = df.select(F.col(id_col).alias("id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.unhex(F.md5(body)).alias("text_key"))
    docs = _numbered(slim, seed)
    whole = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_rows, total = int(whole[0]), float(whole[1])
    n_buckets = spread(n_rows)
    docs = docs.withColumns({"shard0": F.pmod(F.xxhash64("tag", F.lit(seed)), F.lit(shards)).cast("int"), "bucket": F.pmod(F.xxhash64("tag", F.lit(seed + 1)), F.lit(n_buckets)).cast("int")})
    cells = cut(docs.groupBy("text_key", "size", "shard0").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("shard0", "shard"))
    linked_keys = cut(cells.groupBy("text_key").agg(F.sum("n").alias("copies")).where("copies > 1"))
    cells = cut(cells.join(linked_keys, "text_key").select("text_key", "size", "shard", "n"))
    fair = total / shards
    whole = fair / 4
    cells = propagate(cells, shards, fair * (1 - slack), whole, rounds, seed)
    # Small texts: so that the blocks in which they are dealt leave shards even within the slack.
    kept = settle(cells, shards, fair, whole, slack * fair / max(1, -(-n_rows // 8192)) ** 0.5, seed + 99)
    loads = _loads(kept, shards)
    room = [max(0.0, fair - x) for x in loads]
    # Which copy goes where: copies are numbered within their text, and shard after shard takes the next n.
    plan = kept.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("plan"))
    known = cut(with_groups(docs, linked_keys, ["text_key"], ["copies"], "copies", n_rows, "tag", "left"))
    linked = known.where("copies > 1")
    per = bucket_offsets(linked, ["text_key"]).select("text_key", "bucket", "before").join(plan, "text_key", "left")
    w = Window.partitionBy("text_key", "bucket").orderBy("tag", "id")
    numbered = linked.join(per, ["text_key", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(w) - 1)
    find = F.aggregate(
        F.coalesce("plan", F.array().cast("array<struct<shard:int,n:bigint>>")),
        F.struct(F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("shard")),
        lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.when((a["shard"] < 0) & (F.col("rank") < a["upto"] + x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard")),
        lambda a: a["shard"],
    )
    placed = cut(numbered.select("id", "size", "crc", "tag", find.alias("shard")))
    cols = ["id", "size", "crc", "tag"]
    free = known.where("copies is null").select(*cols).unionByName(placed.where("shard < 0").select(*cols))
    done = cut(fill(free, room, n_rows, seed + 2).unionByName(placed.where("shard >= 0").select(*cols, "shard")))
    done = done.withColumn("bucket", F.pmod(F.xxhash64("tag", F.lit(seed + 3)), F.lit(n_buckets)).cast("int"))
    offsets = bucket_offsets(done, ["shard"]).select("shard", "bucket", "before")
    slots = Window.partitionBy("shard", "bucket").orderBy("tag", "id", "crc")
    return done.join(offsets, ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.row_number().over(slots) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
