"""Exact deduplication behind a two-pass Bloom filter, in DataFrame functions only.

The filter is blocked: a row's hash chooses a block of 32,768 positions and two
positions in it, and a block is one packed bitmap of 4 KB. Pass one inserts every
hash and keeps the positions that were set more than once. Pass two tests every
row against the broadcast bitmaps: a row of which either position was set only
once has no equal anywhere and passes straight through; only the others are
shuffled and grouped by their full SHA-256. A false positive therefore costs a
shuffled row and never a wrong answer.

What moves in pass one are positions, not rows: (block, position) pairs counted
before the exchange, then the repeated ones alone. Bitmaps made by every task
would have to be merged as often as there are tasks, which moves more bytes as
soon as a task holds less than a quarter of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import ascii_lower, cut, row_hash, with_groups

#: Positions in one block (4 KB), fixed by Spark's bitmap functions.
BITMAP_BITS = 32_768
#: Blocks broadcast at a time: 64 MB.
SLICE_BLOCKS = 16_384
#: Passes over the hashes at most: enough for two billion rows at 16 bits each; beyond that the filter is denser.
MOST_SLICES = 64


def filter_blocks(n_rows: int, bits_per_row: int = 16, most: int = SLICE_BLOCKS * MOST_SLICES) -> int:
    """Blocks for ``bits_per_row`` positions a row."""
    return min(most, max(1, -(-n_rows * bits_per_row // BITMAP_BITS)))


def _block(h: str, blocks: int) -> Column:
    return F.pmod(F.col(h), F.lit(blocks)).cast("int")


def _positions(h: str) -> tuple[Column, Column]:
    """Two different positions in the hash's block, from bits of another hash of it."""
    other = F.xxhash64(h)
    first = F.pmod(other, F.lit(BITMAP_BITS))
    step = F.pmod(F.shiftrightunsigned(other, 32), F.lit(BITMAP_BITS - 1)) + 1
    return first.cast("int"), F.pmod(first + step, F.lit(BITMAP_BITS)).cast("int")


def bitmaps(hashed: DataFrame, h: str, blocks: int, least: int) -> DataFrame:
    """Pass one: (block, bits) rows that mark the positions set at least ``least`` times."""
    set_ = hashed.select(_block(h, blocks).alias("block"), F.explode(F.array(*_positions(h))).alias("at"))
    kept = set_.groupBy("block", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # dealt by block first, so that no task makes part of a bitmap that others make too
    return kept.select("block", "at").repartition("block").groupBy("block").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))


def _tested(hashed: DataFrame, marks: DataFrame, h: str, blocks: int) -> DataFrame:
    def bit(at: Column) -> Column:
        byte = F.conv(F.hex(F.substr(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("getbit", byte, at % 8) == 1

    one, two = _positions(h)
    met = hashed.withColumn("__block", _block(h, blocks)).join(F.broadcast(marks), F.col("__block") == F.col("block"), "left")
    return met.select(*hashed.columns, F.coalesce(bit(one) & bit(two), F.lit(False)).alias("maybe"))


def flagged(hashed: DataFrame, marks: DataFrame, h: str, blocks: int, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """Pass two: adds ``maybe``, whether both positions are marked. Larger filters are broadcast slice by slice, each for the rows of its blocks."""
    if blocks <= slice_blocks:
        return _tested(hashed, marks, h, blocks)
    parts = []
    for low in range(0, blocks, slice_blocks):
        rows = hashed.where(_block(h, blocks).between(low, low + slice_blocks - 1))
        parts.append(cut(_tested(rows, marks.where(F.col("block").between(low, low + slice_blocks - 1)), h, blocks)))
    return reduce(DataFrame.unionByName, parts)


def _sha(text: str) -> Column:
    """SHA-256 of the normalised text; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))


def _split(rows: DataFrame, bits_per_row: int, slice_blocks: int) -> tuple[DataFrame, DataFrame, int]:
    """Checkpointed (id, sha, h, tag) ``rows`` as those that pass and those that may repeat, and the number of all."""
    n_rows = rows.count()
    blocks = filter_blocks(n_rows, bits_per_row, slice_blocks * MOST_SLICES)
    known = flagged(rows, cut(bitmaps(rows, "h", blocks, 2)), "h", blocks, slice_blocks)
    return known.where(~F.col("maybe")).drop("maybe"), known.where("maybe").drop("maybe"), n_rows


def exact_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", bits_per_row: int = 16, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null is the empty
    text. Of equal texts the row with the largest id stays; null ids sort below
    all others, and of several rows with that id exactly one stays. An empty
    table gives no rows; columns other than the two named are ignored. The text
    is read once, after that only ids and digests move. Copies of one text do
    not meet in a task: a group of a thousandth of all rows or more is joined by
    broadcast.
    """
    slim = df.select(F.col(id_col).alias("id"), _sha(text).alias("sha"))
    alone, maybe, n_rows = _split(cut(slim.select("id", "sha", F.xxhash64("sha").alias("h"), F.monotonically_increasing_id().alias("tag"))), bits_per_row, slice_blocks)
    groups = cut(maybe.groupBy("sha").agg(F.max(F.struct("id", "tag")).alias("best"), F.count(F.lit(1)).alias("n")))
    grouped = with_groups(maybe, groups, ["sha"], ["best", "n"], "n", n_rows, "tag").select(
        "id", "sha", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("tag") == F.col("best.tag")).alias("kept")
    )
    alone = alone.select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", bits_per_row: int = 16, slice_blocks: int = SLICE_BLOCKS) -> DataFrame:
    """``df`` with one row of each group of equal texts, the one with the largest id; columns unchanged.

    Which texts repeat is found on digests. Rows then pass through unshuffled
    with all their columns unless a second filter, of the repeated digests, has
    them; it is one broadcast at any size, denser where very many texts repeat.
    Several rows with the largest id are told apart by a hash of the whole row;
    rows equal in every column are collapsed to one, being the same row. Nulls,
    empty texts and an empty table behave as in :func:`exact_duplicates`.
    """
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _sha(text).alias("sha"), F.col(id_col).alias("id"), row_hash(df).alias("tag")).withColumn("h", F.xxhash64("sha"))
    _, maybe, _ = _split(cut(keyed.select("id", "sha", "h", "tag")), bits_per_row, slice_blocks)
    # of equal (id, tag) pairs there are as many as rows equal in every column
    pairs = maybe.groupBy("sha", "h", "id", "tag").agg(F.count(F.lit(1)).alias("times"))
    groups = cut(pairs.groupBy("sha", "h").agg(F.max(F.struct("id", "tag", "times")).alias("best"), F.sum("times").alias("n")).where("n > 1"))
    told = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = filter_blocks(int(told[0]), bits_per_row, slice_blocks)
    seen = flagged(keyed, cut(bitmaps(groups, "h", blocks, 1)), "h", blocks, slice_blocks)
    met = with_groups(seen.where("maybe").drop("maybe"), groups, ["sha"], ["best"], "n", int(told[1]), "tag", "left")
    held = met.where(F.col("best").isNull() | ((F.col("tag") == F.col("best.tag")) & F.col("id").eqNullSafe(F.col("best.id"))))
    once = held.where("best is null or best.times = 1").select("row")
    many = held.where("best.times > 1").groupBy("sha", "tag").agg(F.first("row").alias("row")).select("row")
    return seen.where(~F.col("maybe")).select("row").unionByName(once).unionByName(many).select("row.*")
