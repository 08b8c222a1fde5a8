"""Packing whole groups into batches of bounded size.

Next-fit: groups go in order into the open batch while they fit; one that does not closes it and opens the next. Singletons
fill the room that closed batches leave, in order, then batches of their own. What a group's batch is depends on all groups
before it, but only through the fill level of the open batch, of which there are ``size + 1``: a block of groups is a function
from the level it finds to the level it leaves, with the batches it closes and the room left in them. Blocks compute
their functions side by side, the functions are composed in order, and a second pass packs each block from its own level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .splits import BIN_BITS, hash32, ranked_by

#: Groups of one block, unless there would be more than `BLOCKS` blocks.
BLOCK, BLOCKS = 100_000, 10_000


def transitions(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each level 0..size that a block may find: the level it leaves, the batches it closes, the room left in them."""
    level, closed, room = np.arange(size + 1), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    for k, n in enumerate(sizes.tolist()):
        over = level + n > size
        room += np.where(over, size - level, 0)
        closed += over
        level = np.where(over, n, level + n)
        if (level == level[0]).all():  # from here on all levels go the same way
            end, shut, left = packed(sizes[k + 1 :], size, int(level[0]))[1:]
            return np.full(size + 1, end), closed + len(shut), room + sum(left)
    return level, closed, room


def packed(sizes: np.ndarray, size: int, level: int) -> tuple[list[int], int, list[int], list[int]]:
    """The batch of each group (counted from the open one), the level in the end, and the batches closed with their room."""
    batch, at, shut, room = [], 0, [], []
    for n in sizes.tolist():
        if level + n > size:
            shut.append(at)
            room.append(size - level)
            at, level = at + 1, 0
        level += n
        batch.append(at)
    return batch, level, shut, room


def _tables(size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("hash", "ascending"), ("group", "ascending")])
        level, closed, room = transitions(table.column("n").to_numpy(), size)
        return pa.table([table.column("block").slice(0, 1), pa.array([level.tolist()]), pa.array([closed.tolist()]), pa.array([room.tolist()])], ["block", "level", "closed", "room"])

    return run


def _places(size: int):
    """A row a group with its batch, and a row a closed batch with its room and the room before it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("hash", "ascending"), ("group", "ascending")])
        first, before, level = (table.column(c)[0].as_py() for c in ("first", "before", "found"))
        batch, _, shut, room = packed(table.column("n").to_numpy(), size, level)
        ends = before + np.cumsum(np.array(room, np.int64))
        nothing = pa.nulls(len(batch), pa.int64())
        groups = pa.table([table.column("group"), pa.array(np.array(batch, np.int64) + first), nothing, nothing], ["group", "batch", "room", "before"])
        closed = pa.table([pa.nulls(len(shut), groups.schema.field("group").type), pa.array(np.array(shut, np.int64) + first), pa.array(room, pa.int64()), pa.array(ends - np.array(room, np.int64))], ["group", "batch", "room", "before"])
        return pa.concat_tables([groups, closed])

    return run


def pack(df: DataFrame, group: Column, key: str, size: int, seed: int = 42) -> DataFrame:  # W14
    """``df`` with ``batch``: rows of a group (see ``group``; null for singletons) share one, and none holds more than
    ``size`` rows. Groups come in the order of a seeded hash, as do singletons, by ``key``. A group of more than
    ``size`` rows fits nowhere and gets a null batch."""
    spark = df.sparkSession
    rows = df.withColumn("_g", group.cast("string"))
    groups = durable(rows.where("_g IS NOT NULL").groupBy("_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= size).select(F.col("_g").alias("group"), "n", hash32(F.col("_g"), seed).alias("hash")), "batch-groups")
    blocks = min(BLOCKS, -(-groups.count() // BLOCK)) or 1
    placed = groups.withColumn("block", F.floor(F.col("hash") * blocks / F.lit(1 << 32)).cast("int"))
    found = {r["block"]: r for r in placed.groupBy("block").applyInArrow(_tables(size), "block int, level array<bigint>, closed array<bigint>, room array<bigint>").collect()}  # at most `BLOCKS`
    level = batch = before = 0
    starts = []
    for b in sorted(found):
        starts.append((b, level, batch, before))
        r = found[b]
        level, batch, before = r["level"][level], batch + r["closed"][level], before + r["room"][level]
    table = spark.createDataFrame(starts, "block int, found bigint, first bigint, before bigint")
    both = durable(placed.join(F.broadcast(table), "block").groupBy("block").applyInArrow(_places(size), "group string, batch bigint, room bigint, before bigint"), "batch-places")
    # the k-th singleton takes the k-th free place; behind the last closed batch come the open one's places, then new batches
    slots = both.where("room > 0").select("batch", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("room") - 1)).alias("_k"))
    h = hash32(F.col(key), seed)
    alone = ranked_by(rows.where("_g IS NULL"), [h, F.col(key)], F.shiftright(h, BIN_BITS)).withColumn("_k", F.col("_rn") - 1).drop("_rn", "_n")
    behind = F.lit(batch) + F.floor((F.col("_k") - before + level) / size)
    filled = alone.join(slots, "_k", "left").withColumn("batch", F.coalesce("batch", behind.cast("bigint")))
    whole = rows.join(both.where("room IS NULL").select(F.col("group").alias("_g"), "batch"), "_g", "left").where("_g IS NOT NULL")
    return whole.select(*df.columns, "batch").unionByName(filled.select(*df.columns, "batch"))
