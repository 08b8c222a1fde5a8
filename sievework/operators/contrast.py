"""Contrastive loss within groups (NT-Xent with labels).

For a row i of a group: minus the log of the share of its positives (rows of the group with its label) among all other
rows of the group, each counted as exp(cosine / temperature). Rows without a positive, and rows of no group, add nothing.

All pairs of a group have to be looked at, but none leaves the task that does. A group is cut into blocks of about
`BLOCK` rows; each pair of blocks is one unit of work, whatever the group's size, and gives for every row the greatest
exponent and the sum relative to it, of its positives and of all others. These merge by the rules of log-sum-exp. A row
is sent once a block of its group, so small groups move once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

BLOCK, TILE = 8192, 1024


def _lse(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value and sum of exponentials relative to it, of the masked values of each row; -inf and 0 for none."""
    top = np.where(mask, x, -np.inf).max(1, initial=-np.inf)
    base = np.where(np.isfinite(top), top, 0.0)
    return top, np.where(mask, np.exp(np.minimum(x - base[:, None], 0.0)), 0.0).sum(1)


def _add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum(a[0], b[0])
    base = np.where(np.isfinite(top), top, 0.0)
    return top, sum(s * np.exp(np.where(np.isfinite(m), m - base, -np.inf)) for m, s in (a, b))


def _one_way(x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray, same: bool, temperature: float) -> list[np.ndarray]:
    """For each row of x over the rows of y: log-sum-exp of all and of positives, tile by tile."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i in range(0, len(x), TILE):
        rows = slice(i, i + TILE)
        n = len(x[rows])
        every = near = (np.full(n, -np.inf), np.zeros(n))
        for j in range(0, len(y), TILE):
            cols = slice(j, j + TILE)
            z = x[rows] @ y[cols].T / temperature
            other = np.ones(z.shape, bool)
            if same and i == j:
                np.fill_diagonal(other, False)
            every, near = _add(every, _lse(z, other)), _add(near, _lse(z, other & (lx[rows][:, None] == ly[cols][None, :])))
        for k, v in enumerate((*every, *near)):
            out[k].append(v)
    return [np.concatenate(v) for v in out]


def _unit(rows: pa.Table, temperature: float) -> pa.RecordBatch:
    p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
    key, at, label = (rows.column(c).to_numpy() for c in ("id", "at", "label"))
    v = np.stack(rows.column("v").to_numpy()).astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    left, right = at == p, at == q
    parts = [(left, _one_way(v[left], v[right], label[left], label[right], p == q, temperature))]
    if p != q:
        parts.append((right, _one_way(v[right], v[left], label[right], label[left], False, temperature)))
    ids = np.concatenate([key[side] for side, _ in parts])
    values = [np.concatenate([x[k] for _, x in parts]) for k in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, values)], ["id", "top", "total", "near_top", "near"])


def _units(temperature: float):
    """Rows come sorted by group and pair of blocks; one pair is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if kept is None else pa.concat_tables([kept, rows])).combine_chunks()
            if not len(rows):
                continue
            g, p, q = (rows.column(c).to_numpy() for c in ("g", "p", "q"))
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield _unit(rows.slice(a, b - a), temperature)
            kept = rows.slice(cuts[-1])
        if kept is not None and len(kept):
            yield _unit(kept, temperature)

    return run


def row_losses(df: DataFrame, key: str, vector: str, group: Column, label: str, temperature: float = 0.1) -> DataFrame:  # M06
    """(key, group, loss) of every row that has a positive in its group. ``key`` is unique; a null ``group`` is none."""
    rows = df.select(F.col(key).alias("id"), group.cast("string").alias("group"), F.xxhash64(F.col(label).cast("string")).alias("label"), F.col(vector).cast("array<double>").alias("v")).where("group IS NOT NULL AND v IS NOT NULL")
    rows = durable(rows.withColumn("g", F.xxhash64("group")), "contrast-rows")
    sizes = durable(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "contrast-sizes")
    # groups of several blocks are few: there are at most (all rows / BLOCK) of them
    many = sizes.where("blocks > 1")
    cut = rows.join(sizes.where("blocks = 1").select("g"), "g", "left_semi").withColumn("blocks", F.lit(1)).unionByName(rows.join(F.broadcast(many) if many.limit(100_001).count() <= 100_000 else many, "g"))
    at = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    each = cut.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = each.select("g", F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q"), "id", "at", "label", "v")
    kind = rows.schema["id"].dataType.simpleString()
    parts = units.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q").mapInArrow(_units(temperature), f"id {kind}, top double, total double, near_top double, near double")
    held = parts.groupBy("id").agg(F.collect_list(F.struct("top", "total")).alias("a"), F.collect_list(F.struct("near_top", "near")).alias("b"))  # a struct a block of the group

    def log_sum(xs: str, top: str, total: str) -> Column:
        most = F.array_max(F.transform(xs, lambda x: x[top]))
        return most + F.log(F.aggregate(F.transform(xs, lambda x: F.when(x[total] > 0, x[total] * F.exp(x[top] - most)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x))

    some = held.where(F.exists("b", lambda x: x["near"] > 0))
    losses = some.select("id", (log_sum("a", "top", "total") - log_sum("b", "near_top", "near")).alias("loss"))
    return losses.join(rows.select("id", "group"), "id").select(F.col("id").alias(key), "group", "loss")


def group_losses(df: DataFrame, key: str, vector: str, group: Column, label: str, temperature: float = 0.1) -> DataFrame:
    """(group, anchors, loss): the mean loss of a group's anchors; the loss of all is their mean, weighted by anchors."""
    return row_losses(df, key, vector, group, label, temperature).groupBy("group").agg(F.count(F.lit(1)).alias("anchors"), F.avg("loss").alias("loss"))
