"""Intervals of any metric of scores under resampling, by Poisson weights.

A resample of n rows draws each row about Poisson(1) times. The times a row is drawn in replicate r are a function of a hash
of the row's key and r, so nothing depends on how rows are dealt to tasks, and several scores of one row are drawn together
(paired comparisons need no more). No row is copied: a task adds each row's weights for all replicates to the cell of its
label and score bin, an array of (cells x replicates) whatever the rows number. The arrays of tasks meet in rounds of bounded
width; metrics are then read off running sums over the bins, all replicates of a block at once.

A score's bin is what a metric sees of it, so metrics of ranks (AUROC, average precision) count scores of one bin as ties;
with 1,000 bins that moves them by about a thousandth on a few hundred rows, less on more. Calibration error uses sums of the scores
themselves, in whole millionths, so that no order of rows shows in the result.
Replicates in which a metric is undefined are dropped from its interval and not counted as valid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Metric = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
BINS, REPLICATES, TENTHS, MILLION = 1000, 1000, 10, 1_000_000
#: Replicates that one group of the merge holds; parts it merges at once.
BLOCK, FAN_IN = 250, 128
#: Rows x replicates of weights at one time.
STEP = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_table() -> np.ndarray:
    """Poisson(1) by the first 16 bits of a hash: its distribution to within 2**-16."""
    share, below, out = np.exp(-1.0), 0.0, np.zeros(1 << 16, np.uint8)
    for k in range(12):
        out[int(round(below * (1 << 16))) :] = k
        below, share = below + share, share / (k + 1)
    return out


_POISSON = _poisson_table()


def weights(keys: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Rows x replicates ``first`` to ``last`` - 1: how often each row is drawn. Replicate 0 is the data themselves."""
    r = _mix(np.arange(first, last, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    w = _POISSON[(_mix(keys[:, None] ^ r[None, :]) >> np.uint64(48)).astype(np.int64)]
    if first == 0 and last > 0:
        w[:, 0] = 1
    return w


def _cells(n_scores: int, replicates: int, bins: int, seed: int):
    """Sums of one task: for each block of replicates and score the weights by (label, bin) and the weighted scores by
    tenth, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n_scores, 2 * bins, replicates + 1), np.int64)
        sums = np.zeros((n_scores, TENTHS, replicates + 1), np.int64)
        for batch in batches:
            key, label = batch.column("key").to_numpy().view(np.uint64), batch.column("label").to_numpy()
            scores = [batch.column(f"s{k}").to_numpy() for k in range(n_scores)]
            step = max(1, STEP // (replicates + 1))
            for lo in range(0, len(key), step):
                w = weights(key[lo : lo + step], 0, replicates + 1, seed)
                for k, p in enumerate(scores):
                    p, y = p[lo : lo + step], label[lo : lo + step]
                    for into, cell, values in ((counts[k], y * bins + np.clip(np.floor(p * bins), 0, bins - 1).astype(np.int64), w), (sums[k], np.clip(np.floor(p * TENTHS), 0, TENTHS - 1).astype(np.int64), w * np.round(p * MILLION).astype(np.int64)[:, None])):
                        order = np.argsort(cell, kind="stable")
                        at, first = np.unique(cell[order], return_index=True)
                        into[at] += np.add.reduceat(values[order], first, axis=0, dtype=into.dtype)
        if counts.any():
            for block, lo in enumerate(range(0, replicates + 1, BLOCK)):
                cut = slice(lo, min(lo + BLOCK, replicates + 1))
                c, s = np.ascontiguousarray(counts[:, :, cut]), np.ascontiguousarray(sums[:, :, cut])
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([c.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], ["block", "counts", "sums"])

    return run


def _added(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    total = None
    for x in column:
        each = np.frombuffer(x.as_buffer(), dtype)
        total = each.copy() if total is None else total + each
    return total


def _merge(table: pa.Table) -> pa.Table:
    one = [table.column(c).slice(0, 1) for c in ("block", "part")]
    return pa.table([*one, pa.array([_added(table.column("counts"), np.int64).tobytes()], pa.binary()), pa.array([_added(table.column("sums"), np.int64).tobytes()], pa.binary())], ["block", "part", "counts", "sums"])


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / np.where(b != 0, b, 1), np.nan)


def at_threshold(f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], threshold: float = 0.5) -> Metric:
    """A metric of the four confusion counts (tp, fp, tn, fn) at a threshold, which should be the edge of a bin."""

    def metric(neg: np.ndarray, pos: np.ndarray, sums: np.ndarray) -> np.ndarray:
        cut = int(np.ceil(threshold * len(neg) - 1e-9))
        return f(pos[cut:].sum(0), neg[cut:].sum(0), neg[:cut].sum(0), pos[:cut].sum(0))

    return metric


def auroc(neg: np.ndarray, pos: np.ndarray, sums: np.ndarray) -> np.ndarray:
    below = np.cumsum(neg, 0) - neg
    return _quotient((pos * (below + 0.5 * neg)).sum(0), pos.sum(0).astype(float) * neg.sum(0))


def average_precision(neg: np.ndarray, pos: np.ndarray, sums: np.ndarray) -> np.ndarray:
    tp, fp = np.cumsum(pos[::-1], 0), np.cumsum(neg[::-1], 0)
    return _quotient((pos[::-1] * np.nan_to_num(_quotient(tp.astype(float), tp + fp))).sum(0), tp[-1].astype(float))


def calibration_error(neg: np.ndarray, pos: np.ndarray, sums: np.ndarray) -> np.ndarray:
    by_tenth = lambda x: x.reshape(TENTHS, -1, x.shape[1]).sum(1)
    return _quotient(np.abs(by_tenth(pos) - sums).sum(0), (pos.sum(0) + neg.sum(0)).astype(float))


def kappa(tp: np.ndarray, fp: np.ndarray, tn: np.ndarray, fn: np.ndarray) -> np.ndarray:
    n = (tp + fp + tn + fn).astype(float)
    chance = _quotient((tp + fp) * 1.0 * (tp + fn) + (tn + fn) * 1.0 * (tn + fp), n * n)
    return _quotient(_quotient(tp + tn, n) - chance, 1 - chance)


METRICS: dict[str, Metric] = {
    "auroc": auroc,
    "ap": average_precision,
    "ece": calibration_error,
    "f1": at_threshold(lambda tp, fp, tn, fn: _quotient(2.0 * tp, 2 * tp + fp + fn)),
    "kappa": at_threshold(kappa),
    "fpr": at_threshold(lambda tp, fp, tn, fn: _quotient(1.0 * fp, fp + tn)),
    "recall": at_threshold(lambda tp, fp, tn, fn: _quotient(1.0 * tp, tp + fn)),
}


def _values(scores: list[str], bins: int, metrics: dict[str, Metric]):
    """(score, metric, replicate, value) of a block; with two scores also of their difference."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        counts = _added(table.column("counts"), np.int64).reshape(len(scores), 2, bins, -1)
        sums = _added(table.column("sums"), np.int64).reshape(len(scores), TENTHS, -1)
        first, r = block * BLOCK, counts.shape[-1]
        out: list[tuple[str, str, np.ndarray]] = []
        for name, metric in metrics.items():
            each = [metric(counts[k, 0], counts[k, 1], sums[k] / MILLION) for k in range(len(scores))]
            out += [(s, name, v) for s, v in zip(scores, each, strict=True)]
            if len(scores) == 2:
                out.append((f"{scores[0]} - {scores[1]}", name, each[0] - each[1]))
        column = lambda x: pa.array([v for v in x for _ in range(r)])
        values = pa.array(np.concatenate([v for *_, v in out]), pa.float64(), from_pandas=True)
        return pa.table([column(s for s, *_ in out), column(m for _, m, _ in out), pa.array(np.tile(np.arange(first, first + r), len(out))), values], ["score", "metric", "replicate", "value"])

    return run


def replicates_of(df: DataFrame, key: str, label: str, scores: list[str], metrics: dict[str, Metric] = METRICS, replicates: int = REPLICATES, bins: int = BINS, seed: int = 42) -> DataFrame:
    """(score, metric, replicate, value): every metric of every score in every replicate, 0 being the data themselves.
    Rows without a label or a score are left out. ``bins``: a multiple of 10."""
    if bins % TENTHS:
        raise ValueError("bins: a multiple of 10")
    columns = [F.col(c).cast("double").alias(f"s{k}") for k, c in enumerate(scores)]
    rows = df.select(F.xxhash64(F.col(key)).alias("key"), F.col(label).cast("int").alias("label"), *columns).where(" AND ".join(f"{c} IS NOT NULL" for c in ("label", *(f"s{k}" for k in range(len(scores))))))
    parts = rows.coalesce(FAN_IN * FAN_IN).mapInArrow(_cells(len(scores), replicates, bins, seed), "block bigint, counts binary, sums binary")
    parts = parts.withColumn("part", F.floor(F.spark_partition_id() / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(_merge, "block bigint, part int, counts binary, sums binary")
    return parts.groupBy("block").applyInArrow(_values(scores, bins, metrics), "score string, metric string, replicate bigint, value double")


def intervals(df: DataFrame, key: str, label: str, scores: list[str], metrics: dict[str, Metric] = METRICS, replicates: int = REPLICATES, bins: int = BINS, seed: int = 42, level: float = 0.95) -> DataFrame:  # A27
    """(score, metric, point, low, high, n_valid): percentile intervals. With two scores the rows of their difference come
    from the same draws, and ``p_not_above`` is the share of draws in which it is not above 0."""
    each = replicates_of(df, key, label, scores, metrics, replicates, bins, seed)
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    ends = F.percentile(drawn, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    out = each.groupBy("score", "metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("point"), ends.alias("e"), F.count(drawn).alias("n_valid"), F.avg((drawn <= 0).cast("double")).alias("p_not_above"))
    return out.select("score", "metric", "point", F.get("e", F.lit(0)).alias("low"), F.get("e", F.lit(1)).alias("high"), "n_valid", "p_not_above")
