"""Fitting on one half, measuring on the other: temperature scaling and a conformal bound on false alarms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import sweep
from .splits import hash32
from .stats import _binom_tail

#: Logits are clipped here and binned this finely: at most 2 * 2 * REACH * GRAIN bins, whatever the rows number.
REACH, GRAIN = 16, 256


def first_half(key: Column, seed: int = 42) -> Column:
    """Every other row by a hash of its key."""
    return hash32(key, seed) % 2 == 0


def logit(prob: Column) -> Column:
    p = F.least(F.greatest(prob, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.log(p / (1 - p))


def binned_logits(df: DataFrame, prob: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean logit, rows, rows of label 1) of each bin of logits: one aggregate of bounded size."""
    z = logit(F.col(prob))
    per = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), z)) * GRAIN).alias("bin"))
    rows = per.agg(F.avg(z).alias("z"), F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("y")).orderBy("bin").collect()
    return tuple(np.array([r[c] for r in rows], float) for c in ("z", "n", "y"))


def mean_loss(z: np.ndarray, n: np.ndarray, y: np.ndarray, temperature: float) -> float:
    x = z / temperature
    return float((n * np.logaddexp(0, x) - y * x).sum() / max(1.0, n.sum()))


def best_temperature(z: np.ndarray, n: np.ndarray, y: np.ndarray, low: float = 0.05, high: float = 20.0, rounds: int = 60) -> float:  # M11
    """The temperature between two bounds of least mean log loss. The loss is convex in one over the temperature, so a
    golden-section search there closes in on it."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = 1 / high, 1 / low
    loss = lambda v: mean_loss(z, n, y, 1 / v)
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(rounds):
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = loss(d)
    return 2 / (a + b)


def calibrated(df: DataFrame, key: str, prob: str, label: str) -> tuple[float, DataFrame]:
    """The temperature fitted on the first half, and the second half with ``scaled`` beside its probability."""
    fitted = best_temperature(*binned_logits(df.where(first_half(F.col(key))), prob, label))
    scaled = 1 / (1 + F.exp(-logit(F.col(prob)) / F.lit(fitted)))
    return fitted, df.where(~first_half(F.col(key))).withColumn("scaled", scaled)


def calibration_report(df: DataFrame, key: str, prob: str, label: str) -> DataFrame:  # M11
    """(score, temperature, n, nll, brier, ece) of the second half, before and after."""
    temperature, rest = calibrated(df, key, prob, label)
    each = rest.select(F.col(label).cast("double").alias("y"), F.inline(F.array(F.struct(F.lit("before").alias("score"), F.col(prob).alias("p")), F.struct(F.lit("after").alias("score"), F.col("scaled").alias("p")))))
    tenth = F.least(F.floor(F.col("p") * 10), F.lit(9))
    q = F.least(F.greatest("p", F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = F.when(F.col("y") == 1, -F.log(q)).otherwise(-F.log(1 - q))
    per = each.groupBy("score", tenth.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ys"), F.sum("p").alias("ps"), F.sum(loss).alias("l"), F.sum((F.col("p") - F.col("y")) ** 2).alias("b"))
    n = F.sum("n")
    return per.groupBy("score").agg(n.alias("n"), (F.sum("l") / n).alias("nll"), (F.sum("b") / n).alias("brier"), (F.sum(F.abs(F.col("ps") - F.col("ys"))) / n).alias("ece")).withColumn("temperature", F.when(F.col("score") == "after", F.lit(temperature)).otherwise(1.0))


def upper_limit(k: int, n: int, delta: float) -> float:
    """The one-sided exact (Clopper-Pearson) limit that a rate of k in n exceeds with a probability of ``delta``."""
    if k >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - _binom_tail(k + 1, n, mid) > delta else (lo, mid)
    return hi


#: From 0.99 down to 0.01 in 196 steps, as the fixed sequence takes them.
SEQUENCE = [0.99 - 0.98 * k / 196 for k in range(197)]


def conformal(df: DataFrame, key: str, alphas: list[float], delta: float = 0.05) -> DataFrame:  # M13
    """(alpha, tau, bound, n_calibration, n_test, test_rate, recall) for a table of label and prob: thresholds are tried from
    the strictest down while the exact upper limit of the false-alarm rate on the first half of the clean rows stays
    within alpha. Then, with a probability of at least 1 - delta, the true rate at tau is within alpha; the second half
    of the clean rows shows it, the others the recall. No threshold holds: tau is null and nothing is flagged."""
    spark = df.sparkSession
    role = F.when(F.col("label") == 1, "recall").when(first_half(F.col(key)), "calibration").otherwise("test")
    # one sweep for all three parts: counts at each threshold of rows taken as clean
    counted = sweep(df.select("prob", F.lit(0).alias("label"), role.alias("role")), SEQUENCE[::-1], "role").select("role", "threshold", "fp", (F.col("fp") + F.col("tn")).alias("n")).collect()  # 197 rows a role
    at: dict[str, dict[float, int]] = {"recall": {}, "calibration": {}, "test": {}}
    size = dict.fromkeys(at, 0)
    for r in counted:
        at[r["role"]][r["threshold"]], size[r["role"]] = r["fp"], r["n"]
    limits = {t: upper_limit(k, size["calibration"], delta) for t, k in at["calibration"].items()}
    rate = lambda part, t: at[part][t] / size[part] if t is not None and size[part] else None if size[part] == 0 else 0.0
    rows = []
    for alpha in alphas:
        tau = None
        for t in SEQUENCE:
            if limits.get(t, 1.0) > alpha:
                break
            tau = t
        rows.append((alpha, tau, limits[tau] if tau is not None else None, size["calibration"], size["test"], rate("test", tau), rate("recall", tau)))
    return spark.createDataFrame(rows, "alpha double, tau double, bound double, n_calibration bigint, n_test bigint, test_rate double, recall double")
