"""Intervals, tests and resampling on aggregated rows. What runs in Python sees a handful of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import cells


def _beta_fraction(x: float, a: float, b: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for i in range(1, 100_000):
        for num in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1.0 / ((1 + num * d) or tiny), (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def _binom_tail(k: int, n: int, p: float) -> float:
    """P(X >= k), the regularised incomplete beta function I_p(k, n - k + 1): its cost does not grow with the counts."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    a, b = float(k), float(n - k + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p))
    if p < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(p, a, b) / a)
    return max(0.0, 1.0 - front * _beta_fraction(1 - p, b, a) / b)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact interval by bisection on the binomial tail."""

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: _binom_tail(k, n, p) < alpha / 2)
    high = 1.0 if k == n else solve(lambda p: 1 - _binom_tail(k + 1, n, p) > alpha / 2)
    return low, high


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def cp_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:  # A24
    return pd.DataFrame([clopper_pearson(int(a), int(b)) if b else (0.0, 1.0) for a, b in zip(k, n)], columns=["low", "high"])


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:  # A26
    return pd.Series([1.0 if x + y == 0 else min(1.0, 2 * (1 - _binom_tail(int(min(x, y)) + 1, int(x + y), 0.5))) for x, y in zip(b, c)])


def bootstrap_f1(df: DataFrame, replicates: int = 10_000, seed: int = 42, threshold: float = 0.5) -> DataFrame:  # A27
    """Percentile interval of F1. The rows collapse to the four confusion cells and the cells are resampled: exact in
    distribution, with one aggregate over the data whatever their size. Degenerate resamples are dropped."""
    one = df.agg(*[c.alias(k) for k, c in cells((F.col("prob") >= threshold).cast("int")).items()])

    def run(parts):
        for p in parts:
            for r in p.itertuples():
                counts = np.array([r.tp, r.fp, r.tn, r.fn], float)
                n = int(counts.sum())
                draws = np.random.default_rng(seed).multinomial(n, counts / max(n, 1), size=replicates) if n else np.zeros((0, 4))
                den = 2 * draws[:, 0] + draws[:, 1] + draws[:, 3]
                f1 = 2 * draws[den > 0, 0] / den[den > 0]
                point = 2 * r.tp / max(1, 2 * r.tp + r.fp + r.fn)
                lo, hi = (np.percentile(f1, [2.5, 97.5]) if len(f1) else (np.nan, np.nan))
                yield pd.DataFrame([(point, float(lo), float(hi), int(len(f1)))], columns=["f1", "low", "high", "n_valid"])

    return one.mapInPandas(run, "f1 double, low double, high double, n_valid long")


def _rates(c: np.ndarray) -> dict[str, np.ndarray]:
    """F1, kappa and FPR of rows of (tn, fp, fn, tp); NaN where undefined."""
    tn, fp, fn, tp = c.T
    n = c.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
        return {"f1": 2 * tp / (2 * tp + fp + fn), "kappa": ((tp + tn) / n - chance) / (1 - chance), "fpr": fp / (fp + tn)}


def paired_bootstrap(df: DataFrame, replicates: int = 10_000, seed: int = 42, threshold: float = 0.5) -> DataFrame:  # A28
    """Differences (a - b) of F1, kappa and FPR with percentile intervals, P(A <= B), and whether the two models' own
    intervals overlap. The rows collapse to the eight joint cells (label x a x b), which are resampled together, so
    what the models have in common stays in every draw. Resamples in which either model's rate is undefined are dropped."""
    a, b = ((F.col(c) >= threshold).cast("int") for c in ("prob", "prob_b"))
    joint = F.col("label") * 4 + a * 2 + b
    one = df.agg(*[F.count(F.when(joint == i, 1)).alias(f"c{i}") for i in range(8)])

    def run(parts):
        for p in parts:
            for r in p[[f"c{i}" for i in range(8)]].to_numpy(float):
                n = int(r.sum())
                draws = np.random.default_rng(seed).multinomial(n, r / n, size=replicates) if n else np.zeros((0, 8))
                c = np.vstack([r, draws]).reshape(-1, 2, 2, 2)
                of_a, of_b = (_rates(c.sum(axis=other).reshape(-1, 4).astype(float)) for other in (3, 2))
                out = []
                for name in of_a:
                    x, y = of_a[name], of_b[name]
                    point = (x[0], y[0], x[0] - y[0])
                    valid = ~np.isnan(x[1:] - y[1:])
                    x, y = x[1:][valid], y[1:][valid]
                    ends = [np.percentile(v, [2.5, 97.5]) if len(v) else (np.nan, np.nan) for v in (x, y, x - y)]
                    le = float((x <= y).mean()) if len(x) else np.nan
                    out.append((name, *map(float, point), *(float(e) for ab in ends for e in ab), le, bool(ends[0][0] <= ends[1][1] and ends[1][0] <= ends[0][1]), int(len(x))))
                yield pd.DataFrame(out, columns=[f.split()[0] for f in PAIRED.split(", ")])

    return one.mapInPandas(run, PAIRED)


PAIRED = "metric string, a double, b double, delta double, low_a double, high_a double, low_b double, high_b double, low double, high double, p_a_le_b double, overlap boolean, n_valid long"
