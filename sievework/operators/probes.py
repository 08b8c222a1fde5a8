"""Linear probes on embeddings: a grid of penalties over folds, and concept directions taken out one after the other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import curve_metrics
from .model import balanced
from .splits import hash32

#: Ten penalties, half a decade apart: 10**-3 to 10**1.5.
GRID = [10 ** (-3 + k / 2) for k in range(10)]


@dataclass
class Choice:
    """``table``: (c, mean average precision) in grid order; ``best``: the C chosen; ``model``: fitted on all rows."""

    table: list[tuple[float, float]]
    best: float
    model: object


def _ap_evaluator():
    from pyspark.ml.evaluation import Evaluator
    from pyspark.ml.functions import vector_to_array

    class StepAveragePrecision(Evaluator):
        """Sum over scores of precision times the step of recall, where MLlib's own interpolates."""

        def _evaluate(self, dataset: DataFrame) -> float:
            scored = dataset.select(F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("prob"))
            return curve_metrics(scored, 0.0).first()["ap"] or 0.0

        def isLargerBetter(self) -> bool:
            return True

    return StepAveragePrecision()


def grid_search(df: DataFrame, key: str, vector: str, label: str, grid: list[float] = GRID, folds: int = 5, seed: int = 42, side_by_side: int = 4) -> Choice:  # M08
    """Chooses C (the weight of the loss against half the squared norm of the weights) by the mean step-wise average
    precision over folds of a hash of the key. The classes weigh alike. Fits run side by side, each over the
    executors; the rows are cached once for all of them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = balanced(df.select(F.col(key), F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), (hash32(F.col(key), seed) % folds).cast("int").alias("fold")), "label").cache()
    # MLlib weighs the mean loss by 1; a fold trains on about (folds - 1) / folds of the rows
    n = rows.count() * (folds - 1) / folds
    lr = LogisticRegression(weightCol="weight", maxIter=60, tol=1e-8, standardization=False)
    params = ParamGridBuilder().addGrid(lr.regParam, [1 / (c * max(1.0, n)) for c in grid]).build()
    try:
        found = CrossValidator(estimator=lr, estimatorParamMaps=params, evaluator=_ap_evaluator(), numFolds=folds, foldCol="fold", parallelism=side_by_side, collectSubModels=False).fit(rows)
    finally:
        rows.unpersist()
    mean = [float(v) for v in found.avgMetrics]
    return Choice(list(zip(grid, mean, strict=True)), grid[int(np.argmax(mean))], found.bestModel)


def held_out_probe(df: DataFrame, key: str, vector: str, label: str, c: float, percent: int = 70, seed: int = 42) -> DataFrame:  # M08
    """(key, label, prob) of the rows outside a training split of ``percent``, by hash within each class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from .splits import ranked

    order = ranked(df.select(key, F.col(label).alias("_y")), key, "_y", seed=seed).select(F.col(key).alias("_k"), (F.col("_rn") <= F.floor(F.col("_n") * percent / 100)).alias("_train"))
    rows = df.join(order, F.col(key) == F.col("_k")).select(F.col(key), F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), "_train")
    train = balanced(rows.where("_train"), "label").cache()
    lr = LogisticRegression(weightCol="weight", regParam=1 / (c * max(1, train.count())), maxIter=60, tol=1e-8, standardization=False).fit(train)
    train.unpersist()
    return lr.transform(rows.where("NOT _train")).select(key, F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("prob"))


def moments(df: DataFrame, vector: str, targets: list[str], dim: int) -> np.ndarray:
    """The Gram matrix of (1, x, targets), in one pass: a task sends one small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + dim + len(targets),) * 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(float)
            a = np.column_stack([np.ones(len(x)), x, *[batch.column(f"t{k}").to_numpy() for k in range(len(targets))]])
            total += a.T @ a
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "s"])

    rows = df.select(F.col(vector).cast("array<double>").alias("v"), *[F.col(t).cast("double").alias(f"t{k}") for k, t in enumerate(targets)]).na.drop()
    size = 1 + dim + len(targets)
    out = np.zeros(size * size)
    for r in rows.mapInArrow(run, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out.reshape(size, size)


def centred(m: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covariances of x, of x with the targets, and of the targets, times the number of rows."""
    n, mean = m[0, 0], m[0, 1:]
    c = m[1:, 1:] - np.outer(mean, mean) / max(n, 1.0)
    return c[:dim, :dim], c[:dim, dim:], c[dim:, dim:]


def explained(gram: np.ndarray, cross: np.ndarray, own: float) -> float:
    """The share of a target's variance that a linear fit explains."""
    return float(cross @ np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ cross / own) if own > 0 else 0.0


@dataclass
class Deflation:
    directions: list[np.ndarray]
    concept: list[float]  # explained before the first round, and after each
    task: list[float]


def deflate(gram: np.ndarray, cross: np.ndarray, own: np.ndarray, rounds: int = 4, ridge: float = 1.0, least: float = 1e-3) -> Deflation:  # M07
    """Directions of a concept (the first target), each orthogonal to those before and to the direction of the task (the
    second). Every round fits the concept by ridge least squares to what is left, takes the direction out and updates the
    matrices by rank-one terms; the rows are not read again. Ends when less than ``least`` of the concept can be explained."""
    d = len(gram)
    fit = lambda g, b: np.linalg.solve(g + ridge * np.eye(d), b)
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-12 else np.zeros(d)
    task = unit(fit(gram, cross[:, 1]))
    g, b = gram.copy(), cross.copy()
    out = Deflation([], [explained(g, b[:, 0], own[0, 0])], [explained(g, b[:, 1], own[1, 1])])
    for _ in range(rounds):
        w = fit(g, b[:, 0])
        for v in (task, *out.directions):
            w = w - (w @ v) * v
        w = unit(w)
        if not w.any() or out.concept[-1] < least:
            break
        gw = g @ w
        g = g - np.outer(gw, w) - np.outer(w, gw) + (w @ gw) * np.outer(w, w)
        b = b - np.outer(w, w @ b)
        out.directions.append(w)
        out.concept.append(explained(g, b[:, 0], own[0, 0]))
        out.task.append(explained(g, b[:, 1], own[1, 1]))
    return out


def project(df: DataFrame, vector: str, directions: list[np.ndarray], out: str) -> DataFrame:
    """``vector`` without its parts along orthonormal directions, as array expressions."""
    x = F.transform(vector, lambda v: v.cast("double"))
    df = df.withColumn(out, x)
    for w in directions:
        weights = F.array(*[F.lit(float(v)) for v in w])
        dot = F.aggregate(F.zip_with(out, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        df = df.withColumn("_dot", dot).withColumn(out, F.zip_with(out, weights, lambda a, b: a - F.col("_dot") * b)).drop("_dot")
    return df
