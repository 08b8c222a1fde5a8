"""A text classifier as data: hashed words, a weighted logistic regression, and its weights as a table.

A text's features are its different words, hashed into `DIM` buckets, each worth one over the square root of their number
(so long texts are no louder than short ones). The regression is fitted on sparse vectors inside the JVM; the classes weigh
alike. The model is a table of whole millionths a bucket, with the intercept at bucket -1: at most ``DIM + 1`` rows whatever the
corpus holds. To score, it goes to the executors as one literal of that bounded size, and a score is a column
like any other: no shuffle, no Python, and sums of whole numbers that no order of words changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from ..session import durable, scratch_path
from .scoring import words
from .splits import hash32

DIM, MILLION = 1 << 14, 1_000_000
MODEL = "bucket int, weight bigint"


def buckets(text: Column) -> Column:
    """The different buckets of a text's words, ascending; null counts as empty."""
    return F.array_sort(F.array_distinct(F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(DIM)).cast("int"))))


def _with_vectors(rows: DataFrame) -> DataFrame:
    """Rows of label, weight and ``b`` as rows with sparse vectors. A vector is a struct of these four fields in a Parquet
    file, so it is written as that and read as a vector."""
    from pyspark.ml.linalg import VectorUDT

    path = scratch_path(rows.sparkSession, "vectors")
    size = F.size("b")
    values = F.transform("b", lambda _: F.lit(1.0) / F.sqrt(size))
    struct = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(DIM).alias("size"), F.col("b").alias("indices"), values.alias("values"))
    durable(rows.select("label", "weight", struct.alias("features")), path=path)
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: rows / (2 x rows of its class), so that the classes weigh alike."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("n1")).first()
    total, ones = n["n"], int(n["n1"] or 0)
    share = lambda k: total / (2.0 * k) if k else 0.0
    return df.withColumn("weight", F.when(F.col(label) == 1, share(ones)).otherwise(share(total - ones)))


def fit(labelled: DataFrame, text: str, label: str, ridge: float = 1e-4, rounds: int = 60) -> DataFrame:  # M03
    """The model (bucket, weight) of texts with labels 0 and 1. One class alone gives a model that always says it."""
    from pyspark.ml.classification import LogisticRegression

    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), buckets(F.col(text)).alias("b"))
    train = _with_vectors(balanced(rows, "label"))
    made = LogisticRegression(weightCol="weight", regParam=ridge, maxIter=rounds, tol=1e-9, standardization=False).fit(train)
    w = made.coefficients.toArray()
    bias = max(-1e6, min(1e6, made.intercept))
    table = [(-1, int(round(bias * MILLION)))] + [(k, int(round(v * MILLION))) for k, v in enumerate(w.tolist()) if round(v * MILLION)]
    return labelled.sparkSession.createDataFrame(table, MODEL)


@dataclass
class Model:
    """A model table, ready to score."""

    literal: str
    intercept: int

    @staticmethod
    def of(table: DataFrame) -> Model:
        weights = [0] * DIM
        intercept = 0
        for r in table.collect():  # at most DIM + 1 rows
            if r["bucket"] < 0:
                intercept = r["weight"]
            else:
                weights[r["bucket"]] = r["weight"]
        return Model(",".join(map(str, weights)), intercept)

    def logit(self, text: Column) -> Column:
        weights = F.split(F.lit(self.literal), ",").cast("array<bigint>")

        def worth(b: Column) -> Column:
            total = F.aggregate(b, F.lit(0).cast("bigint"), lambda s, k: s + F.get(weights, k))
            return (F.lit(self.intercept) + total / F.sqrt(F.greatest(F.size(b), F.lit(1)))) / F.lit(float(MILLION))

        return let(buckets(text), worth)

    def probability(self, text: Column) -> Column:
        """Six decimals of the probability of label 1."""
        return F.round(1 / (1 + F.exp(-self.logit(text))), 6)


def train_part(key: Column, percent: int = 70, seed: int = 42) -> Column:
    """Whether a row is of the training split, by a hash of its key."""
    return hash32(key, seed) % 100 < percent


def held_out(labelled: DataFrame, key: str, text: str, label: str, percent: int = 70, **fitting) -> DataFrame:
    """``labelled`` without its training split, with ``prob`` from a model fitted on that split."""
    train = labelled.where(train_part(F.col(key), percent))
    model = Model.of(fit(train, text, label, **fitting))
    return labelled.where(~train_part(F.col(key), percent)).withColumn("prob", model.probability(F.col(text)))
