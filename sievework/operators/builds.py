"""Dataset builds out of splits and audits: preparation, new rows against loaded ones, guarded zips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import splits
from .metrics import r6, ratio


def new_against(df: DataFrame, loaded: DataFrame, keys: list[str], order: str) -> DataFrame:  # D04, D26
    """The first row of each key that ``loaded`` lacks."""
    fresh = df.join(loaded.select(*keys).distinct(), keys, "left_anti")
    return splits.first_per_key(fresh, F.struct(*keys), order)


def prepare(df: DataFrame, base: str, label: str = "label", hold_out: float = 0.2, ratios: tuple[float, float] = (0.7, 0.15)) -> DataFrame:  # D20
    """``df`` with ``split``. Rows of one base (an example and what was made from it) stay together throughout: a share of the
    bases without a positive row, one at least, is held out by hash; the rest goes to train, val and test by base, with the
    labels in equal shares."""
    clean = df.groupBy(base).agg(F.max(label).alias("_bad")).where("_bad = 0").select(base)
    order = splits.ranked(clean, base)
    out = order.where(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * hold_out))).select(F.col(base).alias("_out"))
    marked = df.join(out, F.col(base) == F.col("_out"), "left")
    held = marked.where("_out IS NOT NULL").drop("_out").withColumn("split", F.lit("held_out"))
    return held.unionByName(splits.group_split(marked.where("_out IS NULL").drop("_out"), F.col(base), label, ratios))


def formatted(df: DataFrame, query: str, response: str) -> DataFrame:
    """``df`` with the classifier's ``text``: both sides around a separator."""
    return df.withColumn("text", F.concat(F.coalesce(F.col(query), F.lit("")), F.lit(" [SEP] "), F.coalesce(F.col(response), F.lit(""))))


def summary(prepared: DataFrame) -> DataFrame:
    """Rows per split and label, with the class weights of the training part (rows / (classes x rows of the class))."""
    c = prepared.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    train = c.where("split = 'train'")
    total = train.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    w = train.crossJoin(F.broadcast(total)).select(F.col("label").alias("_l"), r6(ratio(F.col("t"), F.col("k") * F.col("n"))).alias("weight"))
    return c.join(F.broadcast(w), F.col("label") == F.col("_l")).drop("_l")
