"""ML-shaped operators on Spark ML and array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .metrics import auroc
from .splits import hash32


def out_of_fold(df: DataFrame, key: str, features: str, label: str, folds: int = 5) -> DataFrame:  # M01, M08
    """Out-of-fold probabilities of a logistic regression; folds by hash of the key."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    # every fit reads all rows more than once: the features are made once and written, not made again for each fold
    parts, out = durable(df.select(key, features, label, (hash32(F.col(key)) % folds).alias("_fold")), "folds"), None
    for k in range(folds):
        model = LogisticRegression(featuresCol=features, labelCol=label, maxIter=30, regParam=0.01).fit(parts.where(F.col("_fold") != k))
        p = model.transform(parts.where(F.col("_fold") == k)).select(key, label, vector_to_array("probability")[1].alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


def bag_of_words(df: DataFrame, text: str, vocabulary: int = 5000) -> DataFrame:  # M01
    """Counts of the most frequent words; of equally frequent ones the first by spelling, so that reruns agree."""
    from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer, StopWordsRemover

    tokens = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+").transform(df)
    kept = StopWordsRemover(inputCol="_tok", outputCol="_kept").transform(tokens)
    often = kept.select(F.explode("_kept").alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(vocabulary)
    model = CountVectorizerModel.from_vocabulary([r["w"] for r in often.collect()], inputCol="_kept", outputCol="features")
    return model.transform(kept).drop("_tok", "_kept")


def predictability(df: DataFrame, key: str, text: str, label: str) -> DataFrame:  # M01
    """One row: n, AUROC of out-of-fold probabilities of a bag of words, rows told with a confidence above 0.9 (trivial) and
    their share."""
    p = durable(out_of_fold(bag_of_words(df, text), key, "features", label).select(F.col(label).cast("int").alias("label"), F.col("p").alias("prob")), "predictability")
    sure = F.when(F.col("label") == 1, F.col("prob")).otherwise(1 - F.col("prob")) > 0.9
    n = p.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(sure, 1)).alias("trivial"))
    return n.crossJoin(auroc(p)).select("n", "auroc", "trivial", F.round(F.try_divide(F.col("trivial").cast("double"), F.col("n")), 6).alias("share"))


def group_contrast(df: DataFrame, key: str, col: str, group: str) -> DataFrame:  # M06
    """Per group its size and the mean dot product of its pairs (positive), and the mean over all pairs of different
    groups (negative). Only sums per group and coordinate move."""
    parts = df.select(F.col(group).alias("g"), key, F.posexplode(col).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    sums = parts.groupBy("g", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy("g").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    total = sums.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("t"))
    all_ = per.agg(F.sum("n").alias("m"), F.sum("ss").alias("inside"), F.sum(F.col("n") * F.col("n")).alias("nn")).crossJoin(F.broadcast(total))
    negative = F.round(F.try_divide(F.col("t") - F.col("inside"), (F.col("m") * F.col("m") - F.col("nn")).cast("double")), 6)
    positive = F.round(F.try_divide(F.col("ss") - F.col("qq"), (F.col("n") * (F.col("n") - 1)).cast("double")), 6)
    return per.crossJoin(F.broadcast(all_.select(negative.alias("negative")))).select(F.col("g").alias(group), "n", positive.alias("positive"), "negative")
