"""Steps that the reviewed queries share: what they send to Python, how often they are made, and ties."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from sievework.operators import metrics, ml, scoring
from sievework.streaming import stateful

ODD = [None, "", " ", "áb", "Ka or İ na", "café ­x​y", "\U000e0101or", "ае cat", "naq ner gung", "  a\t\tb \n c  ", " a b", "ﬁﷺ", "or be na", "a가", "한ো"]


def texts():
    rng = random.Random(3)
    signs = "aeor nbtg \t\né­​́аİKａ%4= ﻿�\x08"
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]


def column(spark, c):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, t string")
    return [r["o"] for r in df.select("i", c(F.col("t")).alias("o")).orderBy("i").collect()]


def test_scores_are_made_once_a_row(spark):
    """thresholds and bins compare a value, they do not make it again."""
    df = spark.createDataFrame([(0, 0.2), (1, 0.9)], "label int, x double").select("label", F.exp(F.col("x") - 1).alias("prob"))
    for made in (metrics.sweep(df, [0.1, 0.5, 0.9]), metrics.ece(df)):
        assert "lambdafunction((EXP(" not in made._jdf.queryExecution().optimizedPlan().toString()
    words = lambda t: scoring.probability(scoring.logit(scoring.words(F.coalesce(t, F.lit("")))))
    assert column(spark, scoring.score) == column(spark, words)
    said = spark.createDataFrame([("Idiot idiot's idiots moroné st​upid clown1 worthlessidiot LICENSE",)], "t string")
    assert said.select(scoring.score(F.col("t"))).first() == said.select(words(F.col("t"))).first()


def test_vocabulary_ties_and_features_made_once(spark):
    """of equally frequent words the first by spelling; fits read features, not texts."""
    df = spark.createDataFrame([(i, w, float(i % 2)) for i, w in enumerate(["zebra", "apple", "mango", "zebra", "berry", "mango"] * 5)], "id long, text string, y double")
    used = ml.bag_of_words(df, "text", 3)
    got = {r["text"]: r["features"].indices.tolist() for r in used.collect()}
    assert got == {"mango": [0], "zebra": [1], "apple": [2], "berry": []}
    assert "UDF" not in ml.out_of_fold(used, "id", "features", "y").select("id")._jdf.queryExecution().optimizedPlan().toString()


def test_resumed_keys_take_rows():
    """F8: rows one by one, no frame a key."""
    made, kept = stateful._Resume("n", ["k", "n"], 0), []

    class Done:
        get = staticmethod(lambda: kept[-1] if kept else None)
        exists = staticmethod(lambda: bool(kept))
        update = staticmethod(kept.append)

    made.done = Done
    rows = [Row(k="a", n=None), Row(k="a", n=5), Row(k="a", n=2), Row(k="a", n=9)]
    assert list(made.handleInputRows(("a",), iter(rows), None)) == [Row(k="a", n=2)] and kept == [(3,)]
    assert list(made.handleInputRows(("a",), iter(rows[1:]), None)) == [] and kept[-1] == (6,)
