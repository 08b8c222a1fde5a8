"""A text scorer that stays inside the JVM, and what is reported about scorers: windows, errors, experiments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, strip_invisible, whole_words, windows
from .metrics import ratio

#: Weights of words in hundredths of a logit, and the offset: whole numbers, so that sums do not depend on order.
WEIGHTS = {"idiot": 220, "moron": 200, "stupid": 160, "clown": 120, "worthless": 180, "license": -50}
BIAS = -150


def words(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(strip_invisible(t)), F.lit("[a-z]+"), F.lit(0))


def logit(ws: Column, weights: dict[str, int] = WEIGHTS, bias: int = BIAS) -> Column:
    """Hundredths of a logit of an array of words."""
    worth = lambda w: F.coalesce(*[F.when(w == k, v) for k, v in weights.items()], F.lit(0))
    hits = F.filter(ws, lambda w: w.isin(list(weights)))
    return F.aggregate(hits, F.lit(bias), lambda a, w: a + worth(w))


def known_words(t: Column, known: list[str]) -> Column:
    """Those of the ``words`` that are among ``known``; no array of all words is made."""
    known = [w for w in known if re.fullmatch("[a-z]+", w)]
    return F.regexp_extract_all(F.lower(strip_invisible(t)), F.lit(whole_words(known)), F.lit(0)) if known else F.array().cast("array<string>")


def probability(z: Column) -> Column:
    """Four decimals of the logistic of hundredths of a logit."""
    return F.floor(10000 / (1 + F.exp(-z / 100.0)) + 0.5) / 10000.0


def score(t: Column, weights: dict[str, int] = WEIGHTS, bias: int = BIAS) -> Column:  # M03
    """The probability of a text; null counts as empty."""
    return probability(logit(known_words(F.coalesce(t, F.lit("")), list(weights)), weights, bias))


def pair(prompt: Column, response: Column) -> Column:
    """The text of a prompt and its response, as the scorer takes it."""
    return F.concat_ws(" [SEP] ", prompt, F.coalesce(response, F.lit("")))


def verdict(p: Column, threshold: float = 0.5) -> Column:
    """Struct of label, confidence in it, and probability."""
    return F.struct((p >= threshold).cast("int").alias("label"), F.round(F.greatest(p, 1 - p), 6).alias("confidence"), p.alias("prob"))


def sliding(t: Column, budget: int = 128, stride: int = 64) -> Column:  # M04
    """The scores of overlapping windows of a text: array of probabilities."""
    return F.transform(windows(words(F.coalesce(t, F.lit(""))), budget, stride), lambda w: probability(logit(w)))


def guarded(t: Column, least: int = 1) -> Column:  # M17
    """Verdict with an error per item: what can't be scored gets label 0 and probability 0, and says why."""
    why = F.when(t.isNull(), "missing").when(F.length(F.trim(t)) < least, "too short")
    p = F.when(why.isNull(), score(t)).otherwise(0.0)
    return let(F.struct(p.alias("p"), why.alias("why")), lambda x: F.struct((x["p"] >= 0.5).cast("int").alias("label"), x["p"].alias("prob"), x["why"].alias("error")))


def fit_weights(labelled: DataFrame, text: str, label: str, most: int = 50, least: int = 5) -> DataFrame:
    """(word, weight): log-odds in hundredths, add-half smoothed, of the words whose document counts in the two classes
    differ most by a z-score. ``most`` is the size of the model."""
    docs = labelled.select(F.explode(F.array_distinct(words(F.coalesce(F.col(text), F.lit(""))))).alias("word"), F.col(label).alias("y"))
    n = labelled.agg(F.sum(label).alias("n1"), F.sum(1 - F.col(label)).alias("n0"))
    per = docs.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= least).crossJoin(F.broadcast(n))
    odds = F.log((F.col("a") + 0.5) / (F.col("n1") - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (F.col("n0") - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    return per.select("word", F.floor(100 * odds + 0.5).cast("int").alias("weight"), F.round(F.abs(z), 6).alias("z")).orderBy(F.desc("z"), "word").limit(most)


def latency(df: DataFrame, by: str, ms: str) -> DataFrame:  # A44
    """Items, mean, median, 95th percentile (by counts of whole values) and items a second."""
    per = df.groupBy(by, F.floor(ms).alias("v")).agg(F.count(F.lit(1)).alias("k"), F.sum(ms).alias("s"))
    from pyspark.sql import Window

    up, every = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    c = per.withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(every))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("v")))
    return c.groupBy(by).agg(F.max("n").alias("n"), F.round(F.sum("s") / F.sum("k"), 6).alias("mean_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.round(ratio(1000 * F.sum("k"), F.sum("s")), 4).alias("per_second"))


def run_all(spark: SparkSession, experiments: dict[str, Callable[[], DataFrame]]) -> DataFrame:  # M20
    """A row per experiment: its status and its rows or the kind of its error. One that fails stops no other."""
    rows = []
    for name, f in experiments.items():
        try:
            rows.append((name, "ok", f().count(), None))
        except Exception as e:  # any failure of an experiment is a result here
            rows.append((name, "failed", None, type(e).__name__))
    return spark.createDataFrame(rows, "experiment string, status string, n_rows bigint, error string")
